import random

import numpy as np
from conceptile.llm.decontamination import Block, contaminated, decontamination_stage, karp_rabin, hashes, op10_decontamination, tokens
from pyspark.sql import types as T

ITEMS = "item_id long, text string"


def greedy(p, t, least):
    """The published tiling, by comparing every word with every word."""
    pm, tm, out = [0] * len(p), [0] * len(t), []
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not pm[i + k] and not tm[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j, k)]
                elif k == best and k >= least:
                    found.append((i, j, k))
        if not found:
            return sorted(out)
        for i, j, k in found:
            if not any(pm[i : i + k]) and not any(tm[j : j + k]):
                pm[i : i + k], tm[j : j + k] = [1] * k, [1] * k
                out.append((i, j, k))


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        t = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
        got = [x for _, x, _ in Block([(1, " ".join(p))], 3).matches(" ".join(t))]
        assert (got[0] if got else []) == greedy(p, t, min(3, len(p)))


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for i, p in items:
        seeds = {tuple(p[k : k + 5]) for k in range(len(p) - 4)}
        for d, t in docs:
            if any(tuple(t[k : k + 5]) in seeds for k in range(len(t) - 4)):
                found = greedy(p, t, 5)
                if sum(x[2] for x in found) >= 0.8 * len(p):
                    want.add((d, i, ",".join("%d:%d:%d" % x for x in found)))
    assert {(r.doc_id, r.item_id, r.tiles) for r in op10_decontamination(spark, sf_dir).collect()} == want and want


def test_reordered_passages_are_caught_and_parts_are_not(spark, docs):
    item = [f"b{i}" for i in range(40)]
    rest = [f"r{i}" for i in range(300)]
    moved = rest[:100] + item[20:] + rest[100:200] + item[10:20] + item[:10] + rest[200:]
    rows = [(1, " ".join(moved).upper()), (2, " ".join(rest + item[:24])), (3, ", ".join(item)), (4, " ".join(reversed(item))), (5, " ".join(rest))]
    bench = spark.createDataFrame([(7, " ".join(item))], ITEMS)
    assert {(r.doc_id, r.n_tiles) for r in contaminated(docs(rows), bench).collect()} == {(1, 3), (3, 1)}


def test_blocks_do_not_change_the_result(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted(contaminated(d, b, block_words=700).collect()) == sorted(contaminated(d, b).collect())


def test_defined_cases(spark, docs, table_dir):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "nothing has an id here"), (5, "a a a a a a a a")], ITEMS)
    rows = [(1, None), (2, ""), (3, "two  WORDS"), (3, "two  WORDS"), (4, "two other words"), (None, "Nothing has an id here!"), (6, "a " * 30_000), (7, "a a a a")]
    df = docs(rows, ["item_id", "coverage", "_gone"])
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(df, bench).collect()), key=str)
    assert got == [(3, 3), (3, 3), (6, 5), (None, None)]
    left = decontamination_stage(spark, df, table_dir(benchmark=bench))
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4, 7]
    assert contaminated(docs([]), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []
    assert isinstance(contaminated(df, bench.limit(0)).schema["tiles"].dataType, T.StringType)


def test_windows_shorter_than_their_width():
    assert len(karp_rabin(hashes(["a"] * 4), 5)) == 0 and len(set(karp_rabin(hashes(list("ababab")), 2))) == 2


def test_a_long_passage_of_a_longer_item_is_caught(spark, docs):
    item, rest = [f"b{i}" for i in range(200)], [f"r{i}" for i in range(100)]
    rows = [(1, " ".join(rest + item[20:170])), (2, " ".join(item[:50] + rest)), (3, " ".join(item[:49] + rest + item[60:109]))]
    bench = spark.createDataFrame([(7, " ".join(item))], ITEMS)
    assert sorted((r.doc_id, r.tiled_words) for r in contaminated(docs(rows), bench).collect()) == [(1, 150), (2, 50)]


def test_running_hashes_are_those_of_the_words_alone():
    from conceptile.llm.decontamination import Running

    wh = hashes(list("xyzabcabxyzab"))
    run = Running(wh)
    for width in (1, 2, 5):
        h = run.windows(np.arange(len(wh) - width + 1), width)
        assert all((h[i] == h[j]) == (list(wh[i : i + width]) == list(wh[j : j + width])) for i in range(len(h)) for j in range(len(h)))
        assert (h == np.concatenate([Running(wh[i : i + width]).windows(np.zeros(1, dtype=int), width) for i in range(len(h))])).all()


def test_longer_random_texts_equal_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        p = [rng.choice("abcd") for _ in range(rng.randint(20, 45))]
        t = [rng.choice("abcd") for _ in range(40)]
        for _ in range(3):
            i, k = rng.randrange(len(p)), rng.randint(3, 20)
            t[rng.randrange(len(t)) : 0] = p[i : i + k]
        got = [x for _, x, _ in Block([(1, " ".join(p))], 3).matches(" ".join(t))]
        assert (got[0] if got else []) == greedy(p, t, 3)


def test_repeated_words_do_not_multiply():
    """A million words against an item of 800, all alike but for a few: pairs of places would be 8 * 10^8."""
    import time

    start = time.time()
    block = Block([(1, "a " * 800), (2, "a b " * 300 + "a " * 200)])
    got = {i: x for i, x, _ in block.matches("a " * 1_000_000 + "b a " * 3000)}
    assert got[1] == [(0, 0, 800)] and sum(k for _, _, k in got[2]) == 800 and time.time() - start < 60
