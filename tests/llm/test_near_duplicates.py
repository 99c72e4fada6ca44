import re
from collections import defaultdict

import numpy as np
import pytest
from conceptile.llm.common import LONG, Scratch, schema
from conceptile.llm.near_duplicates import BASE, REGISTERS, SCALE, band_hashes, components, dealt_chunks, dedup_stage, estimates, near_duplicates, op3_near_duplicates, shingles, sketches, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, threshold=85):
    """(doc_id, n_shingles, component_id) on plain sets of words; pairs come from an inverted index."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at, parent = defaultdict(list), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            seen.update(at[x])
            at[x].append(i)
        for j in seen:
            if 100 * len(s & sets[j]) >= threshold * len(s | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op3_near_duplicates(spark, d)
    assert result(got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_a_bucket_with_several_components_is_tested_across(spark, docs):
    """Chains of edits: neighbours are similar, ends are not, so that hubs alone would miss links."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1000 - 7 * k, " ".join(base[: 8 * k] and [f"x{i}" for i in range(8 * k)] + base[8 * k :] or base)) for k in range(30)]
    rows += [(2000 + k, " ".join(base[:390] + [f"y{k}"] * 3)) for k in range(40)]
    assert result(near_duplicates(docs(rows))) == brute(rows)


def test_defined_cases(spark, docs, table_dir):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t "), (8, "one two"), (3, "ONE\x0btwo"), (8, "one two"), (None, "one  two"), (None, "alone here"), (9, long), (9, long + " end"), (10, "İ ß É one"), (11, "i ß é one")]
    df = docs(rows, ["key", "cid", "component_id", "band"])
    assert result(near_duplicates(df)) == brute(rows)
    left = dedup_stage(spark, df, "")  # one row of each group, rows without an id and with an equal one too
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [None, 10, 11, 3, 5, 6, 7, 9]))
    assert near_duplicates(docs([])).collect() == []


def test_registers_do_not_depend_on_the_bound_and_merge():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (700, 30))
    one, two, both = sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(one, two) == both).all()
    assert (sketches([b])[0] == two).all() and not sketches([a[:0]]).any()
    x = SCALE * BASE ** (1.0 - one.astype(float))
    assert abs(1 / x.mean() / 700 - 1) < 0.3


@pytest.mark.parametrize("j", [0.3, 0.6, 0.85, 0.95])
def test_estimates_follow_the_similarity(j):
    rng, errors, bands = np.random.default_rng(int(100 * j)), [], 0
    for _ in range(60):
        n = 400
        s = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        k = round(2 * n * j / (1 + j))
        a, b = s[:n], s[n - k : 2 * n - k]
        r = sketches([a, b])
        errors.append(estimates(r[:1], r[1:], np.array([n]), np.array([n]))[0] - k / (2 * n - k))
        bands += (band_hashes(r)[0] == band_hashes(r)[1]).any()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    assert j < 0.85 or bands == 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, schema(a=LONG, b=LONG)), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {200 + i: 200 for i in range(30)}


def test_words_are_lowered_in_ascii_only():
    assert words("ÀB Cd\x0be f") == ["Àb".encode(), b"cd", "e f".encode()] and len(shingles(words("a b c d e f"))) == 2


def test_the_stage_can_drop_copies_of_eighty_per_cent(spark, docs):
    """Forty pairs at exactly 0.80 and three below: the default keeps both of each, the stage at 80 % one of each of the forty."""
    word = lambda k: [f"k{k}w{i}" for i in range(94)]  # noqa: E731  90 shingles
    pairs = [(k, word(k)) for k in range(40)]
    rows = [(2 * k, " ".join(w)) for k, w in pairs] + [(2 * k + 1, " ".join(w[:84] + [f"k{k}x{i}" for i in range(10)])) for k, w in pairs]
    rows += [(1000 + 2 * k, " ".join(word(100 + k))) for k in range(3)] + [(1001 + 2 * k, " ".join(word(100 + k)[:83] + [f"k{k}y{i}" for i in range(11)])) for k in range(3)]
    left = sorted(r.doc_id for r in dedup_stage(spark, docs(rows), "", 80, 4).collect())
    assert left == [2 * k for k in range(40)] + list(range(1000, 1006))
    assert all(r.kept for r in near_duplicates(docs(rows)).collect())


def test_a_clean_row_stays_beside_a_copy_with_its_id(spark, docs):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(50))
    df = docs([(1, text(1)), (5, text(1) + " end"), (5, text(2)), (5, text(1).upper()), (7, text(2)), (8, None)], ["_gone", "_id", "text_hash"])
    left = dedup_stage(spark, df, "")
    assert left.columns == df.columns and sorted((r.doc_id, r.text) for r in left.where("text is not null").collect()) == [(1, text(1)), (5, text(2))]
    assert left.count() == 3


def test_one_row_of_each_group_stays_whatever_the_ids(spark, docs):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(1)), (None, text(1) + " end"), (4, text(2)), (4, text(2)), (4, text(2) + " end"), (2, text(3) + " x"), (None, text(3)), (7, text(4)), (None, None), (None, None), (3, ""), (3, "")] * 2
    left = dedup_stage(spark, docs(rows), "").collect()
    worded = [r for r in left if r.text]
    assert len(left) - len(worded) == 8 and sorted((str(r.doc_id), r.text.split()[0][:3]) for r in worded) == [("2", "t3w"), ("4", "t2w"), ("7", "t4w"), ("None", "t1w")]
    assert len({c for _, _, c in brute([(i, r.text) for i, r in enumerate(worded)], 80)}) == len(worded)


def test_the_sieve_lets_all_keys_through(spark):
    from conceptile.llm.common import sieve
    from pyspark.sql import functions as F

    keys = spark.range(0, 3000, 3).unionByName(spark.createDataFrame([(None,), (-7,), (2**62,)], "id long"))
    may_be = sieve(keys, "id")
    df = spark.range(-3000, 3000).unionByName(spark.createDataFrame([(None,), (2**62,)], "id long"))
    got = {r.id for r in df.where(may_be(F.col("id"))).collect()}
    want = {i for i in range(0, 3000, 3)} | {-7, 2**62}
    assert want <= got and len(got - want) < 20 and None not in got
    assert df.where(~may_be(F.col("id"))).count() == df.count() - len(got)
    assert df.where(sieve(keys.limit(0), "id")(F.col("id"))).count() == 0


def test_members_of_the_largest_component_are_not_dealt_against_each_other(spark):
    rows = [(1, i, 0 if i % 60 else i + 1, 10) for i in range(6000)] + [(2, i, i % 2, 10) for i in range(10)] + [(3, 7, 7, 10)]
    got = dealt_chunks(spark.createDataFrame(rows, "band long, cid long, root long, n_shingles long"), Scratch(spark)).collect()
    assert len([r for r in got if r.band == 1]) < 2 * 6000  # 24 copies of each when all chunks of a bucket met
    chunk, groups = {(r.band, r.cid): r.chunk for r in got}, defaultdict(set)
    for r in got:
        assert r.chunk in (r.lo, r.hi)
        groups[r.band, r.cid].add((r.lo, r.hi))
    for band, a, ra, _ in rows:
        if band == 2 or ra:
            for other, b, rb, _ in rows:
                if other == band and ra != rb:
                    x, y = chunk[band, a], chunk[band, b]
                    assert (min(x, y), max(x, y)) in groups[band, a] & groups[band, b]
