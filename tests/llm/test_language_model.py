import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conceptile.llm import language_model as lm
from conceptile.llm.language_model import CLASSES, END, NEAR, SLOTS, Batch, Weights, counted, op5_language_model, scored, softmax, token_hashes, trained, vocabulary


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by row."""
    tokens = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in rows]
    held = lambda d: zlib.crc32(("null" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens]


def same(got, want):
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_whole_table_against_brute_force_and_better_than_unigrams(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = sorted(op5_language_model(spark, d).collect())
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_words_outside_the_head_are_joined(spark, docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 60))) for i in range(80)]
    df = docs(rows)
    assert len(vocabulary(counted(df)).hashes) <= head
    same(sorted(scored(df, rounds=1).collect()), brute(rows))


def test_the_model_is_a_distribution(spark, docs):
    """Over all known words and one unknown for each far class, probabilities in a context add up to 1."""
    df = docs([(i, " ".join(f"v{(i * k * k) % 701}" for k in range(1, 200))) for i in range(60)])
    counts = counted(df)
    known = vocabulary(counts)
    w = Weights(known, trained(df, known, 1))
    h = np.array([r.h for r in counts.collect()], dtype=np.int64).view(np.uint64)
    context = token_hashes("v1 v2")[:-1]
    b = Batch(known, [np.append(context, x) for x in h])
    p = w.log10s(b)[2::3] + np.where(b.slot[2::3] < 0, known.logs[b.at[2::3]], 0)
    far = w.classes(Batch(known, [np.append(context, END)]), slice(2, 3))[0, NEAR:] * 0.1 / 10**known.class_logs
    assert (10**p).sum() + far.sum() == pytest.approx(1, abs=1e-3)


def test_gradient_steps_raise_the_likelihood(spark, docs):
    df = docs([(i, "a b c d e f g " * 30) for i in range(30)])
    known = vocabulary(counted(df))
    b = Batch(known, [token_hashes("a b c d e f g " * 30)])
    assert Weights(known, trained(df, known, 2)).log10s(b).sum() > 0.5 * Weights(known).log10s(b).sum()


def test_defined_cases(spark, docs):
    rows = [(None, None), (1, ""), (2, "one Two\x0btwo"), (2, "one Two\x0btwo"), (3, "long " * 60_000), (20, "only held"), (24, "x")]
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(scored(docs(rows, ["row", "h", "n", "base"])).collect(), key=key)
    same(got, brute(sorted(rows, key=key)))
    assert scored(docs([])).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    same(scored(docs([(held, "a b")])).collect(), brute([(held, "a b")]))


def test_softmax_is_stable():
    assert np.allclose(softmax(np.array([[1e4, 0.0], [0.0, 0.0]])), [[1, 0], [0.5, 0.5]]) and CLASSES == SLOTS


def test_the_tree_is_prefix_free_and_its_shares_are_those_of_the_counts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 15, 3000):
        counts = rng.zipf(1.3, n).clip(1, 10**6).astype(np.int64)
        start, depth, nodes, digits, shares = lm.tree(counts, np.full(lm.FAR, 0.1))
        paths = [tuple(zip(nodes[a : a + d].tolist(), digits[a : a + d].tolist())) for a, d in zip(start, depth, strict=True)]
        assert len(set(paths)) == n + lm.FAR and not any(p[:k] in set(paths) for p in paths for k in range(1, len(p)))
        assert all(p[0][0] == 0 for p in paths) and {p[0][1] for p in paths[n:]} == set(range(NEAR, CLASSES))
        got = [math.exp(sum(shares[i, d] for i, d in p)) for p in paths]
        want = np.append(counts, np.full(lm.FAR, 0.1)) / (counts.sum() + 0.1 * lm.FAR)
        assert got == pytest.approx(list(want), rel=1e-4)


def test_contexts_choose_rare_words(spark, docs):
    """Of 4,000 words of one count each follows one other: without features in their softmaxes all would cost the same."""
    rows = [(i, " ".join(f"a{k} b{k}" for k in range(i % 40, 4000, 40))) for i in range(400)]
    known = vocabulary(counted(docs(rows)))
    w = Weights(known, trained(docs(rows), known, 2))
    b = Batch(known, [token_hashes(f"a{k} b{k}") for k in range(0, 4000, 7)])
    cost = w.log10s(b).reshape(-1, 3)
    assert cost[:, 1].mean() > cost[:, 0].mean() + 0.8


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 5000])
def test_places_are_found_by_the_first_bits(n):
    """About one hash lies in a bucket, so that a word is looked up in few steps; equal first bits only take more of them."""
    rng = np.random.default_rng(n)
    far = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    h = np.unique(np.append(rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(n // 100, dtype=np.uint64)))
    v = lm.Vocabulary(1, 1, h, *[np.zeros(0)] * 8)
    asked = np.concatenate([h, far, np.array([0, 1, 2**64 - 1], dtype=np.uint64)])
    known = {x: i for i, x in enumerate(h.tolist())}
    at, path = v.place(asked)
    assert at.tolist() == [known.get(x, -1) for x in asked.tolist()]
    assert path.tolist() == [known.get(x, len(h) + (x >> 62)) for x in asked.tolist()]
    if n:
        assert v.buckets[2] <= 12 + n // 100 and len(v.buckets[1]) <= 4 * len(h) + 2


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    """Only words of more than 64 bytes are hashed one by one; equal words, and no others, have equal hashes in all texts."""
    alone = []
    monkeypatch.setattr(lm, "word_hashes", lambda ws, f=lm.word_hashes: alone.extend(ws) or f(ws))
    rng = np.random.default_rng(3)
    parts = ["a", "B", "é", "Ж", "漢", "\0", "\x1c", "\x85", "\xa0", " ", "İ", "K", " ", "\t", "\n", "\x0b", "\r", *(c * n for c in "yz" for n in (7, 8, 9, 16, 63, 64, 65, 200))]
    texts = [None, "", " ", *("".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)), None, "last"]
    utf8 = [None if t is None else t.encode() for t in texts]
    want = [(t or b"").lower().split() + [None] for t in utf8]
    for kind in (pa.string(), pa.large_string()):
        for at, size in ((0, 400), (1, 70), (100, 130)):
            got = lm.tokens_of(pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"]).slice(at, size))
            assert [len(h) for h in got] == [len(w) for w in want[at : at + size]]
            pairs = {(w, h) for ws, hs in zip(want[at:], got) for w, h in zip(ws, hs.tolist(), strict=True)}
            assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) and all(h == END for w, h in pairs if w is None)
    assert alone and all(len(w) > 64 for w in alone)
    assert [h.tolist() for h in lm.hashed(utf8)] == [token_hashes(t).tolist() for t in texts]


def test_a_step_moves_each_row_by_the_sum_of_its_errors():
    """Against a loop over rows, where some are met once, some often, and some by several features; others stay as they are."""
    rng = np.random.default_rng(4)
    v = lm.Vocabulary(4 * lm.BLOCK, 1, *[np.zeros(0)] * 9)
    w = Weights(v, rng.normal(size=(v.rows, SLOTS)).astype(np.float32))
    for n, least in ((5000, 0), (1, 0), (3, v.rows - 1)):
        before, squares, touched = w.rows.copy(), w.squares.copy(), w.touched.copy()
        met = np.maximum((v.rows * rng.random((3, n)) ** 4).astype(np.int64), least)
        error = rng.normal(size=(n, SLOTS)).astype(np.float32)
        w.descend(met, error.copy())
        for row in np.unique(met):
            g = sum(error[m == row].sum(axis=0, dtype=np.float64) for m in met)
            squares[row] += (g @ g) / SLOTS
            touched[row] += (met == row).sum()
            before[row] -= lm.RATE / np.sqrt(squares[row]) * g
        assert np.allclose(w.rows, before, rtol=1e-4, atol=1e-4) and np.allclose(w.squares, squares, rtol=1e-4) and (w.touched == touched).all()
