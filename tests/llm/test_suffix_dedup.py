"""Repeated passages found window by window in plain Python, against the shards' suffix arrays."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from conceptile.llm import suffix_dedup as D
from conceptile.llm.common import Scratch
from conceptile.llm.suffix_sorting import common_prefixes, suffix_array


def plain(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a dictionary of windows; rows of one id come in the order given."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def prose(rng, n, words=400):
    vocab = [f"{a}{b}" for a in ("ta", "re", "mi", "ño", "wé", "st", "lo") for b in ("n", "ra", "sil", "🙂", "e", "kt")]
    return " ".join(rng.choice(vocab) + str(rng.randrange(words)) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    phrase, passage = "a phrase of fifty bytes or so, in very many documents", prose(rng, 25)
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i % 7]) for i in range(30)]  # copies
    rows += [(200 + i, (t := texts[10 + i % 5])[: len(t) // 2] + "X" + t[len(t) // 2 :]) for i in range(20)]  # near copies
    rows += [(300 + i, prose(rng, 20) + " " + phrase + " " + prose(rng, 20)) for i in range(60)]
    rows += [(400 + i, prose(rng, 5) + passage[: 60 + 3 * i] + prose(rng, 5)) for i in range(40)]
    rows += [(500, "a" * 350), (501, "a" * 99), (502, "a" * 100), (503, "ab" * 120), (504, ""), (505, None), (506, texts[0] + texts[0]), (507, "short")]
    rows += [(None, texts[20]), (-5, texts[21]), (600, texts[22] * 3 + prose(rng, 3000)), (601, "\0" * 130 + "\0\1" * 80)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_repeats_equal_a_dictionary_of_windows(spark, docs, table_dir, rows):
    d = table_dir(documents=docs(rows, ["id", "th", "at", "h", "kept", "spans"]))
    found, want = got(D.op11_suffix_dedup(spark, d)), plain(rows)
    assert found == want and sum(r[2] > 0 for r in want) > 70


def test_sql_says_the_same(spark, docs, table_dir, rows):
    d = table_dir(documents=docs([r for r in rows if r[0] is not None]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert got(D.op11_suffix_dedup(spark, d)) == sorted(con.sql(D.SQL).fetchall(), key=str)


@pytest.mark.parametrize("contents, piece, shard", [(1, 1 << 17, 1 << 18), (5, 700, 2000), (1 << 10, 256, 1)])
def test_crowded_anchors_and_small_pieces_change_nothing(spark, docs, rows, contents, piece, shard):
    found = D.without_repeats(D.keyed(docs(rows)), Scratch(spark), contents=contents, piece=piece, shard=shard)
    changed = {r.id: (r.spans, bytes(r.kept)) for r in found.collect()}
    want = {(-(2**63) if d is None else d): n for d, _, n, _, _ in plain(rows)}
    assert {d: sum(s.end - s.start for s in spans) for d, (spans, _) in changed.items()} == {d: n for d, n in want.items() if n}


def test_pieces_overlap_by_a_window():
    text = bytes(range(256)) * 5
    parts = [p for some in D.pieces(iter([(1, 2, text), (2, 3, b"x" * 99), (3, 4, b"y" * 100)]), 100, 300) for p in some]
    windows = [(id_, at + i) for id_, _, at, b in parts for i in range(len(b) - 99)]
    assert windows == [(1, i) for i in range(len(text) - 99)] + [(3, 0)]


def test_repeated_rows_and_ids(spark, docs, table_dir):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, a), (2, a + b), (2, a + b), (3, b)]
    found = got(D.op11_suffix_dedup(spark, table_dir(documents=docs(rows))))
    want = plain([(1, a), (2, a + b), (3, b)])
    assert found == sorted([*want, *[w for w in want if w[0] in (1, 2)]], key=str)
    both = got(D.op11_suffix_dedup(spark, table_dir(documents=docs([(1, a), (1, b + a)]))))
    assert sorted(r[2] for r in both)[0] == 0 and sorted(r[2] for r in both)[1] >= len(a.encode())


def test_empty_table(spark, docs, table_dir):
    assert got(D.op11_suffix_dedup(spark, table_dir(documents=docs([])))) == []
    assert got(D.op11_suffix_dedup(spark, table_dir(documents=docs([(1, None), (2, "x")])))) == plain([(1, None), (2, "x")])


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    passage = prose(rng, 30).encode()
    texts = [prose(rng, 20).encode() + passage + prose(rng, 20).encode() for _ in range(2)]
    anchors = []
    for t in texts:
        data = np.frombuffer(t, dtype=np.uint8)
        h, _, start, many = D.segments(data, np.arange(len(data)) + 100 <= len(data))
        assert np.array_equal(start, np.cumsum(many) - many) and many.sum() == len(t) - 99
        at = t.index(passage)
        anchors.append(np.repeat(h, many)[at : at + len(passage) - 99])
    assert np.array_equal(*anchors)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_arrays_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    for k in range(150):
        n, symbols = int(rng.integers(1, 80)), int(rng.integers(1, 5 + 300 * (seed == 5)))
        t = rng.integers(0, symbols, n).astype(np.uint16)
        t = np.tile(t[: max(1, n // 4)], 5) if k % 3 == 0 else t
        x = t.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        sa = suffix_array(t, symbols)
        prefix = common_prefixes(t, sa)
        assert sa.tolist() == want
        for a, b in zip(want, want[1:], strict=False):
            m = 0
            while max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            assert prefix[b] == m
