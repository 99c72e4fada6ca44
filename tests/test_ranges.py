"""Ranks, windows and nearest vectors over ranges of rows, against plain Python."""

import random

import pytest
from conceptile.operators import vectors
from conceptile.operators.evaluate import until_falling
from conceptile.operators.index import impact_ordered
from conceptile.operators.staging import numbered
from conceptile.operators.vectors import pruned_cells, prune_window, related
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small ranges are not joined here."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def postings(spark):
    """One term with nearly all rows, so that it lies in several ranges; scores repeat."""
    rng = random.Random(3)
    rows = [(i, "hot", round(rng.random() ** 3, 2)) for i in range(600)] + [(i, f"t{i % 9}", round(rng.random(), 2)) for i in range(60)] + [(1, "one", 0.5)]
    return rows, spark.createDataFrame(rows, "doc_id long, term string, score double").repartition(5)


def by_term(rows):
    out = {}
    for d, t, s in rows:
        out.setdefault(t, []).append((-s, d))
    return {t: [(d, -s) for s, d in sorted(v)] for t, v in out.items()}


def test_ranks_cross_ranges(spark, postings):
    rows, df = postings
    want = {(t, d): i for t, v in by_term(rows).items() for i, (d, _) in enumerate(v, 1)}
    assert {(r.term, r.doc_id): r.rank for r in impact_ordered(df).collect()} == want
    parts = numbered(df, ["term"], [F.desc("score"), "doc_id"]).where("term = 'hot'").select("_part").distinct().count()
    assert parts > 1


@pytest.mark.parametrize(("window", "drop"), [(1, 0.0), (3, 0.01), (50, 0.02), (200, 0.3), (500, 0.9), (599, 2.0), (0, 0.1)])
def test_pruning_crosses_ranges(postings, window, drop):
    rows, df = postings
    want = set()
    for t, v in by_term(rows).items():
        for i, (d, s) in enumerate(v):
            want.add((t, d))
            if window and i + window < len(v) and s - v[i + window][1] < s * drop:
                break
    assert {(r.term, r.doc_id) for r in prune_window(df, window, drop).collect()} == want


def test_cells_are_pruned_at_once(postings):
    rows, df = postings
    cells = [(3, 0.01), (50, 0.02), (0, 0.5), (3, 0.2)]
    got = pruned_cells(df, cells).collect()
    for i, (w, d) in enumerate(cells):
        assert {(r.term, r.doc_id) for r in got if i in r.cells} == {(r.term, r.doc_id) for r in prune_window(df, w, d).collect()}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_nearest_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "PAIRS", 12)
    rng = random.Random(1)
    vecs = {i: {c: rng.choice([-1.0, 0.5, 2.0]) for c in rng.sample(range(12), rng.randint(1, 5))} for i in range(40)} | {50: {3: 0.0}, 51: {99: 1.0}}
    df = spark.createDataFrame([(i, c, w) for i, v in vecs.items() for c, w in v.items()], "id long, concept int, weight double")
    ids = [i for i in vecs if i % 5 == 0 or i == 51]
    got = {}
    for r in related(df, spark.createDataFrame([(i,) for i in ids], "id long"), 6, block=block).collect():
        got.setdefault(r.id, []).append((r.other, r.cosine))
    norm = lambda v: sum(w * w for w in v.values()) ** 0.5
    for i in ids:
        all_ = []
        for j, v in vecs.items():
            if j != i and set(v) & set(vecs[i]):
                n = norm(v) * norm(vecs[i])
                all_.append((j, sum(w * vecs[i][c] for c, w in v.items() if c in vecs[i]) / n if n else None))
        want = sorted(all_, key=lambda x: (x[1] is None, -round(x[1] or 0, 9), x[0]))[:6]
        mine = sorted(got.get(i, []), key=lambda x: (x[1] is None, -round(x[1] or 0, 9), x[0]))
        assert [(j, c if c is None else round(c, 9)) for j, c in mine] == [(j, c if c is None else round(c, 9)) for j, c in want]


def test_a_row_that_falls_is_left(spark):
    rows = [(1, float(i), 1.0 - i / 100) for i in range(15)] + [(2, float(i), i / 100) for i in range(15)] + [(3, float(i), 1.0 - i / 100 + (i % 4 == 0) * 0.2) for i in range(15)]
    left = until_falling(spark.createDataFrame(rows, "window int, drop_off double, pearson double")).collect()
    assert [sum(r.window == w for r in left) for w in (1, 2, 3)] == [10, 15, 15]


@pytest.mark.parametrize("longest", [5, 1 << 16])
def test_what_cannot_stay_is_not_ranked(spark, postings, monkeypatch, longest):
    """Few rows of a frequent term are in reach; lists of any length give the same, ranked by one task or in ranges."""
    rows, df = postings
    frequent = df.unionByName(spark.range(5000).selectExpr("id as doc_id", "'the' as term", "round(1 / (1 + id % 97), 4) as score"))
    assert vectors.in_reach(frequent, [(5, 0.05)])[0].where("term = 'the'").count() < 500
    odd = spark.createDataFrame([(i, "odd", s) for i, s in enumerate([float("nan"), 3.0, 3.0, 3.0, 0.0, -1.0, None, float("inf"), 2.9, 2.9])], df.schema)
    monkeypatch.setattr(vectors, "LIST", longest)
    for w, d in ((2, 0.1), (5, 0.05), (2, 0.0)):
        both = frequent.unionByName(odd)
        got = sorted((r.term, r.doc_id) for r in prune_window(both, w, d).collect())
        assert got == sorted((r.term, r.doc_id) for r in vectors.ranged_cells(both, [(w, d)], "term").collect())
