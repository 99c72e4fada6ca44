"""Early ends over stored blocks equal the whole vectors' best, and read less; pruning by stored ranks equals ranks made anew."""

import random

import pytest
from conceptile.operators.impact import ImpactIndex
from conceptile.operators.vectors import concept_vectors, prune_window, top
from pyspark.sql import Observation


@pytest.fixture(scope="module")
def postings(spark):
    """Terms of very different lengths; few documents stand out."""
    rng = random.Random(8)
    rows = []
    for t, n, power in (("the", 3000, 9), ("cat", 900, 5), ("sat", 900, 1), ("rare", 3, 1), ("flat", 400, 0)):
        rows += [(d, t, round(0.01 + rng.random() ** power, 3)) for d in rng.sample(range(4000), n)]
    return spark.createDataFrame(rows, "doc_id long, term string, score double").repartition(5).cache()


@pytest.fixture(scope="module", params=[7, 64, 5000])
def index(request, spark, postings, tmp_path_factory):
    return ImpactIndex.save(postings, f"file://{tmp_path_factory.mktemp('impact')}/i", size=request.param, parts=8)


QUERIES = [(1, "the", 1.0), (2, "the", 0.5), (2, "cat", 0.9), (3, "rare", 1.0), (3, "cat", 0.001), (4, "flat", 1.0), (4, "the", 0.2), (5, "none", 1.0), (6, "cat", 0.0), (7, "the", 0.1), (7, "cat", 0.2), (7, "sat", 0.3), (7, "flat", 0.4), (7, "rare", 0.5), (8, "sat", float("nan"))]


@pytest.mark.parametrize("limit", [1, 10, 700])
def test_best_equal_the_whole_vectors_best(spark, postings, index, limit):
    weights = spark.createDataFrame(QUERIES, "item_id long, term string, score double")
    rows = lambda df: sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(index.best(weights, limit)) == rows(top(concept_vectors(weights, postings), limit, digits=9))


def test_fewer_blocks_are_read(spark, postings, index):
    seen = Observation("blocks")
    weights = spark.createDataFrame([q for q in QUERIES if q[0] in (1, 2, 3)], "item_id long, term string, score double")
    index.best(weights, 10, counter=seen).collect()
    got = seen.get
    if index.size == 7:
        assert got["blocks_read"] < got["blocks"] / 4
    assert got["blocks_read"] <= got["blocks"]


@pytest.mark.parametrize(("window", "drop"), [(1, 0.01), (5, 0.05), (7, 0.5), (3, 0.0)])
def test_pruning_by_stored_ranks(postings, index, window, drop):
    rows = lambda df: sorted((r.term, r.doc_id, r.score) for r in df.collect())
    assert rows(index.pruned(window, drop)) == rows(prune_window(postings, window, drop))


def test_levels_halve_what_a_look_into_them_reads(spark, postings, index):
    by_level = {r.level: r["count"] for r in index.postings.groupBy("level").count().collect()}
    assert sum(by_level.values()) == postings.count() and by_level[0] <= 5 * index.size
    plan = index.read(spark.createDataFrame([(1, "the", 1.0, 0, 0)], "item_id long, term string, q double, block long, level int"), "item_id")._jdf.queryExecution().toString()
    assert "level" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan or "EqualTo(term" in plan


def test_an_empty_index_and_no_queries(spark, postings, index, tmp_path):
    weights = spark.createDataFrame([], "item_id long, term string, score double")
    assert index.best(weights, 5).count() == 0
    none = ImpactIndex.save(postings.limit(0), f"file://{tmp_path}/i")
    assert none.best(spark.createDataFrame(QUERIES, weights.schema), 5).count() == 0 and none.pruned(3, 0.1).count() == 0


def test_long_lists_are_ranked_in_ranges_and_postings_not_written_twice(spark, postings, tmp_path, monkeypatch):
    from conceptile.operators import impact

    monkeypatch.setattr(impact, "LIST", 500)
    index = ImpactIndex.save(postings, f"file://{tmp_path}/i", size=64, forward=postings)
    assert not (tmp_path / "i" / "forward").exists()
    rows = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert rows(index.pruned(5, 0.05)) == rows(prune_window(postings, 5, 0.05))
    weights = spark.createDataFrame([(7, "the", 0.1), (7, "cat", 0.2), (7, "sat", 0.3), (7, "rare", 0.5)], "item_id long, term string, score double")
    near = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert near(index.best(weights, 10)) == near(top(concept_vectors(weights, postings), 10, digits=9))
