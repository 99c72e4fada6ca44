"""Vectors by key, and texts that are projected once."""

import pytest
from conceptile.functions.weights import WeightSpec
from conceptile.operators.analyze import AnalyzerSpec
from conceptile.operators.index import build_index
from conceptile.operators.memo import VectorMemo
from conceptile.operators.vectors import PruneSpec, concept_vectors, query_weights
from conceptile.sources.vector_store import VectorStore
from pyspark.sql import Observation
from pyspark.sql import functions as F

LONG = "id string, concept long, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def store(spark, tmp_path):
    return VectorStore(spark, f"file://{tmp_path}/vectors", buckets=8)


def test_the_last_write_counts(spark, store):
    first = [(f"v{i}", c, float(i + c)) for i in range(30) for c in (3, 1, 2)]
    again = [(f"v{i}", 9, -1.0) for i in range(0, 30, 4)]
    assert rows(store.read()) == [] and store.write(spark.createDataFrame(first, LONG), "a")
    assert rows(store.read()) == sorted(first)
    assert store.write(spark.createDataFrame(again, LONG), "b") and not store.write(spark.createDataFrame(first, LONG), "b")
    want = sorted(again + [r for r in first if int(r[0][1:]) % 4])
    assert rows(store.read()) == want
    store.delete(spark.createDataFrame([("v0",), ("v1",), ("none",)], "id string"), "c")
    want = [r for r in want if r[0] not in ("v0", "v1")]
    assert rows(store.read()) == want
    assert store.compact("m") and rows(store.read()) == want and [c.name for c in store.log.live()] == ["m"]
    store.write(spark.createDataFrame([("v1", 5, 5.0)], LONG), "d")
    assert rows(store.read()) == sorted([*want, ("v1", 5, 5.0)])


def test_a_look_up_reads_its_buckets(spark, store, tmp_path):
    store.write(spark.createDataFrame([(f"v{i}", 1, float(i)) for i in range(100)], LONG), "a")
    got = store.look_up(spark.createDataFrame([("v7",), ("v7",), ("nobody",)], "id string"))
    assert [(r.id, r.c, r.w) for r in got.collect()] == [("v7", [1], [7.0])]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # files of other buckets may be broken
    bucket = spark.createDataFrame([("v7",)], "id string").select(store.bucket(F.col("id")).alias("b")).first().b
    for f in (tmp_path / "vectors/batch=a").glob("bucket=*/*.parquet"):
        if f"bucket={bucket}/" not in str(f):
            f.write_bytes(b"broken")
    assert [r.id for r in store.look_up(spark.createDataFrame([("v7",)], "id string")).collect()] == ["v7"]


def test_a_failed_batch_is_written_again(spark, store, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(store.log, "add", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], LONG), "x")
    assert rows(store.read()) == []
    assert store.write(spark.createDataFrame([("a", 2, 2.0)], LONG), "x") and rows(store.read()) == [("a", 2, 2.0)]


DOCS = [(1, "cat sat mat cat"), (2, "dog sat log"), (3, "cat dog bird bird bird")]


def test_texts_are_projected_once(spark, store):
    index = build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))
    texts = lambda *t: spark.createDataFrame(list(enumerate(t)), "item_id int, text string")

    def asked(memo, df):
        seen = Observation()
        got = {(r.item_id, r.doc_id): round(r.score, 9) for r in memo.vectors(df, counter=seen).collect()}
        plain = concept_vectors(query_weights(df, index, memo.index.weights), index.postings, memo.prune)
        assert got == {(r.item_id, r.doc_id): round(r.score, 9) for r in plain.collect()}
        return seen.get["projected"]

    memo = VectorMemo(store, index, "v1")
    assert asked(memo, texts("cat", "dog sat", "cat", "zebra", None, "")) == 4
    assert asked(memo, texts("zebra", "cat", "")) == 0
    assert asked(memo, texts("bird", "cat")) == 1
    assert asked(VectorMemo(store, index, "v1"), texts("bird", "dog sat")) == 0
    assert asked(VectorMemo(store, index, "v2"), texts("bird")) == 1
    assert asked(VectorMemo(store, index, "v1", PruneSpec(limit=1)), texts("bird")) == 1
    keys = {VectorMemo(store, build_index(spark.createDataFrame(DOCS, "doc_id long, text string"), a, w), "v1").options for a in (AnalyzerSpec(), AnalyzerSpec(stop_words=frozenset({"a", "b"}))) for w in (WeightSpec(), WeightSpec("nnn"))}
    assert len(keys) == 4


def test_last_vectors_are_chosen_by_ids_alone(spark, tmp_path):
    from conceptile.sources.vector_store import VectorStore

    store = VectorStore(spark, f"file://{tmp_path}/s", buckets=2)
    for name, w in (("a", 1.0), ("b", 2.0)):
        store.write(spark.createDataFrame([("x", 1, w), ("x", 2, w), (name, 3, w)], "id string, concept long, weight double"), name)
    assert sorted(map(tuple, store.read().collect())) == [("a", 3, 1.0), ("b", 3, 2.0), ("x", 1, 2.0), ("x", 2, 2.0)]
    assert "max_by" not in store.packed()._jdf.queryExecution().optimizedPlan().toString()
