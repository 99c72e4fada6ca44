"""A database in memory: batches go in, ranges come out."""

import pytest
from conceptile.sources import files as S


@pytest.fixture(scope="module")
def options():
    return {"url": "jdbc:derby:memory:scores;create=true"}


def test_scores_in_and_out(spark, options):
    rows = [(t, d, round(1.0 / (d + 1) + len(t), 6)) for t in ("cat", "mat") for d in range(50)]
    df = spark.createDataFrame(rows, "term string, document long, score double")
    S.write_jdbc(df.repartition(3), "scores", options | {"createTableColumnTypes": "term VARCHAR(64)"}, batch=7)
    S.write_jdbc(df.limit(0), "scores", options)
    for read in (S.read_jdbc(spark, "scores", options), S.read_jdbc(spark, "scores", options, "document", parts=5), S.read_jdbc(spark, "scores", options, "document", (10, 20), 3)):
        assert sorted(map(tuple, read.collect())) == sorted(rows)
    assert S.read_jdbc(spark, "scores", options, "document", parts=5).rdd.getNumPartitions() == 5
    best = S.ordered_scores(S.read_jdbc(spark, "scores", options), "cat", 3).collect()
    assert [(r.term, r.document) for r in best] == [("cat", 0), ("cat", 1), ("cat", 2)]


def test_an_empty_table(spark, options):
    S.write_jdbc(spark.createDataFrame([], "document long, score double"), "nothing", options)
    assert S.read_jdbc(spark, "nothing", options, "document", parts=4).count() == 0
