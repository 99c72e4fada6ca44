import pytest
from conceptile.operators.evaluate import best_cell, pearson, spearman, tune
from conceptile.operators.index import build_index
from conceptile.streaming.score import score_stream


def pairs(spark, x, y):
    return spark.createDataFrame(list(zip(x, y, strict=True)), "human double, score double")


@pytest.mark.parametrize(("x", "y", "p", "s"), [([1, 2, 2, 3], [10, 30, 20, 40], 0.948683, 0.948683), ([1, 2, 2, 10], [10, 30, 20, 40], 0.831261, 0.948683)])
def test_correlations(spark, x, y, p, s):
    df = pairs(spark, map(float, x), map(float, y))
    assert (round(pearson(df).first()[0], 6), round(spearman(df).first()[0], 6)) == (p, s)


def test_grid(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} common x{i}") for i in range(40)], "doc_id long, text string")
    texts = spark.createDataFrame([(i, f"w{i} w{i % 3}") for i in range(5)], "item_id long, text string")
    gold = spark.createDataFrame([(a, b, 1.0 / (b - a)) for a in range(5) for b in range(a + 1, 5)], "a long, b long, human double")
    grid = tune(gold, texts, build_index(docs), [2, 5], [0.1, 0.5])
    rows = grid.collect()
    assert {(r.window, r.drop_off) for r in rows} == {(2, 0.1), (2, 0.5), (5, 0.1), (5, 0.5)}
    assert best_cell(grid).first().pearson == max(r.pearson for r in rows)


def test_stream_is_scored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat sat mat cat"), (2, "dog sat log"), (3, "cat dog bird bird bird")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = score_stream(stream, build_index(docs), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    got = {r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1, 2, 3}
