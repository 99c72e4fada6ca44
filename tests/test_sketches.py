import random

import pytest
from conceptile.operators import sketches as K
from conceptile.operators.analyze import term_counts
from conceptile.operators.index import document_frequency
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def counts(spark, sf_dir):
    return term_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "term").cache()


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_samples_are_equal_after_any_split(spark, counts, parts):
    whole = document_frequency(counts)
    rows = lambda df: sorted(map(tuple, df.collect()))
    split = [K.sample(document_frequency(counts.where(F.pmod(F.hash("doc_id"), F.lit(parts)) == i)), 256) for i in range(parts)]
    out = split[0]
    for s in split[1:]:
        out = out.unionByName(s)
    assert rows(K.merged(out, 256)) == rows(K.sample(whole, 256))


@pytest.mark.parametrize("k", [64, 1024, 1 << 20])
def test_estimates_lie_within_their_errors(counts, k):
    df = document_frequency(counts)
    terms, rare = df.count(), df.where("df < 3").count()
    got = K.estimated(K.sample(df, k), 3, k).first()
    assert abs(got.terms - terms) <= got.terms_error + 1e-9 and abs(got.rare - rare) <= got.rare_error + 1e-9
    assert got.exact == (k > terms) and (not got.exact or got.rare_error == 0)


def test_heavy_terms_lie_within_their_bounds(spark):
    rng = random.Random(4)
    parts = [{f"t{int(40 * rng.random() ** 3)}": rng.randrange(1, 50) for _ in range(60)} for _ in range(5)]
    true = {}
    frames = None
    for i, p in enumerate(parts):
        for t, n in p.items():
            true[t] = true.get(t, 0) + n
        one = K.heavy(spark.createDataFrame(list(p.items()), "term string, df long"), f"p{i}", 10)
        frames = one if frames is None else frames.unionByName(one)
    got = {r.term: (r.least, r.most) for r in K.heaviest(frames, 100).collect()}
    assert all(lo <= true[t] <= hi for t, (lo, hi) in got.items())
    floors = sum(r.floor for r in frames.groupBy("part").agg(F.max("floor").alias("floor")).collect())
    assert all(n <= floors for t, n in true.items() if t not in got)


def test_no_terms(spark):
    none = spark.createDataFrame([], "term string, df long")
    assert K.estimated(K.sample(none), 3).first().terms == 0 and K.heaviest(K.heavy(none, "a"), 3).count() == 0
