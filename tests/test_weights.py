import math
from collections import Counter

import pytest
from conceptile.functions.weights import WeightSpec, bm25, true_bm25_idf
from conceptile.operators import analyze as A
from conceptile.operators import index as I
from conceptile.operators.analyze import AnalyzerSpec, lemmatised, only_terms, term_counts, without_terms
from conceptile.operators.index import Index, build_index, impact_ordered
from conceptile.operators.vectors import PruneSpec, concept_vectors, cosines, prune_window, query_weights, top, weighted_query
from pyspark.sql import functions as F

DOCS = [(1, "cat sat mat cat"), (2, "dog sat log"), (3, "cat dog bird bird bird")]
QUERIES = [(1, "cat"), (2, "dog sat"), (3, "bird zebra"), (4, "bird"), (5, "zebra"), (6, "")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def vectors(spark, index):
    return concept_vectors(query_weights(spark.createDataFrame(QUERIES, "item_id long, text string"), index), index.postings)


def test_postings_of_three_documents(index):
    got = {(r.doc_id, r.term): round(r.score, 6) for r in index.postings.collect()}
    assert got == {(1, "cat"): 0.381413, (1, "mat"): 0.867226, (1, "sat"): 0.320067, (2, "dog"): 0.327185, (2, "log"): 0.886510, (2, "sat"): 0.327185, (3, "bird"): 0.926010, (3, "cat"): 0.266932, (3, "dog"): 0.266932}
    assert [r.rank for r in impact_ordered(index.postings).where("term = 'sat'").orderBy("rank").collect()] == [1, 2]


def test_vectors_and_cosines(spark, vectors):
    got = {(r.item_id, r.doc_id): round(r.score, 6) for r in vectors.collect()}
    assert got == {(1, 1): 0.381413, (1, 3): 0.266932, (2, 1): 0.226322, (2, 2): 0.462709, (2, 3): 0.188749, (3, 3): 0.926010, (4, 3): 0.926010}
    pairs = spark.createDataFrame([(1, 2), (1, 4), (2, 2), (1, 5), (1, 6)], "a long, b long")
    cos = {(r.a, r.b): r.cosine for r in cosines(pairs, vectors).collect()}
    assert (round(cos[1, 2], 6), round(cos[1, 4], 6), round(cos[2, 2], 6)) == (0.535281, 0.573379, 1.0) and math.isnan(cos[1, 5]) and math.isnan(cos[1, 6])
    assert {(r.item_id, r.doc_id) for r in top(vectors, 1).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}


@pytest.mark.parametrize(("letter", "raw", "saturated"), [("n", 3, 2.017241), ("l", 2.098612, 1.838784), ("a", 0.875, 1.365169), ("b", 1, 1.436170), ("L", 1.493180, 1.655395)])
def test_term_frequencies(spark, letter, raw, saturated):
    at = [F.lit(x) for x in (3, 4, 1.5, 10, 8.0)]
    row = spark.range(1).select(WeightSpec(letter + "nn", saturate=False).tf(*at).alias("raw"), WeightSpec(letter + "nn").tf(*at).alias("x")).first()
    assert (round(float(row.raw), 6), round(row.x, 6)) == (raw, saturated)


@pytest.mark.parametrize(("letter", "df", "want"), [("n", 5, 1), ("t", 5, 2.995732), ("p", 5, 2.944439), ("b", 5, 2.910372), ("p", 60, 0), ("p", 100, 0), ("t", None, 0)])
def test_document_frequencies(spark, letter, df, want):
    assert round(spark.range(1).select(WeightSpec("n" + letter + "n").idf(F.lit(100), F.lit(df).cast("long"))).first()[0], 6) == want


def test_linear_idf_and_saturation(spark):
    assert spark.range(1).select(true_bm25_idf(F.lit(100), F.lit(5)), bm25(F.lit(1.0), F.lit(8), F.lit(8.0))).first()[:] == (19.0, 1.5)


@pytest.mark.parametrize("mode", ["lt", "ltcc", "xtc", "lxc", "ltu", ""])
def test_unknown_schemes(mode):
    with pytest.raises(ValueError):
        WeightSpec(mode)


def test_cosine_norm_gives_unit_vectors_and_drops_documents_of_zeros(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "a"), (4, "a A a")], "doc_id long, text string")
    got = build_index(df).postings.groupBy("doc_id").agg(F.sum(F.col("score") * F.col("score")).alias("s")).collect()
    assert {r.doc_id: round(r.s, 9) for r in got} == {1: 1.0, 2: 1.0}


@pytest.mark.parametrize(("window", "kept"), [(2, 3), (0, 6), (6, 6)])
def test_prune_window(spark, window, kept):
    df = spark.createDataFrame([(i, "t", s) for i, s in enumerate([10.0, 9.5, 6.0, 5.9, 5.8, 1.0])], "doc_id long, term string, score double")
    assert sorted(r.doc_id for r in prune_window(df, window, 0.1).collect()) == list(range(kept))


def test_vector_limit_and_saved_index(spark, index, vectors, tmp_path):
    index.save(str(tmp_path / "i"), 3)
    back = Index.load(spark, str(tmp_path / "i"))
    weights = query_weights(spark.createDataFrame(QUERIES, "item_id long, text string"), back)
    assert sorted(concept_vectors(weights, back.postings).collect()) == sorted(vectors.collect())
    assert concept_vectors(weights, back.postings, PruneSpec(limit=1)).count() == 4


def test_weighted_query(spark, index):
    q = spark.createDataFrame([(1, "a b a")], "item_id long, text string")
    s = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.5)], "item_id long, term string, score double")
    assert weighted_query(q, s, index).first().query == "a^0.5 b^0.5 a^0.5"


def test_analyzer_order(spark):
    spec = AnalyzerSpec(ascii=True, singular=True, min_length=3, stop_words=frozenset(["The", "cat"]), dictionary=frozenset(["cat", "pony", "bus", "elan", "the"]))
    text = "The cats, ponies; BUS élan élans xy dogs"
    assert spark.createDataFrame([(text,)], "t string").select(spec.tokens(F.col("t"))).first()[0] == ["pony", "bus", "elan", "elan"]


def test_lists_that_are_joined(spark):
    counts = term_counts(spark.createDataFrame([(1, "mice mouse ran the"), (2, "the the")], "doc_id long, text string"))
    lemmas = spark.createDataFrame([("mice", "mouse", "NNS"), ("ran", "run", "VBD")], "term string, lemma string, pos string")
    flat = lambda df: sorted((r.doc_id, r.term, r.tf, r.dl) for r in df.collect())
    assert flat(lemmatised(counts, lemmas, ("N",))) == [(1, "mouse", 2, 4), (1, "ran", 1, 4), (1, "the", 1, 4), (2, "the", 2, 2)]
    the = spark.createDataFrame([("the",)], "term string")
    assert flat(without_terms(counts, the)) == [(1, "mice", 1, 3), (1, "mouse", 1, 3), (1, "ran", 1, 3)]
    assert flat(only_terms(counts, the)) == [(1, "the", 1, 1), (2, "the", 2, 2)]


@pytest.mark.parametrize("mode", ["ltc", "atb", "Lpn", "bbc"])
def test_weights_by_document_equal_those_over_all_counts(spark, sf_dir, monkeypatch, mode):
    """Frequent terms don't leave their documents, others are joined; documents without an id and ids that repeat are one group each."""
    from conceptile.operators import index as I
    from conceptile.operators.analyze import packed_counts, unpacked_counts

    monkeypatch.setattr(I, "HEAD", 40)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(None, "a b"), (None, "b c the"), (1, "twice the same id"), (9**9, ""), (9**9 + 1, None)], "doc_id long, text string"))
    packed = packed_counts(docs).cache()
    counts, stats = unpacked_counts(packed), I.packed_stats(packed)
    df = I.document_frequency(counts)
    assert 0 < I.head_of(df)[0].count() <= 40
    spec = WeightSpec(mode)
    rows = lambda x: sorted((str(r.doc_id), r.term, round(r.score, 9), r.blocks) for r in x.collect())
    assert rows(I.document_weights(packed, df, stats, spec)) == rows(I.weighted(counts, df, stats, spec))


def test_frequent_terms_are_not_shuffled_for_the_weights(spark, sf_dir):
    from conceptile.operators.index import build_index

    plan = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).postings._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [1 << 14, 0])
def test_cosines_of_few_and_of_many_pairs(spark, monkeypatch, few):
    from conceptile.operators import vectors as V

    monkeypatch.setattr(V, "FEW", few)
    data = [(1, 1, 1.0), (1, 2, 2.0), (2, 2, 3.0), (2, 3, 4.0), (3, 9, 1.0), (5, 7, float("inf")), (5, 1, 1.0)]
    v = spark.createDataFrame(data, "item_id long, doc_id long, score double").repartition(3)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 1), (1, 8), (1, 5), (3, 5)], "a long, b long")
    got = {(r.a, r.b): r.cosine if r.cosine is None else round(r.cosine, 9) for r in V.cosines(pairs, v).collect()}
    assert got[1, 2] == got[2, 1] == round(6 / 5 / 5**0.5, 9) and got[1, 3] == 0 and got[1, 1] == 1 and str(got[1, 8]) == "nan"
    assert got[1, 5] == got[3, 5] == 0


def test_slim_counts_come_back_whole(spark):
    """Whatever the terms are: separators in them, an empty one, none at all."""
    rows = [(1, [("a", 2), ("b", 1)]), (2, [("x\x01y", 1), ("z", 3)]), (3, []), (4, [("", 5)]), (5, [("", 1), ("\x01", 2)]), (None, [("n", 1)]), (6, [("é |.", 7)])]
    packed = spark.createDataFrame([(d, t, sum(n for _, n in t), 1, 1.5) for d, t in rows], "doc_id long, terms array<struct<term string, tf long>>, dl long, max_tf long, avg_tf double")
    got, want = I.widened(I.slim(packed)), A.unpacked_counts(packed)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_schemes_read_once_are_not_stored(spark, sf_dir):
    from conceptile import catalog

    kept = len(catalog.QUERIES["w_anb"](spark, sf_dir).collect())
    assert kept and not any(name.startswith("index-") and name != "index-ltc" for _, _, name in catalog._STORED)


@pytest.mark.parametrize("dense", [0, 1 << 17])
def test_all_pairs_of_texts_are_compared(spark, sf_dir, monkeypatch, dense):
    """Not each text with its eight next ones alone; many pairs of few keys are multiplied at once."""
    from conceptile import catalog
    from conceptile.operators import vectors as V

    monkeypatch.setattr(V, "FEW", 0)
    monkeypatch.setattr(V, "DENSE", dense)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    got = catalog.QUERIES["similarity"](spark, sf_dir).collect()
    own = {(r.item_id, r.doc_id): r.score for r in catalog._vectors(spark, sf_dir).collect()}
    vec = {}
    for (i, d), s in own.items():
        vec.setdefault(i, {})[d] = s
    norm = {i: sum(s * s for s in v.values()) ** 0.5 for i, v in vec.items()}
    want = {(a, b): sum(s * vec[b].get(d, 0.0) for d, s in vec[a].items()) / norm[a] / norm[b] for a in vec for b in vec if a < b}
    assert len(got) == len(want) == items * (items - 1) // 2
    assert all(abs(r.cosine - want[r.a, r.b]) < 2e-6 for r in got)
