import corpus_pipeline
import pytest
from conceptile.llm.decontamination import tokens
from conceptile.llm.quality_rules import judged
from test_near_duplicates import brute as groups
from test_sharding import jump


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir).collect()


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]


def test_whole_run_against_brute_force(spark, sf_dir, result):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.kept}
    kept = {d for d, _, c in groups([(d, texts[d]) for d in sorted(kept)], 80) if d == c}  # stages without a contract take 0.8
    items = [" ".join(tokens(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {d for d in kept if not any(i in " ".join(tokens(texts[d])) for i in items)}
    assert {r.doc_id for r in result} == kept and len(result) == len(kept)
    assert all(r.shard == jump(r.doc_id, 24) and r.text == texts[r.doc_id] for r in result)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_an_empty_table_stays_empty(spark, docs, table_dir, sf_dir):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.lit(False))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, table_dir(documents=docs([]), labels=labels, benchmark=bench)).collect() == []


def test_positions_are_those_of_the_mixture(spark, result):
    """The mixture is in the result, not in the order of files alone, which a scan does not keep."""
    from conceptile.llm.mixing import mixed

    docs = spark.createDataFrame([(r.doc_id, r.source) for r in result], "doc_id long, source string")
    want = {r.doc_id: r.position for r in mixed(docs).collect()}
    assert {r.doc_id: r.position for r in result} == want and sorted(want.values()) == list(range(len(result)))


def test_rows_that_do_not_come_from_files_keep_their_order(spark, docs):
    from conceptile.llm.common import in_order

    rows = [(i * 7 % 100, "x" * (i % 9), None, "s") for i in range(100)]
    got = in_order(docs(rows, ["position"]).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == sorted(r[0] for r in rows)
    assert sorted(r.position for r in got) == list(range(100)) and in_order(docs([])).collect() == []
