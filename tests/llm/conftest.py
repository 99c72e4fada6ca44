import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows, with an extra column of a clashing name."""

    def make(rows, extra=None):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra or ():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def table_dir(tmp_path_factory):
    """Writes frames as the tables of a fresh folder."""

    def write(**frames):
        d = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write
