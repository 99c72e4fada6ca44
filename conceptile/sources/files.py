"""Readers and writers of documents, judgements, word lists and vectors. Paths come from the caller; schemas are stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "text", "incomingLinks", "outgoingLinks", "terms", "redirect")])
DUMP = T.StructType([T.StructField("title", T.StringType()), T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])), T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_bytes", T.StringType())]))]))])
DREAM = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "content", "user")])


def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """<doc> records of processed files (bz2 by suffix, several streams too): title, text, numbers and redirect."""
    df = spark.read.format("xml").schema(ARTICLE).option("rowTag", "doc").load(path)
    return df.select("title", "text", *[F.col(c).cast("int").alias(n) for c, n in (("incomingLinks", "incoming_links"), ("outgoingLinks", "outgoing_links"), ("terms", "terms"))], "redirect")


def dump_xml(spark: SparkSession, path: str) -> DataFrame:
    """<page> records of a dump: title, text."""
    df = spark.read.format("xml").schema(DUMP).option("rowTag", "page").load(path)
    return df.select("title", F.col("revision.text._VALUE").alias("text"))


def dreams_xml(spark: SparkSession, path: str) -> DataFrame:
    """<dream> records that have a title or a content: id, title, text, user."""
    df = spark.read.format("xml").schema(DREAM).option("rowTag", "dream").load(path)
    either = F.concat(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return df.where(either != "").select("id", "title", dream_text(F.col("title"), F.col("content")).alias("text"), "user")


def dream_text(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))


def write_xml(df: DataFrame, path: str, row: str = "doc", root: str = "docs", compression: str = "bzip2") -> None:
    df.write.format("xml").option("rowTag", row).option("rootTag", root).option("compression", compression).save(path)


def gold_pairs(spark: SparkSession, path: str, scale: float = 10.0) -> DataFrame:
    """(doc1, doc2, human) of a CSV without header; a row of fewer columns is an error."""
    df = spark.read.schema("doc1 string, doc2 string, score double").option("mode", "FAILFAST").csv(path)
    return df.select("doc1", "doc2", (F.col("score") / scale).alias("human"))


def numbered_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): the records of one CSV file that judgements name by number, from 1, without empty lines. The list is written by
    hand and small, and is read as one part: the numbers are the order in it."""
    df = spark.read.schema("text string").option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).coalesce(1)
    return df.select((F.monotonically_increasing_id() + 1).alias("id"), "text")


def judged_texts(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of numbers with their texts; a number that no document has is an error."""
    side = lambda c: documents.select(F.col("id").cast("string").alias(c), F.col("text").alias(f"text{c[-1]}"), F.lit(True).alias(f"_{c}"))
    both = pairs.join(side("doc1"), "doc1", "left").join(side("doc2"), "doc2", "left")
    known = lambda c: F.when(F.col(f"_{c}"), F.col(f"text{c[-1]}")).otherwise(F.raise_error(F.concat(F.lit("no document "), F.coalesce(c, F.lit("null")))))
    return both.withColumns({"text1": known("doc1"), "text2": known("doc2")}).drop("_doc1", "_doc2")


def words(spark: SparkSession, path: str, more: list[str] | None = None) -> DataFrame:
    """(term): a list with a word a line, lower-cased, without empty lines and repeats."""
    df = spark.read.text(path).select(F.lower("value").alias("term"))
    if more:
        df = df.unionByName(spark.createDataFrame([(w.lower(),) for w in more], "term string"))
    return df.where("term <> ''").distinct()


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_terms(terms: DataFrame, path: str) -> None:
    terms.select("term").write.text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(id as hexadecimal text, concept, weight), appended with binary ids."""
    vectors.select(F.unhex("id").alias("id"), F.col("concept").cast("int").alias("concept"), F.col("weight").cast("float").alias("weight")).write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, table: str, options: dict[str, str], batch: int = 10_000) -> None:
    """To a database that the caller's options name; rows go in batches."""
    df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode("append").save()


def read_jdbc(spark: SparkSession, table: str, options: dict[str, str], column: str | None = None, bounds: tuple | None = None, parts: int = 0) -> DataFrame:
    """A table of the database. With a ``column`` (number, date or timestamp) it is read in ``parts`` ranges of it, a task each; ``bounds`` are
    its least and largest value, asked of the database if they aren't given. They only deal the rows out: all are read."""
    reader = spark.read.format("jdbc").options(**options)
    if column is None:
        return reader.option("dbtable", table).load()
    if bounds is None:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(column)  # as Spark writes it
        bounds = tuple(reader.option("query", f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}").load().first())
    if bounds[0] is None:  # no rows, or nothing but null
        return spark.read.format("jdbc").options(**options).option("dbtable", table).load()
    parts = parts or spark.sparkContext.defaultParallelism
    dealt = {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).option("dbtable", table).options(**dealt).load()


def ordered_scores(scores: DataFrame, term: str, limit: int = 0) -> DataFrame:
    """Stored scores (term, document, score) of one term, best first; over JDBC filter, order and limit go to the database."""
    out = scores.where(F.col("term") == term).orderBy(F.desc("score"), "document")
    return out.limit(limit) if limit else out


def pruned_scores(scores: DataFrame, window: int, drop_off: float) -> DataFrame:
    """Stored scores (term, document, score) without the tails of their terms, to be written in place of the table."""
    from ..operators.vectors import prune_window

    return prune_window(scores.withColumnRenamed("document", "doc_id"), window, drop_off).withColumnRenamed("doc_id", "document")


def find_article(articles: DataFrame, title: str) -> DataFrame:
    return articles.where(F.col("title") == title).limit(1)
