"""The concept index: weighted postings with the statistics that queries need, frozen together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import WeightSpec
from .analyze import DEFAULT, AnalyzerSpec, packed_counts, unpacked_counts
from .staging import kept, numbered, spread

BLOCK_ROWS = 1 << 16  # postings of a term that one task joins
SEPARATOR = "\x01"
HEAD = 1 << 18  # terms at most whose frequencies go out to all tasks


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df); counts have one row for each document and term."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def collection_stats(docs: DataFrame, spec: AnalyzerSpec = DEFAULT, text: str = "text") -> DataFrame:
    """One row (n, avg_dl) over all documents, those without tokens too."""
    return spread(docs.select(text)).select(F.size(spec.tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def packed_stats(packed: DataFrame) -> DataFrame:
    """The same row from packed counts, in one pass over their lengths."""
    return packed.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_dl"))


def counted_stats(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The same row from counts that are there already: texts are not read again."""
    n, tokens = docs.count(), counts.agg(F.sum("tf")).first()[0] or 0
    return docs.sparkSession.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avg_dl double")


def with_stats(counts: DataFrame, df: DataFrame, stats: DataFrame, how: str = "inner") -> DataFrame:
    """Counts with df, n and avg_dl. The statistics are one row: they go out as two constants."""
    one = stats.first()
    return counts.join(df, "term", how).withColumns({"n": F.lit(int(one.n)), "avg_dl": F.lit(float(one.avg_dl))})


def weighted(counts: DataFrame, df: DataFrame, stats: DataFrame, spec: WeightSpec = WeightSpec(), key: str = "doc_id", how: str = "inner") -> DataFrame:
    """(key, term, score, blocks). Documents whose scores are all 0 have no norm, and no rows. ``blocks`` says into how many blocks of
    about BLOCK_ROWS the postings of the term are cut, so that a term that nearly all documents have is no hot group."""
    blocks = F.greatest(F.ceil(F.coalesce("df", F.lit(0)) / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks")
    raw = with_stats(counts, df, stats, how).select(key, "term", (spec.tf(F.col("tf"), F.col("max_tf"), F.col("avg_tf"), F.col("dl"), F.col("avg_dl")) * spec.idf(F.col("n"), F.col("df"))).alias("raw"), blocks)
    normed = raw.withColumn("norm", spec.norm(F.col("raw"), F.col("term"), key))
    return normed.where("norm is not null").select(key, "term", (F.col("raw") / F.col("norm")).alias("score"), "blocks")


def head_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frequent terms, HEAD at most, and the others: cut at a power of two of the frequency."""
    of = {r.k: r.n for r in df.groupBy(F.floor(F.log2("df")).alias("k")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    least, terms = 64, 0
    while least > 0 and terms + of.get(least - 1, 0) <= HEAD:
        least -= 1
        terms += of.get(least, 0)
    return df.where(F.col("df") >= 2**least), df.where(F.col("df") < 2**least)


def slim(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Packed counts for a shuffle: terms as one string between separators (as they are, where one of them has a separator) and their counts
    as integers take a third of the room of an array of structs. ``widened`` undoes it."""
    terms = F.transform("terms", lambda x: x["term"])
    clean = F.instr(F.array_join(terms, ""), SEPARATOR) == 0
    counts = F.transform("terms", lambda x: x["tf"].cast("int"))
    return packed.where(F.size("terms") > 0).select(key, F.when(clean, F.array_join(terms, SEPARATOR)).alias("_s"), F.when(~clean, terms).alias("_a"), counts.alias("_n"), "dl", "max_tf", "avg_tf")


def widened(slimmed: DataFrame, key: str = "doc_id", *more: str) -> DataFrame:
    """(key, term, tf, dl, max_tf, avg_tf, more) of slim counts."""
    terms = F.coalesce(F.split("_s", SEPARATOR), "_a")
    rows = slimmed.select(key, F.explode(F.arrays_zip(terms.alias("term"), F.col("_n").alias("tf"))).alias("x"), "dl", "max_tf", "avg_tf", *more)
    return rows.select(key, "x.term", F.col("x.tf").cast("long").alias("tf"), "dl", "max_tf", "avg_tf", *more)


def document_weights(packed: DataFrame, df: DataFrame, stats: DataFrame, spec: WeightSpec = WeightSpec(), key: str = "doc_id") -> DataFrame:
    """The rows of ``weighted`` from packed counts, by document. The frequent terms, which are most of the rows, never leave their documents: their
    frequencies go out to all tasks. Only the others are shuffled by term. Norms are sums, a row for each document, and meet the packed
    documents, which are slim on the way: no table of all postings is sorted or shuffled."""
    one, (head, rare) = stats.first(), head_of(df)
    n, avg_dl = F.lit(int(one.n)), F.lit(float(one.avg_dl))
    saturated = spec.tf(F.col("tf"), F.col("max_tf"), F.col("avg_tf"), F.col("dl"), avg_dl)
    raw = lambda x: (x * spec.idf(n, F.col("df"))).alias("raw")
    head = F.broadcast(head)
    seldom = unpacked_counts(packed, key).join(head, "term", "left_anti").select(key, "term", saturated.alias("x")).join(rare, "term")
    seldom = kept(seldom.select(key, "term", raw(F.col("x")), "df"), "rare")
    often = lambda counts, *more: counts.join(head, "term").select(key, "term", raw(saturated), "df", *more)
    blocks = F.greatest(F.ceil(F.col("df") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks")
    if spec.mode[2] == "n":
        return often(unpacked_counts(packed, key)).unionByName(seldom).select(key, "term", F.col("raw").alias("score"), blocks)
    part = F.sum(spec.norm_part(F.col("raw"), F.col("term"))).alias("s")
    sums = often(unpacked_counts(packed, key)).groupBy(key).agg(part).unionByName(seldom.groupBy(key).agg(part)).groupBy(F.col(key).alias("_k"))
    norms = kept(sums.agg(spec.norm_of(F.sum("s")).alias("norm")).where("norm is not null"), "norms")
    normed = lambda rows: rows.join(norms.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    return often(widened(normed(slim(packed, key)), key, "norm"), "norm").unionByName(normed(seldom)).select(key, "term", (F.col("raw") / F.col("norm")).alias("score"), blocks)


def in_blocks(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, score, block): each row in one of its term's blocks, by a hash of its key."""
    return weights.select(key, "term", "score", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"))


@dataclass(frozen=True)
class Index:
    """Postings (doc_id, term, score, block), df (term, df), stats (n, avg_dl), and how they were made."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    analyzer: AnalyzerSpec = DEFAULT
    weights: WeightSpec = WeightSpec()

    def save(self, path: str, partitions: int | None = None) -> None:
        """Postings lie by term, best first, in ranges of rows: a look-up of terms prunes files and row groups, and a term that
        nearly all documents have lies in several files."""
        order = ["term", F.desc("score"), "doc_id"]
        ranges = self.postings.repartitionByRange(partitions, *order) if partitions else self.postings.repartitionByRange(*order)
        ranges.sortWithinPartitions(*order).write.parquet(f"{path}/postings")
        self.df.write.parquet(f"{path}/df")
        self.stats.write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: AnalyzerSpec = DEFAULT, weights: WeightSpec = WeightSpec()) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "df", "stats")), analyzer, weights)

    def look_up(self, terms: list[str], counter: Observation | None = None) -> DataFrame:
        """Postings (doc_id, term, score) of the given terms. ``counter`` observes how many rows were read."""
        rows = look_up(self.postings, terms).select("doc_id", "term", "score")
        return rows.observe(counter, F.count("*").alias("postings_read"), F.approx_count_distinct("term").alias("terms_read")) if counter else rows

    def cached(self, terms: DataFrame | None = None) -> Index:
        """The same index with its postings (of the given terms) kept in memory and on executors' disks once they are read."""
        rows = self.postings if terms is None else self.postings.join(terms.select("term").distinct(), "term", "left_semi")
        return Index(rows.persist(), self.df, self.stats, self.analyzer, self.weights)


def build_index(docs: DataFrame, analyzer: AnalyzerSpec = DEFAULT, weights: WeightSpec = WeightSpec(), packed: DataFrame | None = None) -> Index:
    """Texts are tokenised once, into a kept table of counts, a row for each document, that frequencies, statistics and weights are made of."""
    if packed is None:
        packed = kept(packed_counts(docs, analyzer), "counts")
    df, stats = kept(document_frequency(unpacked_counts(packed)), "df"), kept(packed_stats(packed), "stats")
    return Index(in_blocks(document_weights(packed, df, stats, weights)), df, stats, analyzer, weights)


def stored_index(docs: DataFrame, path: str, analyzer: AnalyzerSpec = DEFAULT, weights: WeightSpec = WeightSpec(), packed: DataFrame | None = None) -> Index:
    """The index, built into ``path`` and opened from there: what it is asked does not depend on the corpus any more."""
    build_index(docs, analyzer, weights, packed).save(path)
    return Index.load(docs.sparkSession, path, analyzer, weights)


def impact_ordered(postings: DataFrame) -> DataFrame:
    """Postings with their rank in their term: best score first, then the document's id. Ranks come from ranges of rows, so that
    no term's list is one task's."""
    return numbered(postings, ["term"], [F.desc("score"), "doc_id"]).drop("_part")


def rare_words(df: DataFrame, threshold: int) -> DataFrame:
    return df.where(F.col("df") < threshold).select("term")


def rare_word_stats(docs: DataFrame, df: DataFrame, threshold: int) -> DataFrame:
    """(docs, terms, rare, percent)."""
    rare = df.agg(F.count("*").alias("terms"), F.count(F.when(F.col("df") < threshold, 1)).alias("rare"))
    n = docs.agg(F.count("*").alias("docs"))
    return rare.join(n).select("docs", "terms", "rare", (F.col("rare") * 100.0 / F.nullif("terms", F.lit(0))).alias("percent"))


def look_up(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the given terms; the filter reaches the scan."""
    return postings.where(F.col("term").isin(terms))
