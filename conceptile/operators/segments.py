"""An index that grows: batches of documents as segments of raw statistics, committed one by one, weighted when they are asked.

A segment has the counts, lengths and document frequencies of its own documents and is never changed. Weights hang on statistics of all
documents, so that they are not stored: ``index`` takes the frequencies of all segments together and less those of the documents that are gone,
so that build(A) and append(B) are build(A + B). A document that is given again replaces its earlier version; one that is deleted leaves a
tombstone. ``compact`` writes what is live as one segment.

Tables of the folder: ``counts`` (doc_id, term, tf, dl, max_tf, avg_tf), ``lengths`` (doc_id, dl), ``df`` (term, df) and ``gone``
(doc_id), each with a folder ``segment=<name>`` for each batch; ``log`` has a small file for each commit, named by its number and
created only if no other has that number. A batch is named by the caller: what a failed attempt has left is overwritten when it is run again, a
batch that is committed already isn't taken twice. Readers see the commits there were when they opened the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import WeightSpec
from .analyze import DEFAULT, AnalyzerSpec, term_counts
from .commits import APPEND, COMPACT, DELETE, Commit, CommitLog
from .index import Index, in_blocks, weighted
from .staging import removed

TABLES = {
    "counts": "doc_id long, term string, tf long, dl long, max_tf long, avg_tf double",
    "lengths": "doc_id long, dl long",
    "df": "term string, df long",
    "gone": "doc_id long",
}

class Segments:
    def __init__(self, spark: SparkSession, path: str, analyzer: AnalyzerSpec = DEFAULT):
        self.spark, self.path, self.analyzer = spark, path, analyzer

    def log(self) -> list[Commit]:
        return CommitLog(self.spark, f"{self.path}/log").commits()

    def commit(self, name: str, kind: str, upto: int = -1) -> None:
        CommitLog(self.spark, f"{self.path}/log").add(name, kind, upto)

    def has(self, name: str) -> bool:
        return any(c.name == name for c in self.log())

    # ------------------------------------------------------------------------------------------------------------- writing

    def _write(self, df: DataFrame, table: str, name: str) -> DataFrame:
        path = f"{self.path}/{table}/segment={name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def append(self, docs: DataFrame, name: str, text: str = "text") -> bool:
        """Takes a batch of (doc_id, text), ids once each and not null; says whether it was new."""
        if self.has(name):
            return False
        counts = self._write(term_counts(docs, self.analyzer, text=text), "counts", name)
        sizes = counts.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        lengths = docs.select("doc_id").join(sizes, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
        self._write(lengths, "lengths", name)
        self._write(counts.groupBy("term").agg(F.count("*").alias("df")), "df", name)
        self.commit(name, APPEND)
        return True

    def delete(self, ids: DataFrame, name: str) -> bool:
        """Takes the documents of these ids out, in the versions there are."""
        if self.has(name):
            return False
        self._write(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone", name)
        self.commit(name, DELETE)
        return True

    def compact(self, name: str) -> bool:
        """What is live, as one segment; earlier ones are not read any more."""
        log = self.log()
        if self.has(name) or not log:
            return False
        now = self.opened(log)
        counts = self._write(now.counts, "counts", name)
        self._write(now.lengths, "lengths", name)
        self._write(counts.groupBy("term").agg(F.count("*").alias("df")), "df", name)
        self.commit(name, COMPACT, log[-1].number)
        return True

    def vacuum(self) -> list[str]:
        """Removes the segments that a compaction has taken in, for when no reader has them open; their names."""
        log = self.log()
        last = max((c for c in log if c.kind == COMPACT), key=lambda c: c.number, default=None)
        old = [c.name for c in log if last and c.number <= last.upto]
        for name in old:
            for table in TABLES:
                removed(self.spark, f"{self.path}/{table}/segment={name}")
        return old

    # ------------------------------------------------------------------------------------------------------------- reading

    def opened(self, log: list[Commit] | None = None) -> Live:
        return Live(self, CommitLog(self.spark, f"{self.path}/log").live(log))

    def index(self, weights: WeightSpec = WeightSpec()) -> Index:
        return self.opened().index(weights)


class Live:
    """The documents of some commits, without earlier versions and deleted ones."""

    def __init__(self, owner: Segments, commits: list[Commit]):
        self.owner, self.commits = owner, commits
        dead = self.dead().persist()
        self.counts = self.table("counts").join(dead, ["doc_id", "seq"], "left_anti").drop("seq")
        self.lengths = self.table("lengths").join(dead, ["doc_id", "seq"], "left_anti").drop("seq")
        self.dead_counts = self.table("counts").join(dead, ["doc_id", "seq"], "left_semi")

    def table(self, name: str) -> DataFrame:
        """The rows of the live commits, with the order of their commit as ``seq``. A compaction counts from where it read."""
        kinds = (DELETE,) if name == "gone" else (APPEND, COMPACT)
        spark, out = self.owner.spark, None
        for c in self.commits:
            if c.kind in kinds:
                seq = F.lit(c.number if c.kind != COMPACT else c.upto).alias("seq")
                rows = spark.read.schema(TABLES[name]).parquet(f"{self.owner.path}/{name}/segment={c.name}").select("*", seq)
                out = rows if out is None else out.unionByName(rows)
        return spark.createDataFrame([], f"{TABLES[name]}, seq int") if out is None else out

    def dead(self) -> DataFrame:
        """(doc_id, seq): versions that a later one replaces or a later tombstone deletes."""
        versions = self.table("lengths").select("doc_id", "seq", F.lit(False).alias("_gone")).unionByName(self.table("gone").select("doc_id", "seq", F.lit(True).alias("_gone")))
        newest = versions.groupBy("doc_id").agg(F.max("seq").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
        return versions.join(newest, "doc_id").where("not _gone and seq < _last").select("doc_id", "seq")

    def df(self) -> DataFrame:
        """(term, df): the segments' own frequencies, less one for each gone document that has the term. No count of a live document is read."""
        less = self.dead_counts.groupBy("term").agg((-F.count("*")).alias("df"))
        return self.table("df").select("term", "df").unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def stats(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))

    def index(self, weights: WeightSpec = WeightSpec()) -> Index:
        df, stats = self.df(), self.stats()
        return Index(in_blocks(weighted(self.counts, df, stats, weights)), df, stats, self.owner.analyzer, weights)
