"""Stored vectors by key: the last one written counts, and a look-up reads the buckets of its ids alone.

A vector is one row: its id, concepts and weights in the order of the concepts. Batches are folders that are committed one by one, each
with a folder for each bucket, a hash of the id; a vector that is written again, or deleted, leaves its earlier row behind until
``compact`` writes the last rows anew. A batch is named by the caller, as for ``operators.segments``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import APPEND, COMPACT, Commit, CommitLog

BUCKETS = 64


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, id_type: str = "string"):
        self.spark, self.path, self.buckets, self.log = spark, path, buckets, CommitLog(spark, f"{path}/log")
        self.schema = f"id {id_type}, c array<bigint>, w array<double>, bucket int"

    def bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str, kind: str, upto: int = -1) -> bool:
        """Rows have (id, c, w), an id once."""
        if any(c.name == name for c in self.log.commits()):
            return False
        placed = rows.select("id", "c", "w", self.bucket(F.col("id")).alias("bucket"))
        placed.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={name}")
        self.log.add(name, kind, upto)
        return True

    def write(self, vectors: DataFrame, name: str) -> bool:
        """Vectors (id, concept, weight); says whether the batch was new."""
        one = F.struct(F.col("concept").cast("long").alias("c"), F.col("weight").cast("double").alias("w"))
        packed = vectors.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("v"))
        return self.write_packed(packed.select("id", F.col("v.c").alias("c"), F.col("v.w").alias("w")), name)

    def write_packed(self, rows: DataFrame, name: str) -> bool:
        """Vectors (id, c, w), which may be empty."""
        return self._write(rows, name, APPEND)

    def delete(self, ids: DataFrame, name: str) -> bool:
        return self._write(ids.select("id").distinct().select("id", F.lit(None).cast("array<bigint>").alias("c"), F.lit(None).cast("array<double>").alias("w")), name, APPEND)

    def compact(self, name: str) -> bool:
        commits = self.log.commits()
        return bool(commits) and self._write(self.packed(commits=commits), name, COMPACT, commits[-1].number)

    def packed(self, buckets: Iterable[int] | None = None, commits: list[Commit] | None = None) -> DataFrame:
        """(id, c, w) of the vectors there are, in the given buckets."""
        out = None
        live = self.log.live(commits)
        for c in live:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={c.name}")
            rows = rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))
            rows = rows.select("id", "c", "w", F.lit(c.number if c.kind != COMPACT else c.upto).alias("seq"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], self.schema).select("id", "c", "w")
        if len(live) > 1:
            # the ids alone are grouped; where they are few, no vector is shuffled
            last = out.groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_seq"))
            out = out.join(last, F.col("id").eqNullSafe(F.col("_id")) & (F.col("seq") == F.col("_seq")))
        return out.where("c is not null").select("id", "c", "w")

    def read(self) -> DataFrame:
        """(id, concept, weight)."""
        return unpacked(self.packed())

    def look_up(self, ids: DataFrame) -> DataFrame:
        """(id, c, w) of the asked (id): only their buckets are read, at most ``buckets`` numbers come to the driver."""
        asked = ids.select("id").distinct()
        buckets = [r.b for r in asked.select(self.bucket(F.col("id")).alias("b")).distinct().collect()]
        return self.packed(buckets).join(asked, "id", "left_semi")


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode(F.arrays_zip("c", "w")).alias("v")).select("id", F.col("v.c").alias("concept"), F.col("v.w").alias("weight"))
