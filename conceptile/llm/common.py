"""What the operators of this subpackage share: scratch tables, words and their hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import removed, shared_root
from ..shipping import ship

WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the shared folder, so that no later step depends on an executor's memory or disk.

    ``keep`` writes a frame and reads it again; ``drop`` deletes a table that no returned frame reads; what is left goes at exit.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        atexit.register(removed, self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                removed(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(docs: DataFrame, name: str = "position") -> DataFrame:
    """Adds the place of each row, gapless from 0, in the order that the rows were written in: that of the files' numbers, and within files. A scan
    deals files to tasks by their sizes, so that the order it gives says nothing. What doesn't come from files is written first.

    A file begins where those before it end, by a row for each file; no row is moved."""
    file, at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    try:
        rows = docs.select("*", file, at)
    except AnalysisException:
        rows = Scratch(docs.sparkSession).keep(docs, "in-order").select("*", file, at)
    number = lambda p: F.regexp_extract("_file", p, 1).try_cast("long")
    files = rows.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))
    before = Window.orderBy(number(r"/part-(\d+)[^/]*$"), number(r"-c(\d+)[^/]*$"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(files, "_file").select(*[c for c in docs.columns if c != name], (F.col("_base") + F.col("_at")).alias(name))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, tokens), dtype=np.uint64, count=len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: every output bit depends on every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(wh: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of all k-word windows in order; with 1 to k-1 words, the whole sequence as one; none without words."""
    n = len(wh)
    if n == 0:
        return wh
    m = odd_constants(k + 1, 7)
    width = min(n, k)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width) * m[k], dtype=np.uint64)
        for i in range(width):
            out += wh[i : n - width + 1 + i] * m[i]
        return mixed(out)


SIEVE_BITS = 1 << 20


def sieve(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """Whether a value may be among the keys, as an expression without a shuffle: false for nearly all that aren't, true for all that
    are. Its table has a fixed size (128 kB, as plans hold it as text), whatever the number of keys; many keys only let more values through. Null isn't a key."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    at, bits = bit(F.col(name)) + 1, bytearray(SIEVE_BITS // 8)
    rows = keys.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for r in rows.collect():  # one row for each 4 kB of the table
        bits[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    known = F.unhex(F.lit(bits.hex()))

    def may_be(c: Column) -> Column:
        byte = F.conv(F.hex(F.substring(known, F.floor(bit(c) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return c.isNotNull() & (F.bit_get(byte, (bit(c) % 8).cast("int")) == 1)

    return may_be


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that what a worker holds is bounded by few documents."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def numbered(scratch: Scratch, df: DataFrame, group: str, order: list[str], name: str, narrow: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adds ``rank``, gapless from 0 in each group by ``order``, and keeps the counts by group.

    One key may hold any share of the rows: rows are range-partitioned by (group, order, position read), so that even equal rows
    spread over tasks; each task's first rank comes from the counts of the tasks before it. The table of counts has at most one
    row for each task and group that meet, and is broadcast only as Spark's own size threshold allows. ``narrow`` rows are written
    first, as what they come from would be read twice, once for the ranges.
    """
    keys = [group, *order]
    df = df.withColumn("_at", F.monotonically_increasing_id())
    if narrow:
        df = scratch.keep(df, f"{name}-rows")
    sorted_ = df.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").drop("_at")
    placed = scratch.keep(sorted_.withColumn("_pos", F.monotonically_increasing_id()), f"{name}-sorted")
    scratch.drop(df)
    task, offset = F.shiftright("_pos", 33), F.col("_pos").bitwiseAND((1 << 33) - 1)
    parts = placed.groupBy(F.col(group).alias("_g"), task.alias("_task")).agg(F.min(offset).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.keep(parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), f"{name}-parts")
    joined = placed.withColumn("_in", task).join(parts, (F.col(group) == F.col("_g")) & (F.col("_in") == F.col("_task")))
    ranked = joined.select(*[c for c in placed.columns if c != "_pos"], (F.col("_base") + offset - F.col("_first")).cast("long").alias("rank"))
    counts = parts.groupBy(F.col("_g").alias(group)).agg(F.sum("_n").alias("n"))
    return ranked, counts


LONG, DOUBLE, STRING, BOOL, INT, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.BinaryType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
