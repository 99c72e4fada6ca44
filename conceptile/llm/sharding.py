"""Sharding by jump consistent hashing, in built-in expressions only.

The walk is that of the published algorithm: a 64-bit linear congruential generator seeded with the key draws the next shard
count at which the key moves; the last one below the shard count is the shard. No ring and no table is kept, and one more
shard takes rows only into itself. Spark's ANSI arithmetic refuses to wrap, so the 64-bit product is made of 32-bit halves.

Defined cases: a null key counts as 0; a null text has no bytes (size 8, CRC of nothing); rows that repeat a key get the same
shard and different slots; an empty table gives no rows; other columns, whatever they are called, are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_order, numbered, table

MULTIPLIER = 2862933555777941757
LOW, HALF = (1 << 32) - 1, (1 << 16) - 1
SHARDS = 24


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) times the multiplier plus 1, modulo 2**64; hi and lo are 32-bit halves held in longs."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW

    def low_product(x: Column, m: int) -> Column:
        """x * m modulo 2**32; no step passes 2**49."""
        upper = (F.shiftright(x, 16) * F.lit(m)).bitwiseAND(HALF)
        return (x.bitwiseAND(HALF) * F.lit(m) + F.shiftleft(upper, 16)).bitwiseAND(LOW)

    p, q = lo.bitwiseAND(HALF) * F.lit(m_lo), F.shiftright(lo, 16) * F.lit(m_lo)
    low = p + F.shiftleft(q.bitwiseAND(HALF), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(q, 16)
    return (carry + low_product(hi, m_lo) + low_product(lo, m_hi)).bitwiseAND(LOW), low.bitwiseAND(LOW)


def jump_walk(key: Column, shards: int) -> Column:
    """struct(shard, next): the shard among ``shards``, and the shard count less one at which the key moves next (``shards`` or more)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = lambda hi, lo, b, j: F.struct(hi.alias("hi"), lo.alias("lo"), b.alias("b"), j.alias("j"))

    def draw(s: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        return state(hi, lo, s["j"], s["hi"])  # j follows from the new high half: see leap

    def leap(s: Column) -> Column:
        # the top 31 bits of the state are those of its high half; the quotient is below 2**31 * shards
        jump = F.floor((s["b"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(s["hi"], 1) + 1).cast("double"))).cast("long")
        return state(s["hi"], s["lo"], s["b"], jump)

    def move(s: Column, _: Column) -> Column:
        return F.when(s["j"] < F.lit(shards), leap(draw(s))).otherwise(s)

    zero = F.lit(0).cast("long")
    start = state(F.shiftrightunsigned(key, 32), key.bitwiseAND(LOW), F.lit(-1).cast("long"), zero)
    few = min(shards, 32)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, move)
    if shards > few:  # hardly any key moves so often; those that do go on here, as far as there are shards
        walked = F.transform(F.array(walked), lambda s: F.when(s["j"] < F.lit(shards), F.aggregate(F.sequence(F.lit(few + 1), F.lit(shards)), s, move)).otherwise(s))[0]
    return F.struct(walked["b"].cast("int").alias("shard"), walked["j"].alias("next"))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Adds shard and grown_shard (the shard if there were one more) without a shuffle; input columns of these names give way."""
    walk = df.drop("shard", "grown_shard").withColumn("_walk", jump_walk(F.col(key), shards))
    grown = F.when(F.col("_walk.next") == F.lit(shards), F.lit(shards)).otherwise(F.col("_walk.shard"))
    return walk.withColumns({"shard": F.col("_walk.shard"), "grown_shard": grown.cast("int")}).drop("_walk")


def shard_slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots follow doc_id (null first), then CRC and size.

    One pass over the texts; everything after it moves five narrow columns.
    """
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    scratch = Scratch(docs.sparkSession)
    ranked, _ = numbered(scratch, assign_shards(narrow, "doc_id", shards), "shard", ["doc_id", "text_crc32", "size"], "shards")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shards and ``position``, their place in the mixture: rows are read in any order, but were written in its."""
    return assign_shards(in_order(docs))


#: The same walk on 128-bit integers; the CRC by the table of its reflected polynomial, a fixed value.
SQL = f"""WITH RECURSIVE walk AS (
  SELECT doc_id, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(nk // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, j, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS nk FROM walk WHERE j < {SHARDS})),
moved AS (SELECT doc_id, max(b) AS shard, max(j) AS nxt FROM walk GROUP BY 1),
steps AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS tb FROM steps),
raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT doc_id, strlen(t) + 8 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS l FROM raw),
sums AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, l), lambda c, x: xor(c >> 8, tb[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc)
SELECT s.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id, text_crc32, size) - 1 AS slot,
  CAST(CASE WHEN nxt = {SHARDS} THEN {SHARDS} ELSE shard END AS INTEGER) AS grown_shard FROM sums s JOIN moved m ON m.doc_id = s.doc_id"""


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"))
