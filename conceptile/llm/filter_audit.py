"""What each filter of a cleaning recipe takes away, in every order of the filters, from one table of counts.

Each document is tested by all filters at once; the failures are the bits of a mask. Rows by (part, mask), at most 2^k for k
filters, are all that is counted. The subset-zeta transform turns a part's counts into the number of documents whose failures lie
within any set of filters: what survives a set of filters is what fails only within the others. A step of an order then is the
difference of two neighbouring sets, and the same transform of the labelled rows' counts says what good and toxic rows it takes.

Defined cases: a null text is empty and equals the empty text; a null part is the empty string; a row without an id is never the
copy of another, nor is one of an equal id; labels of unknown documents or without an id are not used, several for one document count as
good (toxic) if one of them says so; repeated rows are counted each; an empty table has no parts and no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import once
from .common import Scratch, table

SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails, by the filter's letter; ``words`` are its words."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def bits(fails: list[Column]) -> Column:
    """The failures as a mask, the first one's bit the lowest."""
    out = F.lit(0)
    for i, f in enumerate(fails):
        out = out + F.when(f, F.lit(1 << i)).otherwise(0)
    return out


def tested(scratch: Scratch, docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask): the filters of ``text_filters`` and, as the next bit, whether a smaller id has the same text. Texts are read once
    and never shuffled; equal texts meet by their digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), text.alias("text")).withColumn("_w", once(F.filter(F.split("text", SPACE), lambda x: x != "")))
    mask = bits(list(text_filters(F.col("text"), F.col("_w")).values()))
    rows = scratch.keep(df.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), mask.alias("mask")), "filter-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    copied = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copied, F.lit(1 << 4)).otherwise(0)).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic)."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return masks.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """(part, own_n, n, good, toxic): arrays over the 2^k sets of filters. ``own_n`` has the documents that fail exactly a set, the others
    those that survive it: the zeta transform of the counts, bit by bit, read at the set's complement."""
    size = 1 << k
    seen = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    df = counts.groupBy("part").agg(seen.alias("_m"))
    kinds = ("n", "good", "toxic")

    def by_set(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i)[c], F.lit(0))).cast("array<long>")

    def with_bit(c: str, bit: int) -> Column:
        return once(F.transform(c, lambda v, i: v + F.when(i.bitwiseAND(F.lit(bit)) > 0, F.get(F.col(c), i - bit)).otherwise(0)))

    df = df.select("part", *[by_set(c).alias(c) for c in kinds]).withColumn("own_n", F.col("n"))
    for b in range(k):
        df = df.withColumns({c: with_bit(c, 1 << b) for c in kinds})
    return df.select("part", "own_n", *[F.reverse(c).alias(c) for c in ("n", "good", "toxic")])


def audited(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    ``shapley`` sums what a filter removes over all orders: each set of the others comes before it in |set|! * (k - 1 - |set|)! of
    them, so that it too is a sum over the sets' survivors."""
    k = len(letters)
    factorial = [1]
    for i in range(1, k + 1):
        factorial.append(factorial[-1] * i)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    df = survivors(counts, k)
    df = df.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = F.lit(0)
    for i, x in enumerate(letters):
        before = before + F.when(F.instr("filter_order", x) < F.col("step"), F.lit(1 << i)).otherwise(0)
    bit = F.lit(0)
    for i, x in enumerate(letters):
        bit = F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == x, F.lit(1 << i)).otherwise(bit)
    df = df.withColumns({"_b": before, "_f": bit})
    at = lambda c, s: F.get(F.col(c), s)
    lost = lambda c: at(c, F.col("_b")) - at(c, F.col("_b") + F.col("_f"))
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.col("_f")) == 0)
    weight = F.array(*[F.lit(factorial[i] * factorial[k - 1 - i]).cast("long") for i in range(k)])
    shapley = F.aggregate(sets, F.lit(0).cast("long"), lambda a, s: a + F.get(weight, F.bit_count(s)) * (at("n", s) - at("n", s + F.col("_f"))))
    return df.select("part", "filter_order", "step", at("n", F.col("_b") + F.col("_f")).alias("kept"), lost("n").alias("removed"), (at("n", F.lit(0)) - at("n", F.col("_f")) - lost("n")).alias("redundant"), at("own_n", F.col("_f")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = tested(Scratch(spark), table(spark, sf_dir, "documents"))
    return audited(mask_counts(masks, table(spark, sf_dir, "labels")), "ABCDE")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS f FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > f, false)] AS fails,
  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT i FROM range(1, 6) r(i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a JOIN x b ON b.i <> a.i JOIN x c ON c.i NOT IN (a.i, b.i) JOIN x d ON d.i NOT IN (a.i, b.i, c.i) JOIN x e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', y, 1)), '') AS filter_order, i AS step, o[i] AS own, n, good, toxic, fails[o[i]] AS here,
  len(list_filter(o[1:i-1], lambda y: fails[y])) > 0 AS earlier, len(list_filter(fails, lambda y: y)) AS many FROM c CROSS JOIN o CROSS JOIN x),
a AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, sum(CASE WHEN NOT earlier AND NOT here THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT earlier AND here THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN earlier AND here THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT earlier AND here THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT earlier AND here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a
"""
