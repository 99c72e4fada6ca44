"""Statistics of terms that are kept for each part of a corpus and merged, in place of a count over all of it.

A sample holds the ``k`` terms of least hash with their document frequencies. Samples of parts merge into the very sample of the whole, as a
term below the merged bound is below every part's own; the number of terms follows from the bound, and the share of rare ones from the
sample. ``heavy`` terms are the most frequent ones of a part; merged, a frequency lies between what the parts name and that and the
least frequency of each part that doesn't name the term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, HEAVY, DEVIATIONS = 4096, 1024, 4
_SPAN = float(2**64)


def sample(df: DataFrame, k: int = K) -> DataFrame:
    """(term, h, df) of the ``k`` terms of least hash; df has (term, df), a term once."""
    return df.select("term", F.xxhash64("term").alias("h"), F.col("df").cast("long").alias("df")).orderBy("h", "term").limit(k)


def merged(samples: DataFrame, k: int = K) -> DataFrame:
    """The sample of all parts from the rows of theirs; all were made with ``k``, or more."""
    return samples.groupBy("term", "h").agg(F.sum("df").alias("df")).orderBy("h", "term").limit(k)


def estimated(of: DataFrame, threshold: int, k: int = K) -> DataFrame:
    """(terms, terms_error, rare, rare_error, percent, exact) of a sample: how many terms there are, and how many are in fewer than ``threshold``
    documents. A sample of fewer than ``k`` terms has all of them, else the errors are four standard deviations."""
    row = of.agg(F.count("*").alias("n"), F.max("h").alias("bound"), F.count(F.when(F.col("df") < threshold, 1)).alias("r"))
    whole, share = F.col("n") < k, F.col("r") / F.greatest(F.col("n"), F.lit(1))
    least = (F.col("bound").cast("double") + _SPAN / 2) / _SPAN
    terms = F.when(whole, F.col("n").cast("double")).otherwise((F.col("n") - 1) / least)
    error = F.when(whole, F.lit(0.0)).otherwise(DEVIATIONS * terms / F.sqrt(F.greatest(F.col("n") - 2, F.lit(1))))
    spread = F.when(whole, F.lit(0.0)).otherwise(DEVIATIONS * F.sqrt(share * (1 - share) / F.greatest(F.col("n"), F.lit(1))))
    return row.select(terms.alias("terms"), error.alias("terms_error"), (terms * share).alias("rare"), (error * share + terms * spread).alias("rare_error"), (share * 100.0).alias("percent"), whole.alias("exact"))


def heavy(df: DataFrame, part: str, m: int = HEAVY) -> DataFrame:
    """(part, term, df, floor): the ``m`` most frequent terms; others are in ``floor`` documents at most."""
    top = df.select(F.lit(part).alias("part"), "term", F.col("df").cast("long").alias("df")).orderBy(F.desc("df"), "term").limit(m)
    whole = Window.partitionBy("part")
    return top.withColumn("floor", F.when(F.count("*").over(whole) < m, F.lit(0)).otherwise(F.min("df").over(whole)).cast("long"))


def heaviest(parts: DataFrame, limit: int) -> DataFrame:
    """(term, least, most): the terms that may be the most frequent of all parts, with the bounds of their document frequency."""
    floors = parts.groupBy("part").agg(F.max("floor").alias("floor")).agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("_all"))
    bounds = parts.groupBy("term").agg(F.sum("df").alias("least"), F.sum("floor").alias("_own")).join(floors).select("term", "least", (F.col("least") + F.col("_all") - F.col("_own")).alias("most"))
    return bounds.orderBy(F.desc("most"), F.desc("least"), "term").limit(limit)
