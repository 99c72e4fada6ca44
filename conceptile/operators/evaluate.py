"""How well scores follow judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .staging import carried, kept, placed
from .vectors import cosines, positive, pruned_cells, query_weights


def pearson(pairs: DataFrame, x: str = "human", y: str = "score") -> DataFrame:
    return pairs.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))


def ranks(pairs: DataFrame, c: str, name: str) -> DataFrame:
    """Average ranks, ties shared. Distinct values are counted, and put in order in ranges of values: each range adds what lies below
    it, so that no task sees all values."""
    values = placed(pairs.groupBy(c).agg(F.count("*").alias("_n")), [], [c])
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("_below", below).join(carried(values, [], {"_base": F.sum("_n")}), "_part", "left")
    ranked = ranked.select(F.col(c).alias("_v"), (F.coalesce("_base", F.lit(0)) + F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return pairs.join(ranked, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(pairs: DataFrame, x: str = "human", y: str = "score") -> DataFrame:
    both = ranks(ranks(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return both.agg(F.corr("_rx", "_ry").alias("spearman"))


def tune(gold: DataFrame, texts: DataFrame, index: Index, windows: list[int], drop_offs: list[float], key: str = "item_id") -> DataFrame:
    """(window, drop_off, pearson) for each cell of the grid; gold has (a, b, human) of keys of texts.

    The texts' postings are ranked once, each with the cells in which it stays; vectors, cosines and correlations of all cells are
    one plan, keyed by cell."""
    cells = [(w, d) for w in windows for d in drop_offs]
    by_block = "block" in index.postings.columns
    block = [c for c in ("block",) if by_block]
    weights = query_weights(texts, index, key=key).where(positive(F.col("score"))).select(key, "term", F.col("score").alias("q"), "blocks")
    weights = kept(weights, "weights")
    own = index.postings.select("doc_id", "term", "score", *block).join(weights.select("term").distinct(), "term", "left_semi")
    own = pruned_cells(own, cells, df=index.df)
    # a frequent term's postings are joined block by block, and a pair is one row for all cells
    asked = weights.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) if by_block else weights
    scores = asked.join(own, ["term", *block]).select(key, "doc_id", "cells", (F.col("q") * F.col("score")).alias("s"))
    sums = F.array(*[F.sum(F.when(F.array_contains("cells", i), F.col("s"))) for i in range(len(cells))])
    vectors = scores.groupBy(key, "doc_id").agg(sums.alias("_s")).select(key, "doc_id", F.posexplode("_s").alias("cell", "score")).where(F.col("score").isNotNull() & positive(F.col("score")))
    vectors = kept(vectors.select(F.struct("cell", F.col(key).alias("k")).alias("key"), "doc_id", "score"), "vectors")
    number = F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))).alias("cell")
    asked = gold.select("a", "b", "human", number)
    both = asked.select(F.struct("cell", F.col("a").alias("k")).alias("a"), F.struct("cell", F.col("b").alias("k")).alias("b"))
    got = cosines(both, vectors, "key").where(~F.isnan("cosine")).select(F.col("a.cell").alias("cell"), F.col("a.k").alias("a"), F.col("b.k").alias("b"), "cosine")
    scored = got.join(asked, ["cell", "a", "b"]).groupBy("cell").agg(F.corr("human", "cosine").alias("pearson"))
    names = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(float(d)).alias("drop_off")) for w, d in cells])
    grid = gold.sparkSession.range(len(cells)).select(F.col("id").cast("int").alias("cell")).join(scored, "cell", "left")
    return grid.select(names[F.col("cell")].alias("at"), "pearson").select("at.window", "at.drop_off", "pearson")


def until_falling(grid: DataFrame, last: int = 10, falls: int = 8) -> DataFrame:
    """The cells that a search row by row would have reached: it leaves a row, of growing drop-offs, when at least ``falls`` of the
    last ``last`` scores are below the one before."""
    row = Window.partitionBy("window").orderBy("drop_off")
    fell = (F.col("pearson") < F.lag("pearson").over(row)).cast("int")
    steps = grid.withColumn("_fell", F.coalesce(fell, F.lit(0))).withColumn("_at", F.row_number().over(row))
    stop = (F.sum("_fell").over(row.rowsBetween(2 - last, 0)) >= falls) & (F.col("_at") >= last)
    stopped = steps.withColumn("_stop", stop.cast("int"))
    before = F.coalesce(F.max("_stop").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stopped.withColumn("_before", before).where("_before = 0").select(*grid.columns)


def best_cell(grid: DataFrame) -> DataFrame:
    return grid.agg(F.max_by(F.struct("window", "drop_off", "pearson"), F.struct("pearson", -F.col("window"), -F.col("drop_off"))).alias("best")).select("best.*")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
