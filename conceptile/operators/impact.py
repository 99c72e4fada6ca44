"""Postings stored by impact: in blocks of falling scores with their maxima, so that the best concepts are found before all is read.

A term's postings, best first, are cut into blocks of ``size``; blocks lie in folders by depth (level 0 has the first of each term, each
further level twice as many as the one before), sorted by term, so that what isn't asked for is pruned by folder and by the file's statistics.
``blocks`` has a row for each block with its best and least score; ``forward`` has the postings by document, in ``parts`` folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .staging import kept, numbered
from .vectors import LIST, positive, top

SIZE, PARTS, PUSHED, SLACK = 1024, 64, 1000, 1e-9
POSTINGS = "doc_id long, term string, score double, rank long, block long, level int"
BLOCKS = "term string, block long, level int, n long, hi double, lo double"
FORWARD = "doc_id long, term string, score double, part int"


@dataclass(frozen=True)
class ImpactIndex:
    """postings (doc_id, term, score, rank, block, level), blocks (term, block, level, n, hi, lo), forward (doc_id, term, score, part)."""

    postings: DataFrame
    blocks: DataFrame
    forward: DataFrame
    size: int
    parts: int

    @classmethod
    def save(cls, postings: DataFrame, path: str, size: int = SIZE, parts: int = PARTS, digits: int = 9, forward: DataFrame | None = None) -> ImpactIndex:
        """Ranks hang on scores to so many digits, then on the document. Postings go by term in one exchange and are ranked there; those of
        terms with over LIST of them, in ranges. ``forward`` is a stored table (doc_id, term, score) of the same postings, if there is one:
        it is read as it lies, and not written again."""
        spark = postings.sparkSession
        rows = postings.select("doc_id", "term", "score")
        order = [F.desc(F.round("score", digits)), "doc_id"]
        often = kept(rows.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > LIST).select("term"), "long")
        rank = F.row_number().over(Window.partitionBy("term").orderBy(*order)).cast("long")
        if often.isEmpty():
            ranked = rows.withColumn("rank", rank)
        else:  # at most one term for each LIST postings
            long = numbered(rows.join(F.broadcast(often), "term", "left_semi"), ["term"], order, "rank").drop("_part")
            ranked = rows.join(F.broadcast(often), "term", "left_anti").withColumn("rank", rank).unionByName(long)
        block = F.floor((F.col("rank") - 1) / size).cast("long")
        level = F.ceil(F.log2(F.col("block") + 1)).cast("int")
        placed = ranked.withColumn("block", block).withColumn("level", level)
        placed.sortWithinPartitions("level", "term", "rank").write.partitionBy("level").parquet(f"{path}/postings")
        spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("term", "block", "level").agg(F.count("*").alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo")).write.parquet(f"{path}/blocks")
        if forward is not None:
            return cls.load(spark, path, size, parts, forward)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        by_document = postings.select("doc_id", "term", "score", part.alias("part"))
        by_document.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id").write.partitionBy("part").parquet(f"{path}/forward")
        return cls.load(spark, path, size, parts)

    @classmethod
    def load(cls, spark: SparkSession, path: str, size: int = SIZE, parts: int = PARTS, forward: DataFrame | None = None) -> ImpactIndex:
        table = lambda t, schema: spark.read.schema(schema).parquet(f"{path}/{t}")
        return cls(table("postings", POSTINGS), table("blocks", BLOCKS), table("forward", FORWARD) if forward is None else forward, size, parts)

    def read(self, needed: DataFrame, key: str) -> DataFrame:
        """(key, term, doc_id, s): what the postings of the needed (key, term, q, block, level) add to each vector. Levels are pruned by folder;
        the terms, if they are few, in the files."""
        levels = [r.level for r in needed.select("level").distinct().collect()]
        rows = self.postings.where(F.col("level").isin(levels)) if levels else self.postings.limit(0)
        terms = [r.term for r in needed.select("term").distinct().limit(PUSHED + 1).collect()]
        if len(terms) <= PUSHED:
            rows = rows.where(F.col("term").isin(terms))
        return rows.select("term", "block", "doc_id", "score").join(needed, ["term", "block"]).select(key, "term", "doc_id", (F.col("q") * F.col("score")).alias("s"))

    def best(self, weights: DataFrame, limit: int, key: str = "item_id", digits: int = 9, counter: Observation | None = None) -> DataFrame:
        """(key, doc_id, score): the ``limit`` best concepts of each vector, as ``top`` of ``concept_vectors`` gives them. ``counter``
        observes how many blocks were needed (``blocks_read``) of those the terms have (``blocks``).

        The first blocks alone give scores that ``limit`` documents reach at least. From the least of them follows how much a term may add
        unread, so that a document in no read block can't reach it: blocks that may add more are read. Of the documents found, those whose
        score so far and what may be unread reach the best of what was found are scored in full from their own postings."""
        w = kept(weights.where(positive(F.col("score"))).select(key, "term", F.col("score").alias("q")), "weights")
        blocks = kept(self.blocks.join(w, "term").select(key, "term", "q", "block", "level", (F.col("q") * F.col("hi")).alias("most")), "blocks")
        first = F.col("block") * self.size < limit
        known = self.read(blocks.where(first).drop("most"), key).groupBy(key, "doc_id").agg(F.sum("s").alias("s"))
        need = blocks.join(self.least_unread(blocks, kth(known, limit, key), key), key)
        need = need.withColumn("_read", first | (F.col("most") >= F.col("_enough") * (1 - SLACK)))
        if counter:
            need = need.observe(counter, F.count("*").alias("blocks"), F.count(F.when(F.col("_read"), 1)).alias("blocks_read"))
        need = kept(need, "needed")
        rest = need.groupBy(key, "term").agg(F.coalesce(F.max(F.when(~F.col("_read"), F.col("most"))), F.lit(0.0)).alias("_rest"))
        rows = self.read(need.where("_read").select(key, "term", "q", "block", "level"), key).join(rest, [key, "term"])
        whole = rest.groupBy(key).agg(F.sum("_rest").alias("_all"))
        seen = kept(rows.groupBy(key, "doc_id").agg(F.sum("s").alias("s"), F.sum("_rest").alias("_seen")).join(whole, key).withColumn("_more", F.col("_all") - F.col("_seen")), "seen")
        able = seen.join(kth(seen.select(key, "doc_id", "s"), limit, key), key).where(F.col("s") + F.col("_more") >= F.col("_kth") - SLACK)
        exact = able.where("_all <= 0").select(key, "doc_id", F.col("s").alias("score"))
        return top(exact.unionByName(self.scored(able.where("_all > 0").select(key, "doc_id"), w, key)), limit, key, digits)

    @staticmethod
    def least_unread(blocks: DataFrame, reached: DataFrame, key: str) -> DataFrame:
        """(key, _enough): blocks that add less than this needn't be read: the terms' unread best, none over this, add up to ``_kth`` at most."""
        u = blocks.where("block = 0").join(reached, key).select(key, "term", "most", "_kth")
        rising = Window.partitionBy(key).orderBy("most", "term")
        below = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        level = (F.col("_kth") - F.col("_below")) / F.col("_left")
        u = u.withColumns({"_below": below, "_left": F.count("*").over(rising.rowsBetween(0, Window.unboundedFollowing)), "_at": F.row_number().over(rising)}).withColumn("_level", level)
        fits = F.col("_level") <= F.col("most")
        return u.groupBy(key).agg(F.coalesce(F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.col("_at"))), F.max("most")).alias("_enough"))

    def scored(self, asked: DataFrame, w: DataFrame, key: str) -> DataFrame:
        """(key, doc_id, score) of the asked documents, from the parts of the forward table that have them."""
        if "part" not in self.forward.columns:
            rows = self.forward.join(w.select("term").distinct(), "term", "left_semi")
            return rows.join(kept(asked, "able"), "doc_id").join(w, [key, "term"]).groupBy(key, "doc_id").agg(F.sum(F.col("q") * F.col("score")).alias("score"))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")
        parts = [r.part for r in asked.select(part.alias("part")).distinct().collect()]  # at most ``parts``
        rows = self.forward.where(F.col("part").isin(parts)) if parts else self.forward.limit(0)
        return rows.join(asked, "doc_id").join(w, [key, "term"]).groupBy(key, "doc_id").agg(F.sum(F.col("q") * F.col("score")).alias("score"))

    def pruned(self, window: int, drop_off: float, digits: int = 9) -> DataFrame:
        """(doc_id, term, score) as ``prune_window`` leaves them, from the stored ranks. The first blocks of the terms, and the first rows of the
        second ones for what looks ahead, end most lists; only the terms that don't stop there are read on."""
        if window > self.size:
            raise ValueError("a window has at most the rows of a block")
        rows = self.postings.select("doc_id", "term", F.round("score", digits).alias("score"), "rank", "block", "level")
        near = kept(self.ended(rows.where("level <= 1").where(F.col("rank") <= self.size + window), window, drop_off).where("block = 0"), "near")
        stopped = near.groupBy("term").agg(F.max("_stopped").alias("_ends"))
        open_ = self.blocks.where("block = 1").select("term").join(stopped.where("not _ends"), "term", "left_semi")
        deep = self.ended(rows.where("level >= 1").join(open_, "term", "left_semi"), window, drop_off)
        deep = kept(deep, "unpruned")
        end = deep.where("_stopped").groupBy("term").agg(F.min("block").alias("_end"))
        deep = deep.join(end, "term", "left").where("_end is null or block <= _end")
        return near.select("doc_id", "term", "score").unionByName(deep.select("doc_id", "term", "score"))

    def ended(self, rows: DataFrame, window: int, drop_off: float) -> DataFrame:
        """(doc_id, term, score, block, _stopped): the rows of each block up to its first stop. The first rows of a block come to the one before
        it too, for the rows that look ahead."""
        at = (F.col("rank") - 1) % self.size
        copies = F.when((at < window) & (F.col("block") > 0), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
        rows = rows.select("*", F.explode(copies).alias("_in"))
        within = Window.partitionBy("term", "_in").orderBy("rank")
        stops = F.coalesce((F.col("score") - F.lead("score", window).over(within)) < F.col("score") * drop_off, F.lit(False)) & (F.col("block") == F.col("_in"))
        rows = rows.withColumn("_stops", stops)
        rows = rows.withColumn("_first", F.min(F.when(F.col("_stops"), F.col("rank"))).over(Window.partitionBy("term", "_in"))).where("block = _in")
        return rows.where("_first is null or rank <= _first").select("doc_id", "term", "score", "block", F.col("_first").isNotNull().alias("_stopped"))


def kth(scores: DataFrame, limit: int, key: str) -> DataFrame:
    """(key, _kth): the score that ``limit`` documents reach, 0 where there are fewer; scores are (key, doc_id, s)."""
    order = Window.partitionBy(key).orderBy(F.desc("s"), "doc_id")
    best = scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    return best.groupBy(key).agg(F.when(F.count("*") >= limit, F.min("s")).otherwise(0.0).alias("_kth"))
