"""Concept vectors: projection of texts on an index, pruning, top concepts, cosine, related documents.

A vector is long: (key, doc_id, score). Pairs are compared in batches through the concepts they share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.weights import WeightSpec
from ..shipping import ship
from .analyze import term_counts, token_rows
from .index import Index, head_of, weighted
from .staging import carried, kept, numbered, spread

FEW, DENSE = 1 << 14, 1 << 17  # pairs that go out to all tasks; the same where they are most pairs of their keys
LIST = 1 << 16  # postings of a term at most that one task ranks
ASKED, PAIRS = 1 << 20, 1 << 21  # concepts of a block of asked vectors; pairs, and shared concepts of pairs, at a time


@dataclass(frozen=True)
class PruneSpec:
    """0 is off. ``window`` and ``drop_off`` prune postings by term, ``limit`` a vector's concepts."""

    window: int = 0
    drop_off: float = 0.0
    limit: int = 0


def query_weights(queries: DataFrame, index: Index, weights: WeightSpec | None = None, key: str = "item_id") -> DataFrame:
    """(key, term, score, blocks) by the index's statistics; terms that it doesn't know weigh 0 but count in lengths and means."""
    return weighted(term_counts(queries, index.analyzer, key), index.df, index.stats, weights or index.weights, key, "left")


def in_reach(postings: DataFrame, cells: list[tuple[int, float]], by: str = "term", df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The postings that a cell may leave, and the terms (by) of which more than LIST are left.

    Scores of a frequent term are counted in steps so narrow that a step with more postings than the largest window stops the list at
    its first one, in every cell: all below the best of such steps is gone, and only the steps' counts are shuffled for it. Terms that aren't
    frequent (``head_of``) are few rows each. ``df`` (by, df) are their frequencies or more, if they are known."""
    if df is None:
        df = kept(postings.groupBy(by).agg(F.count("*").alias("df")), "df")
    window, drop = max(w for w, _ in cells), min(d for _, d in cells)
    score, none = F.col("score"), F.lit(None).cast("long")
    step = F.floor(-F.log(score) / -math.log1p(-min(drop, 0.5) / 2)) if drop > 0 and all(w > 0 for w, _ in cells) else none
    step = F.when((score > 1e-300) & (score < float("inf")), step)
    often = head_of(df)[0].where(F.col("df") > window).select(by)
    counts = postings.join(F.broadcast(often), by).groupBy(by, step.alias("_step")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_least", F.min(F.when(F.col("_n") > window, F.col("_step"))).over(Window.partitionBy(by)))
    left = F.coalesce(F.col("_step") <= F.col("_least"), F.lit(True))
    bounds = kept(counts.where(left).groupBy(by, "_least").agg(F.sum("_n").alias("_left")).where((F.col("_least").isNotNull()) | (F.col("_left") > LIST)), "bounds")
    rows = postings.join(F.broadcast(bounds.select(by, "_least")), by, "left").where(F.coalesce(step <= F.col("_least"), F.lit(True)))
    return rows.select(*postings.columns), bounds.where(F.col("_left") > LIST).select(by)


def pruned_cells(postings: DataFrame, cells: list[tuple[int, float]], by: str = "term", df: DataFrame | None = None) -> DataFrame:
    """The columns with ``cells``, the places of the (window, drop_off) cells in which a posting stays; those in none are gone.

    Postings of a term, best first, stay up to and with the first that is hardly better than the one ``window`` places on. Those that
    are in reach are ranked in one exchange by term; terms of which too many are left, in ranges of rows."""
    if not any(w > 0 for w, _ in cells):
        return postings.withColumn("cells", F.array(*[F.lit(i) for i in range(len(cells))]))
    rows, long = in_reach(postings, cells, by, df)
    if long.isEmpty():
        return ranked_cells(rows, cells, by)
    short = ranked_cells(rows.join(F.broadcast(long), by, "left_anti"), cells, by)
    return short.unionByName(ranged_cells(rows.join(F.broadcast(long), by, "left_semi"), cells, by))


def ranked_cells(postings: DataFrame, cells: list[tuple[int, float]], by: str) -> DataFrame:
    """``pruned_cells`` of terms of at most LIST postings each."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    stop = lambda w, d: F.coalesce((F.col("score") - F.lead("score", w).over(order)) < F.col("score") * d, F.lit(False)) if w > 0 else F.lit(False)
    rows = postings.withColumns({f"_s{i}": stop(w, d).cast("int") for i, (w, d) in enumerate(cells)})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_b{i}": F.coalesce(F.max(f"_s{i}").over(before), F.lit(0)) for i in range(len(cells))})
    stays = [F.when(F.col(f"_b{i}") == 0, F.lit(i)) for i in range(len(cells))]
    return rows.withColumn("cells", F.array_compact(F.array(*stays))).where(F.size("cells") > 0).select(*postings.columns, "cells")


def ranged_cells(postings: DataFrame, cells: list[tuple[int, float]], by: str) -> DataFrame:
    """``pruned_cells`` of terms of any number of postings: a term's list is cut into ranges of rows, so that no list is one task's. What
    the end of a range compares with in the next one is joined by rank, and a stop in an earlier range is carried, a row for each range."""
    rows = kept(numbered(postings, [by], [F.desc("score"), "doc_id"], "_rank"), "ranked")
    within = Window.partitionBy(by, "_part").orderBy("_rank")
    windows = sorted({w for w, _ in cells if w > 0})
    # the ranges that are not the last of their term, and those that are not its first
    last = rows.groupBy(by, "_part").agg(F.max("_rank").alias("_end"))
    whole = Window.partitionBy(by)
    ends = F.broadcast(last.withColumn("_all", F.max("_end").over(whole)).where("_end < _all"))  # at most one for each range
    tail = rows.join(ends, [by, "_part"]).where(F.col("_rank") > F.col("_end") - windows[-1])
    asked = tail.select(by, "_end", F.col("_rank").alias("_from"), F.explode(F.array(*map(F.lit, windows))).alias("_w")).where(F.col("_from") + F.col("_w") > F.col("_end"))
    asked = asked.select(by, "_from", "_w", (F.col("_from") + F.col("_w")).alias("_rank"))
    found = rows.select(by, "_rank", F.col("score").alias("_far")).join(asked, [by, "_rank"])
    found = found.groupBy(by, F.col("_from").alias("_rank")).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_far"))).alias("_beyond"))
    ahead = {w: f"_far{w}" for w in windows}
    rows = rows.withColumns({c: F.lead("score", w).over(within) for w, c in ahead.items()}).join(found, [by, "_rank"], "left")
    far = lambda w: F.coalesce(F.col(ahead[w]), F.element_at("_beyond", F.lit(w)))
    stop = lambda w, d: F.coalesce((F.col("score") - far(w)) < F.col("score") * d, F.lit(False)) if w > 0 else F.lit(False)
    rows = rows.withColumn("_stops", F.array(*[stop(w, d) for w, d in cells])).drop("_beyond", *ahead.values())
    rows = kept(rows, "stops") if len(cells) > 1 else rows
    flags = {f"_s{i}": F.max(F.col("_stops")[i].cast("int")) for i in range(len(cells))}
    earlier = carried(rows, [by], flags)
    first = Window.partitionBy(by, "_part")
    ranked = rows.withColumns({f"_f{i}": F.min(F.when(F.col("_stops")[i], F.col("_rank"))).over(first) for i in range(len(cells))}).join(earlier, [by, "_part"], "left")
    stays = [F.when((F.coalesce(F.col(f"_s{i}"), F.lit(0)) == 0) & (F.coalesce(F.col(f"_f{i}"), F.col("_rank")) >= F.col("_rank")), F.lit(i)) for i in range(len(cells))]
    return ranked.withColumn("cells", F.array_compact(F.array(*stays))).where(F.size("cells") > 0).select(*postings.columns, "cells")


def prune_window(postings: DataFrame, window: int, drop_off: float, by: str = "term", df: DataFrame | None = None) -> DataFrame:
    """Postings of a term, best first, up to and with the first that is hardly better than the one ``window`` places on."""
    return pruned_cells(postings, [(window, drop_off)], by, df).drop("cells") if window > 0 else postings


def positive(score: Column) -> Column:
    return ~F.isnan(score) & (score > 0)


def concept_vectors(weights: DataFrame, postings: DataFrame, prune: PruneSpec = PruneSpec(), key: str = "item_id", df: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, score): sums over shared terms, positive ones only. The queries' terms first reduce the postings; those of a
    frequent term are joined block by block."""
    on = ["term"]
    wanted = weights.where(positive(F.col("score"))).select(key, "term", F.col("score").alias("q"), *[c for c in ("blocks",) if c in weights.columns])
    wanted = kept(wanted, "asked")  # its size is known to the plan: a few texts go to the postings, which then aren't shuffled for the join
    if prune.window:
        postings = prune_window(postings.join(wanted.select("term").distinct(), "term", "left_semi"), prune.window, prune.drop_off, df=df)
    if "block" in postings.columns and "blocks" in wanted.columns:
        on.append("block")
        wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = wanted.join(postings, on).groupBy(key, "doc_id").agg(F.sum(F.col("q") * F.col("score")).alias("score")).where(positive(F.col("score")))
    return top(out, prune.limit, key) if prune.limit else out


def top(vectors: DataFrame, limit: int, key: str = "item_id", digits: int | None = None) -> DataFrame:
    """The ``limit`` largest of each vector, ties by concept; ``digits`` ranks on rounded scores."""
    score = F.col("score") if digits is None else F.round("score", digits)
    order = Window.partitionBy(key).orderBy(F.desc(score), "doc_id")
    return vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def merged(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    return a.unionByName(b).groupBy(key, "doc_id").agg(F.sum("score").alias("score"))


def norms(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))


def cosines(pairs: DataFrame, vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """(a, b, cosine) for the pairs (a, b) of keys: NaN if one has no concept, else 0 without a shared one.

    Vectors are moved once, to their concepts. Few pairs go out to all tasks, which add up their products and the squares, so that
    no pair has a row for each concept that it shares; so do up to DENSE pairs that are a good part of all pairs of their keys. For more, whose
    vectors are short, these are joined."""
    single = not isinstance(vectors.schema[key].dataType, T.StructType)  # a key of several columns is joined
    few = pairs.select("a", "b").distinct().limit(DENSE + 1).collect() if single else []
    if single and (len(few) <= FEW or len(few) <= DENSE and is_dense(len({k for p in few for k in p}), len(few))):
        sums = dot_products(few, vectors, key)
        n = sums.where(F.col("a") == F.col("b")).select(F.col("a").alias(key), F.sqrt("dot").alias("norm"))
        dots = sums.select("a", "b", "dot")
    else:
        side = lambda c: vectors.select(F.col(key).alias(c), "doc_id", F.col("score").alias(f"s{c}"))
        n = norms(vectors, key)
        dots = pairs.join(side("a"), "a").join(side("b"), ["b", "doc_id"]).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    norm = lambda c: n.select(F.col(key).alias(c), F.col("norm").alias(f"n{c}"))
    both = pairs.join(dots, ["a", "b"], "left").join(norm("a"), "a", "left").join(norm("b"), "b", "left")
    value = F.when(F.col("na").isNull() | F.col("nb").isNull(), F.lit(float("nan"))).otherwise(F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb")))
    return both.select("a", "b", value.alias("cosine"))


def is_dense(keys: int, pairs: int) -> bool:
    """Whether so many pairs are an eighth or more of all."""
    return keys * keys <= 16 * pairs


def dot_products(pairs: list, vectors: DataFrame, key: str) -> DataFrame:
    """(a, b, dot) of the pairs of keys, and of each key in them with itself: a row for each task and pair is shuffled. Where the pairs are a good
    part of all, a task multiplies all keys with all at once."""
    spark = vectors.sparkSession
    ship(spark)
    keys = sorted({k for p in pairs for k in (p.a, p.b) if k is not None})
    at = {k: i for i, k in enumerate(keys)}
    both = sorted({(at[p.a], at[p.b]) for p in pairs if p.a is not None and p.b is not None} | {(i, i) for i in range(len(keys))})
    kind = vectors.schema[key].dataType
    sent = spark.sparkContext.broadcast((keys, at, np.array(both, dtype=np.int64).reshape(-1, 2)))
    one = vectors.where(F.col(key).isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("score").cast("double").alias("s"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, (a, b) = sent.value[0], sent.value[1], sent.value[2].T
        dot, met = np.zeros(len(a)), np.zeros(len(names), dtype=bool)
        whole_dot = np.zeros((len(names), len(names))) if is_dense(len(names), len(a)) else None
        step = max(1, PAIRS // max(1, len(a) if whole_dot is None else len(names)))
        for batch in batches:
            for x in range(0, batch.num_rows, step):
                v = batch.column(0).slice(x, step)
                flat = v.flatten()
                row = np.repeat(np.arange(len(v)), v.value_lengths().to_numpy(zero_copy_only=False))
                codes = flat.field("k").dictionary_encode()
                known = np.array([place.get(k, -1) for k in codes.dictionary.to_pylist()], dtype=np.int64)
                col, own = known[codes.indices.to_numpy(zero_copy_only=False)], flat.field("s").to_numpy(zero_copy_only=False)
                row, col, own = row[col >= 0], col[col >= 0], own[col >= 0]
                whole = np.bincount(row * len(names) + col, own, len(v) * len(names)).reshape(len(v), len(names))
                if np.isfinite(own).all():
                    if whole_dot is None:
                        dot += np.einsum("ij,ij->j", whole[:, a], whole[:, b])
                    else:
                        whole_dot += whole.T @ whole
                else:  # what is no number counts only where both have it
                    there = np.zeros(whole.shape, dtype=bool)
                    there[row, col] = True
                    for y in range(0, len(v), few := max(1, PAIRS // max(1, len(a)))):
                        w, t = whole[y : y + few], there[y : y + few]
                        dot += np.where(t[:, a] & t[:, b], w[:, a] * w[:, b], 0.0).sum(axis=0)
                met[col] = True
        dot += 0.0 if whole_dot is None else whole_dot[a, b]
        own = np.flatnonzero(met[a] & met[b])
        value = pa.array([names[i] for i in a[own]], out.field("a").type), pa.array([names[i] for i in b[own]], out.field("b").type)
        yield pa.RecordBatch.from_arrays([*value, pa.array(dot[own])], schema=out)

    fields = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("dot", T.DoubleType())])
    out = to_arrow_schema(fields)
    return one.select("v").mapInArrow(run, fields).groupBy("a", "b").agg(F.sum("dot").alias("dot")) if both else spark.createDataFrame([], fields)


def similarities(pairs: DataFrame, texts: DataFrame, index: Index, prune: PruneSpec = PruneSpec(), key: str = "item_id") -> DataFrame:
    """(a, b, cosine) of the texts behind pairs of keys: each different text is projected once, whatever keys name it."""
    first = texts.groupBy("text").agg(F.min(key).alias("_first"))
    named = kept(texts.join(first, texts["text"].eqNullSafe(first["text"])).select(texts[key], "_first"), "texts")
    own = texts.join(named.select(F.col("_first").alias(key)).distinct(), key, "left_semi")
    own = own.dropDuplicates([key])
    vectors = concept_vectors(query_weights(own, index, key=key), index.postings, prune, key, index.df)
    side = lambda c: named.select(F.col(key).alias(c), F.col("_first").alias(f"_{c}"))
    asked = kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b"), "pairs")
    got = cosines(asked.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), vectors, key)
    return asked.join(got.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "cosine"), ["_a", "_b"]).select("a", "b", "cosine")


def related(vectors: DataFrame, ids: DataFrame, limit: int, key: str = "id", concept: str = "concept", weight: str = "weight", block: int = ASKED) -> DataFrame:
    """(key, other, cosine): the stored vectors nearest to each of the given ones, of those that share a concept with it.

    Vectors are packed, a row each. The asked ones go out in blocks of at most ``block`` concepts, each against all vectors: a
    task multiplies its vectors with the block through the block's concepts, and keeps only the best of each asked vector, so
    that what is shuffled is bounded by tasks, asked vectors and ``limit``, not by pairs."""
    spark = vectors.sparkSession
    ship(spark)
    one = F.struct(F.col(concept).cast("long").alias("c"), F.col(weight).cast("double").alias("w"))
    packed = kept(vectors.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("v")).select(key, F.col("v.c").alias("c"), F.col("v.w").alias("w")), "packed")
    asked = kept(packed.join(ids.select(key).distinct(), key, "left_semi"), "asked")
    kind = packed.schema[key].dataType
    fields = T.StructType([T.StructField("a", kind), T.StructField("other", kind), T.StructField("cosine", T.DoubleType())])
    out = None
    for part in blocks_of(asked, key, block):
        sent = spark.sparkContext.broadcast(part)
        found = kept(spread(packed).mapInArrow(nearest(sent, limit, key), fields), "nearest")
        out = found if out is None else out.unionByName(found)
        sent.unpersist()
    if out is None:
        out = spark.createDataFrame([], fields)
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "other")
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select(F.col("a").alias(key), "other", "cosine")


def blocks_of(asked: DataFrame, key: str, most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Asked vectors in blocks: their keys and norms, and their concepts in order with the place of the vector and the weight."""

    def block(rows: list) -> tuple:
        c = np.concatenate([np.array(r.c, dtype=np.int64) for r in rows])
        w = np.concatenate([np.array(r.w, dtype=np.float64) for r in rows])
        i = np.repeat(np.arange(len(rows)), [len(r.c) for r in rows])
        order = np.argsort(c, kind="stable")
        return [r[key] for r in rows], np.sqrt(np.bincount(i, w * w, len(rows))), c[order], i[order], w[order]

    rows, size = [], 0
    for r in asked.toLocalIterator():
        if rows and size + len(r.c) > most:
            yield block(rows)
            rows, size = [], 0
        rows.append(r)
        size += len(r.c)
    if rows:
        yield block(rows)


def parts_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes add up to ``most`` at most, or of one place."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def best_of(cosine: np.ndarray, a: np.ndarray, other: np.ndarray, limit: int) -> np.ndarray:
    """The places of the best of each asked vector: by cosine to nine digits (none last), then by key."""
    order = np.lexsort((other, -np.nan_to_num(np.round(cosine, 9), nan=-np.inf), a))
    first = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < limit]


def nearest(sent, limit: int, key: str):
    """What a task does with a block: dot products through shared concepts, and the best of each asked vector at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, norms, concepts, places, weights = sent.value
        n, kind = len(keys), None
        a, cosine, other = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object)
        for batch in batches:
            kind = batch.schema.field(key).type
            step = max(1, PAIRS // n)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = np.array(part.column(part.schema.names.index(key)).to_pylist(), dtype=object)
                c, w = (part.column(part.schema.names.index(x)) for x in ("c", "w"))
                row = np.repeat(np.arange(len(ids)), c.value_lengths().to_numpy(zero_copy_only=False))
                c, w = c.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)
                norm = np.sqrt(np.bincount(row, w * w, len(ids)))
                lo, hi = np.searchsorted(concepts, c), np.searchsorted(concepts, c, side="right")
                dot, shared = np.zeros(len(ids) * n), np.zeros(len(ids) * n, dtype=bool)
                for k, end in parts_of(hi - lo, PAIRS):
                    few = hi[k:end] - lo[k:end]
                    whose = np.repeat(np.arange(k, k + len(few)), few)
                    match = np.arange(len(whose)) - np.repeat(np.cumsum(few) - few, few) + lo[whose]
                    pair = row[whose] * n + places[match]
                    dot += np.bincount(pair, w[whose] * weights[match], len(dot))
                    shared[pair] = True
                pair = np.flatnonzero(shared)
                x, y = pair // n, pair % n
                mine = np.array(keys, dtype=object)
                pair, x, y = (v[ids[x] != mine[y]] for v in (pair, x, y))
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = dot[pair] / (norm[x] * norms[y])
                value[~np.isfinite(value)] = np.nan
                a, cosine, other = np.concatenate([a, y]), np.concatenate([cosine, value]), np.concatenate([other, ids[x]])
                top = best_of(cosine, a, other, limit)
                a, cosine, other = a[top], cosine[top], other[top]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], kind), pa.array(list(other), kind), pa.array(cosine, mask=np.isnan(cosine))], ["a", "other", "cosine"])

    return run


def quick_scores(pairs: DataFrame, vectors: DataFrame, key: str = "id", concept: str = "concept", weight: str = "weight") -> DataFrame:
    """(a, b, cosine) of stored vectors; 0 where none is shared."""
    return cosines(pairs, vectors.select(F.col(key), F.col(concept).alias("doc_id"), F.col(weight).alias("score")), key).withColumn("cosine", F.coalesce(F.nanvl("cosine", F.lit(0.0)), F.lit(0.0)))


def relevance(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, term, score) of the asked pairs, 0 where the document hasn't the term."""
    return pairs.join(postings, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("score", F.lit(0.0)).alias("score"))


def weighted_query(queries: DataFrame, scores: DataFrame, index: Index, key: str = "item_id", digits: int = 4) -> DataFrame:
    """(key, query): the text's terms in order as term^weight, the weight being the score's root by how often the term occurs."""
    rows = token_rows(queries, index.analyzer, key)
    n = F.count("*").over(Window.partitionBy(key, "term"))
    one = rows.withColumn("n", n).join(scores.select(key, "term", "score"), [key, "term"])
    part = F.concat("term", F.lit("^"), F.round(F.pow("score", F.lit(1.0) / F.col("n")), digits).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("p"))))
    return one.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), " ").alias("query"))
