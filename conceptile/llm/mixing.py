"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order drawn from a hash of their ids, are cut into blocks. The i-th block of a source of weight w
is released at slot floor((i - 1) / w) and due by ceil(i / w); in each slot the released block that is due first is taken. So
every source is less than one block away from its share at all times. Weights are taken as they are given, as exact fractions:
nothing is rounded, however long the schedule. When a source has no more blocks, the weights of the others are scaled up and a
new phase begins; no document is dropped or repeated.

Numbers within sources come from range-partitioned rows, so that a source with a third of all rows is no hot group; the
schedule is a table of all blocks, a row for each ``BLOCK_ROWS`` documents, made on the driver and joined as Spark's own
threshold has it. It has ``MOST_BLOCKS`` rows at most, and one for each source: larger corpora have larger blocks, so that the
driver's work is bounded, and the deviation is below one block at any size.

Defined cases: a null source is a source; sources without a weight in ``weights``, or with one that is not positive, come after
all others, mixed by their square-root sizes; a null doc_id is ordered first; rows that repeat an id are placed each; texts are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, table

BLOCK_ROWS, PERIOD, MOST_BLOCKS = 64, 1024, 1 << 20


def quanta(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole parts of the period in proportion to the weights, at least 1 each, by largest remainders; ties by name."""
    total, spare = sum(weights.values()), period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(parts: Mapping[str, int]) -> list[str]:
    """Who gets each slot of a period: earliest deadline first among the released; ties go to the larger weight, then the name."""
    period = sum(parts.values())
    waiting = [(0, -(-period // q), -q, s, 1) for s, q in parts.items()]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, minus, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, minus, s, i))
        due, minus, s, i = heapq.heappop(ready)
        assert slot < due, "a deadline is missed"
        out.append(s)
        if i < -minus:
            heapq.heappush(waiting, (i * period // -minus, -(-(i + 1) * period // -minus), minus, s, i + 1))
    return out


def phases(rows: Mapping[str, int], weights: Mapping[str, float], block: int, period: int = PERIOD) -> list[tuple]:
    """(source, phase, first block, blocks, parts, period, first slot, slots within the period, missing rows before) for all, with
    weights cut to parts of a period: equal to ``blocks_in_turn`` only where the parts are exact or the schedule is short."""
    left = {s: -(-n // block) for s, n in rows.items() if n}
    done, out, slot, missing, phase = dict.fromkeys(left, 0), [], 0, 0, 0
    while left:
        target = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: rows[s] ** 0.5 for s in left}
        length = max(period, 4 * len(target))
        parts = quanta(target, length)
        places: dict[str, list[int]] = {s: [] for s in parts}
        for i, s in enumerate(one_period(parts)):
            places[s].append(i)
        ends = {s: (left[s] - 1) // parts[s] * length + places[s][(left[s] - 1) % parts[s]] + 1 for s in parts}
        end, short = min(ends.values()), 0
        for s in sorted(parts):
            n = end // length * parts[s] + sum(p < end % length for p in places[s])
            if n:
                out.append((s, phase, done[s], n, parts[s], length, slot, places[s], missing))
            done[s] += n
            left[s] -= n
            if not left[s]:
                short = -rows[s] % block  # its last block is the phase's last slot
                del left[s]
        slot, missing = slot + end, missing + short
        phase += 1
    return out


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def blocks_in_turn(rows: Mapping[str, int], weights: Mapping[str, float], block: int) -> tuple[list[str], dict[str, np.ndarray]]:
    """The sources, and for all blocks in the order of their slots: source (its number), phase, block, missing rows before.

    A slot is taken as in ``one_period``, with weights that are not cut to parts of a period. First blocks of a phase are due in the
    order of the weights, so that a source is looked at only when its turn may come: work is by blocks, not by sources and phases."""
    names = sorted(s for s, n in rows.items() if n)
    left = {s: -(-rows[s] // block) for s in names}
    number, done, phase, missing = {s: i for i, s in enumerate(names)}, dict.fromkeys(names, 0), 0, 0
    out = {"source": array("i"), "phase": array("i"), "block": array("q"), "missing": array("q")}
    for group in ({s: weights[s] for s in names if weights.get(s, 0) > 0}, {s: rows[s] ** 0.5 for s in names if not weights.get(s, 0) > 0}):
        parts = whole(group) if group else {}
        total, alive = sum(parts.values()), sorted(parts, key=lambda s: (-parts[s], s))
        while alive:
            waiting: list = []
            ready: list = []
            first, slot = 0, 0
            while True:
                while waiting and waiting[0][0] <= slot:
                    heapq.heappush(ready, heapq.heappop(waiting)[1:])
                turn = None
                if first < len(alive):
                    q = parts[alive[first]]
                    turn = (-(-total // q), -q, alive[first], 1)
                if turn and (not ready or turn < ready[0]):
                    first += 1
                else:
                    turn = heapq.heappop(ready)
                due, minus, s, i = turn
                assert slot < due, "a deadline is missed"
                for name, x in zip(out, (number[s], phase, done[s], missing), strict=True):
                    out[name].append(x)
                done[s] += 1
                left[s] -= 1
                slot += 1
                if not left[s]:
                    missing += -rows[s] % block  # its last block is the phase's last slot
                    total += minus
                    alive.remove(s)
                    break
                heapq.heappush(waiting, (i * total // -minus, -(-(i + 1) * total // -minus), minus, s, i + 1))
            phase += 1
    return names, {k: np.frombuffer(v, dtype=v.typecode) if len(v) else np.zeros(0, v.typecode) for k, v in out.items()}


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK_ROWS, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (doc_id and source) with phase, block, slot and position: the place of the row in the mixture, gapless from 0.

    Without weights, sources weigh as the square roots of their sizes. Blocks have ``block`` rows, or more where there would be more
    than ``MOST_BLOCKS`` of them (and one for each source).
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    columns = columns or ["doc_id", "source"]
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), source_key(F.col("source")).alias("key"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    ranked, counts = numbered(scratch, rows, "key", ["h", "id"], "mixing", narrow=False)
    sizes = {r.key: r.n for r in counts.collect()}  # one row for each source
    target = {s: n**0.5 for s, n in sizes.items()} if weights is None else {"" if s is None else f"={s}": w for s, w in weights.items()}
    block = max(block, -(-sum(sizes.values()) // MOST_BLOCKS))
    names, plan = blocks_in_turn(sizes, target, block)
    source = pa.DictionaryArray.from_arrays(pa.array(plan["source"]), pa.array(names, pa.string())).dictionary_decode()
    turns = pa.table({"key": source, "block": plan["block"], "phase": plan["phase"], "slot": np.arange(len(source)), "missing": plan["missing"]})
    schedule = scratch.keep(spark.createDataFrame(turns), "schedule")
    at = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long")).join(schedule, ["key", "block"])
    out = at.withColumn("position", F.col("slot") * block + F.col("rank") % block - F.col("missing"))
    return out.select("row.*", *[F.col(c).cast("long").alias(c) for c in ("phase", "block", "slot", "position")])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: parts hold ranges of positions, and are sorted. Written, the order is that of the files and of the
    rows in them, from which the next stage takes each document's position (``common.in_order``)."""
    renamed = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source")
    placed = mixed(renamed, columns=["doc"])
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("doc.*")


def op6_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
