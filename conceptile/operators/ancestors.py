"""Whether one node lies above another, for many pairs at once.

Nodes with few others above them (``NARROW`` at most, itself included) have the whole set, found by doubling: in each round the sets of
the farthest nodes known are added, so that a path of n steps takes log2(n) rounds. Pairs whose lower node is such a one are decided by
its set. For the others every node has a label of fixed size, the hashed bits of all nodes above it and its own; labels are passed down the edges until none
changes, cycles included. A pair whose upper node's bit isn't in the lower node's label is decided without a search. The rest are
searched upwards together, only through nodes without a whole set whose label still has the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh, removed

BITS = 512
NARROW = 32


class Table:
    """One table of a round at a time: writing the next removes the last."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def put(self, df: DataFrame) -> DataFrame:
        spark, old, self.path = df.sparkSession, self.path, fresh(df.sparkSession, self.name)
        df.write.parquet(self.path)
        if old:
            removed(spark, old)
        return spark.read.schema(df.schema).parquet(self.path)


def words(bits: int) -> list[str]:
    return [f"_l{i}" for i in range(bits // 64)]


def bit(node: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(bits)).cast("int")


def has(node: Column, bits: int, prefix: str = "") -> Column:
    """Whether the label in the columns has the node's bit."""
    at = bit(node, bits)
    word = F.array(*[F.col(prefix + c) for c in words(bits)])[F.floor(at / 64).cast("int")]
    return F.bit_get(word, at % 64) == 1


def labels(edges: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, label's words) of all nodes of the edges (parent, child). Each round passes on only what the last one changed."""
    names = words(bits)
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).where("node is not null").distinct()
    at = bit(F.col("node"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)
    own = lambda i: F.when(F.floor(at / 64) == i, one).otherwise(F.lit(0).cast("long"))
    every, front = Table("labels"), Table("front")
    known = every.put(nodes.select("node", *[own(i).alias(c) for i, c in enumerate(names)]))
    changed = known
    while True:
        down = changed.join(edges, changed["node"] == edges["parent"]).groupBy(F.col("child").alias("node")).agg(*[F.bit_or(c).alias(f"_m{c}") for c in names])
        merged = known.join(down, "node", "left")
        new = [F.coalesce(F.col(c).bitwiseOR(F.col(f"_m{c}")), F.col(c)).alias(c) for c in names]
        grows = F.coalesce(F.greatest(*[(F.col(c).bitwiseOR(F.col(f"_m{c}")) != F.col(c)).cast("int") for c in [*names, names[0]]]), F.lit(0)) == 1
        moved = front.put(merged.where(grows).select("node", *new))
        if moved.isEmpty():
            return known
        known = every.put(known.join(moved.select("node"), "node", "left_anti").unionByName(moved))
        changed = moved


def above(edges: DataFrame, most: int = NARROW) -> DataFrame:
    """(node, up) of all nodes of the different edges (parent, child): the node and all above it; null where that is over ``most`` nodes.
    After k doublings ``up`` has what is at most 2^k steps above and ``front`` what is exactly so many: beyond lies only what is above
    the front."""
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    steps = edges.where("parent <> child")
    degree = steps.groupBy(F.col("child").alias("node")).agg((F.count("*") >= most).alias("wide"))
    few = steps.withColumnRenamed("child", "node").join(degree.where("not wide"), "node", "left_semi").groupBy("node").agg(F.collect_list("parent").alias("front"))
    none, own = F.slice(F.array("node"), 1, 0), F.array("node")
    first = nodes.join(degree, "node", "left").join(few, "node", "left").withColumn("front", F.coalesce("front", none))
    table = Table("above")
    known = table.put(first.select("node", F.when(~F.coalesce("wide", F.lit(False)), F.concat(own, "front")).alias("up"), "front"))
    while not known.where(F.size("front") > 0).isEmpty():
        far = known.select(F.col("node").alias("_m"), F.col("up").alias("_up"), F.col("front").alias("_front"))
        met = known.select("node", F.explode("front").alias("_m")).join(far, "_m")
        lists = [F.flatten(F.collect_list(c)).alias(n) for c, n in ((F.col("_up"), "_up"), (F.col("_front"), "_front"), (F.array_except("_up", "_front"), "_nearer"))]
        more = met.groupBy("node").agg(F.max(F.col("_up").isNull()).alias("_wide"), *lists)
        whole = F.when(F.col("_wide").isNull(), F.col("up")).when(~F.col("_wide"), F.array_union("up", "_up"))
        fresh_ = F.array_except(F.array_except("_front", "up"), "_nearer")
        grown = known.join(more, "node", "left").select("node", whole.alias("up"), F.when(F.col("_wide"), none).otherwise(F.coalesce(fresh_, none)).alias("front"))
        fits = F.size("up") <= most
        known = table.put(grown.select("node", F.when(fits, F.col("up")).alias("up"), F.when(fits, F.col("front")).otherwise(none).alias("front")))
    return known.select("node", "up")


def are_ancestors(pairs: DataFrame, edges: DataFrame, bits: int = BITS, most: int = NARROW) -> DataFrame:
    """(node, ancestor, holds) of the different pairs (node, ancestor): whether edges (parent, child) lead down from the ancestor to the node. Every
    node is its own; of nodes without edges nothing else holds; null is no node."""
    if bits % 64 or bits < 64:
        raise ValueError("labels have whole words of 64 bits")
    edges = Table("edges").put(edges.select("parent", "child").where("parent is not null and child is not null").distinct())
    sets = above(edges, most)
    asked = pairs.select("node", "ancestor").where("node is not null and ancestor is not null").distinct()
    known = asked.join(sets.withColumn("_in", F.lit(True)), "node", "left")
    holds = F.when((F.col("node") == F.col("ancestor")), True).when(F.col("_in").isNull(), False).otherwise(F.array_contains("up", F.col("ancestor")))
    decided = Table("decided").put(known.select("node", "ancestor", holds.alias("holds")))
    rest = decided.where("holds is null").select("node", "ancestor")
    if rest.isEmpty():
        return decided
    return decided.where("holds is not null").unionByName(searched(rest, edges, sets, bits))


def searched(asked: DataFrame, edges: DataFrame, sets: DataFrame, bits: int) -> DataFrame:
    """The same for different pairs of different nodes by labels and a search, which ends at nodes with a whole set."""
    label = Table("known").put(labels(edges, bits).join(sets, "node"))
    own = F.array_contains("up", F.col("ancestor"))
    able = asked.join(label, "node").where(has(F.col("ancestor"), bits)).select("node", "ancestor")
    front_of, seen_of, found_of = Table("front"), Table("seen"), Table("found")
    front = front_of.put(able.select("node", "ancestor", F.col("node").alias("at")))
    seen = seen_of.put(front)
    found = found_of.put(asked.limit(0))
    over = edges.where("parent <> child").select(F.col("parent").alias("_up"), F.col("child").alias("at"))
    while not front.isEmpty():
        step = Table("step")
        up = front.join(over, "at").select("node", "ancestor", F.col("_up").alias("at")).distinct().join(label.withColumnRenamed("node", "at"), "at")
        up = step.put(up.where(has(F.col("ancestor"), bits)).select("node", "ancestor", "at", ((F.col("at") == F.col("ancestor")) | F.coalesce(own, F.lit(False))).alias("yes"), F.col("up").isNotNull().alias("ends")))
        found = found_of.put(found.unionByName(up.where("yes").select("node", "ancestor").distinct()))
        open_ = up.where("not yes and not ends").select("node", "ancestor", "at")
        front = front_of.put(open_.join(found, ["node", "ancestor"], "left_anti").join(seen, ["node", "ancestor", "at"], "left_anti"))
        seen = seen_of.put(seen.join(found, ["node", "ancestor"], "left_anti").unionByName(front))
        removed(asked.sparkSession, step.path)
    return asked.join(found.withColumn("_yes", F.lit(True)), ["node", "ancestor"], "left").select("node", "ancestor", F.coalesce("_yes", F.lit(False)).alias("holds"))
