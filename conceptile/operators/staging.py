"""Tables between the steps of a job, in the folder that all executors share, and rows numbered in order without a hot group."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine, a folder of our own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='conceptile-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(removed, spark, root)
    return root


def removed(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended: whoever owns the folder clears it
        pass


def fresh(spark: SparkSession, name: str) -> str:
    """A new path for a table, removed at the end."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame, written and read again: computed once, and independent of any executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where a scan has fewer parts than cores, as one small file has; anything larger stays as it is."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # it is shuffled anyway
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def placed(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The rows range-partitioned by (by, order) and written with ``_part``, the number of their range: a group of any size is
    cut into ranges of bounded size, and only the first group of a range can have begun in an earlier one."""
    return kept(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "placed")


def carried(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, _part, values): aggregates per range, summed over the earlier ranges of the same group; only for ranges whose group has
    earlier ones. At most one row for each range, so that it can be broadcast whatever the data."""
    group = by or [F.lit(0)]
    parts = rows.groupBy(*by, "_part").agg(*[v.alias(k) for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.withColumn("_n", F.count("*").over(before)).withColumns({k: F.sum(k).over(before) for k in values})
    return F.broadcast(sums.where("_n > 0").drop("_n"))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """The columns with ``_part`` and the rank from 1 in each group: ranks within ranges, and counts of the ranges before."""
    rows = placed(df, by, order)
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    base = carried(rows, by, {"_base": F.count("*")})
    at = rows.withColumn("_at", F.row_number().over(within)).join(base, [*by, "_part"], "left")
    return at.withColumn(name, (F.col("_at") + F.coalesce("_base", F.lit(0))).cast("long")).select(*df.columns, "_part", name)
