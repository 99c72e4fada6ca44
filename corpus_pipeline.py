"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), calls one operator over all that its predecessor kept, and returns the columns of the
documents; the last one adds the shards and the positions in the mixture. Between stages the documents are written as Parquet to the
shared folder and read again, so that a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conceptile.llm.common import Scratch, table
from conceptile.llm.decontamination import decontamination_stage
from conceptile.llm.mixing import mixing_stage
from conceptile.llm.near_duplicates import dedup_stage
from conceptile.llm.quality_rules import quality_stage
from conceptile.llm.sharding import sharding_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: None: learned rules, components of links and schedules are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
