"""Templates expanded by joins: every block of pages gets the bodies that its own pages ask for, and no machine has all of them.

Which templates a text needs isn't known before it is expanded, as a name can come from a parameter. So a block is expanded with what it
has; the names that it missed are joined with the bodies, once for each block however many of its pages ask, and the pages that missed
some are expanded again. Each round reaches a level further, so that there are at most as many as the depth of expansion and two more.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import DEPTH, expand
from ..shipping import ship
from .staging import kept

BLOCK = 8 << 20  # bytes of text that are expanded together


class Known(Mapping):
    """The bodies that a block has, null for a name that no template has; says what it was asked for in vain."""

    def __init__(self, bodies: dict[str, str | None]):
        self.bodies, self.missed = bodies, set()

    def __contains__(self, name: object) -> bool:
        if name not in self.bodies:
            self.missed.add(name)
            return False
        return self.bodies[name] is not None

    def __getitem__(self, name: str) -> str | None:
        return self.bodies[name]

    def __iter__(self):
        return iter(self.bodies)

    def __len__(self) -> int:
        return len(self.bodies)


def by_rounds(pages: DataFrame, bodies: DataFrame, title: str, text: str, depth: int, most: int, own: bool, block: int) -> DataFrame:
    """The pages' columns as ``row``, and ``expanded``. ``own``: the pages are templates, which are open already and a level down."""
    size = pages.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // block))
    number = F.pmod(F.xxhash64(title, text), F.lit(blocks)).alias("block")
    rows = kept(pages.select(number, F.col(title).alias("title"), F.col(text).alias("text"), F.struct(*pages.columns).alias("row")), "pages")
    known = pages.sparkSession.createDataFrame([], "block long, name string, body string")
    fields = T.StructType([*rows.schema.fields, T.StructField("expanded", T.StringType()), T.StructField("missed", T.ArrayType(T.StringType()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        have = dict(zip(right["name"].to_pylist(), right["body"].to_pylist(), strict=True))
        out, missed = [], []
        for name, body in zip(left["title"].to_pylist(), left["text"].to_pylist(), strict=True):
            asked = Known(have)
            out.append(None if body is None else expand(body, name or "", asked, depth, most, frozenset([name]) if own else frozenset(), 2 if own else 1))
            missed.append(sorted(asked.missed))
        return left.append_column("expanded", pa.array(out, pa.string())).append_column("missed", pa.array(missed, pa.list_(pa.string())))

    done = None
    while True:
        tried = kept(rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, fields), "expanded")
        whole = tried.where(F.size("missed") == 0).select("row", "expanded")
        done = whole if done is None else done.unionByName(whole)
        left = tried.where(F.size("missed") > 0)
        if left.isEmpty():
            return done
        asked = left.select("block", F.explode("missed").alias("name")).distinct()
        known = kept(known.unionByName(asked.join(bodies, "name", "left").select("block", "name", "body")), "known")
        rows = left.drop("expanded", "missed")


def expanded_templates(bodies: DataFrame, depth: int = DEPTH, most: int = 0, block: int = BLOCK) -> DataFrame:
    """(name, body): templates, each with those that it uses expanded in it."""
    ship(bodies.sparkSession)
    named = kept(bodies.select("name", "body"), "bodies")
    return by_rounds(named, named, "name", "body", depth, most, True, block).select("row.name", F.col("expanded").alias("body"))


def expanded_pages(pages: DataFrame, bodies: DataFrame, title: str = "title", text: str = "text", depth: int = DEPTH, most: int = 0, block: int = BLOCK) -> DataFrame:
    """The pages with their text expanded, as ``TemplateTable.expanded`` does it, by joins; bodies are (name, body), names once each. Null texts
    stay null."""
    ready = kept(expanded_templates(bodies, depth, most, block), "templates")
    rows = by_rounds(pages, ready, title, text, depth, most, False, block)
    return rows.select(*[F.col("expanded").alias(c) if c == text else F.col("row")[c].alias(c) for c in pages.columns])
