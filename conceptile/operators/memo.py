"""Concept vectors of texts that are remembered: a text is projected once for an index and its options, whoever asks."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.vector_store import VectorStore, unpacked
from .index import Index
from .staging import kept
from .vectors import PruneSpec, concept_vectors, query_weights


class VectorMemo:
    """Vectors by the hash of their text and of what they hang on: analyzer, weights, pruning and the index's version, which the caller
    names (other contents, another name). Batches and streams may share a store: each adds what it was the first to see."""

    def __init__(self, store: VectorStore, index: Index, version: str, prune: PruneSpec = PruneSpec()):
        self.store, self.index, self.prune = store, index, prune
        spec = index.analyzer
        options = [version, repr(prune), repr(index.weights), *(f"{k}={sorted(v) if isinstance(v, frozenset) else v!r}" for k, v in sorted(vars(spec).items()))]
        self.options = hashlib.sha256("\n".join(options).encode()).hexdigest()

    def named(self, texts: DataFrame, key: str) -> DataFrame:
        return texts.select(key, "text", F.sha2(F.concat(F.lit(self.options), F.coalesce("text", F.lit(""))), 256).alias("id"))

    def vectors(self, texts: DataFrame, key: str = "item_id", batch: str | None = None, counter: Observation | None = None) -> DataFrame:
        """(key, doc_id, score) of the texts (key, text). ``counter`` observes how many texts were projected (``projected``); a batch that is
        named and is run again finds its texts remembered."""
        asked = kept(self.named(texts, key), "asked")
        new = asked.join(self.store.look_up(asked).select("id"), "id", "left_anti").groupBy("id").agg(F.first("text").alias("text")).withColumn("text_id", F.monotonically_increasing_id())
        new = kept(new.observe(counter, F.count("*").alias("projected")) if counter else new, "new")
        if not new.isEmpty():
            # a row for each text and concept is shuffled: with a number, not with the hash
            found = concept_vectors(query_weights(new, self.index, key="text_id"), self.index.postings, self.prune, "text_id", self.index.df)
            one = F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("c"), F.col("score").alias("w"))))
            packed = found.groupBy("text_id").agg(one.alias("v"))
            empty = lambda c, kind: F.coalesce(F.col(f"v.{c}"), F.array().cast(f"array<{kind}>")).alias(c)  # noqa: E731  no concept is an answer too
            self.store.write_packed(new.select("id", "text_id").join(packed, "text_id", "left").select("id", empty("c", "bigint"), empty("w", "double")), batch or uuid.uuid4().hex)
        rows = self.store.look_up(asked).join(asked.select(key, "id"), "id").select(F.col(key).alias("id"), "c", "w")
        return unpacked(rows).select(F.col("id").alias(key), F.col("concept").alias("doc_id"), F.col("weight").alias("score"))
