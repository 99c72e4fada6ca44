"""New documents scored as they come, against an index that stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index
from ..operators.vectors import PruneSpec, concept_vectors, query_weights


def score_stream(docs: DataFrame, index: Index, path: str, checkpoint: str, key: str = "doc_id", prune: PruneSpec = PruneSpec(limit=100)):
    """Starts a query that writes the concept vectors of each batch of a stream of (key, text) as (key, doc_id, score). The index's statistics are
    frozen, so a batch depends on nothing but its own rows; a batch that is run again writes the same part again."""

    def write(batch: DataFrame, number: int) -> None:
        texts = batch.select(F.col(key).alias("key"), "text")
        vectors = concept_vectors(query_weights(texts, index, key="key"), index.postings, prune, "key")
        vectors.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
