"""Continuous ingestion: a stream of documents into a knowledge base, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.knowledge_base import KnowledgeBase


def ingest(stream: DataFrame, kb: KnowledgeBase, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is one commit. A batch that is run again after a failure finds its documents unchanged and skips them."""

    def commit(batch: DataFrame, number: int) -> None:
        have = kb.store.documents().select("document_id", F.col("content_hash").alias("_have"))
        rows = batch.where("text IS NOT NULL").join(have, "document_id", "left")
        rows = rows.where("_have IS NULL OR _have <> sha2(text, 256)").drop("_have")
        if rows.head(1):
            kb.add(rows)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
