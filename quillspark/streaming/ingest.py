"""Continuous indexing: a stream of document rows into chunk and posting tables.

Each micro-batch replaces the chunks of the documents it holds: it writes them
as the next version of a table of changes and then that version's marker, so
that a batch that is run again after a failure writes the same version anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.chunking import Limits, chunked_texts
from quillspark.operators.versions import ChangeTable


def latest(batch: DataFrame, version: str = "modified_at") -> DataFrame:
    """Of each document its newest row in the batch."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last(version), F.desc("text")))
    return batch.withColumn("rank", rank).where("rank = 1").drop("rank")


class ChunkTable(ChangeTable):
    """A chunk table that micro-batches of documents change; a batch writes its own chunks only."""

    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None):
        super().__init__(spark, path)
        self.limits = limits

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """The version batch_id + 1: chunks of the batch's documents, in place of their earlier ones."""
        docs = latest(batch)
        self.write(chunked_texts(docs, limits=self.limits), docs.select("doc_id"), batch_id + 1)


def ingest(stream: DataFrame, table: ChunkTable, checkpoint: str) -> StreamingQuery:
    """Takes what is there, in micro-batches, and ends."""
    writer = stream.writeStream.foreachBatch(lambda df, n: table.apply(df, n)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
