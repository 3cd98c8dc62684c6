"""Incremental index maintenance from a folder that keeps receiving chunk files.

Each micro-batch goes through the same upsert as a batch run, which is
idempotent: a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regidx.functions.text import first_filled
from regidx.operators.embedding import EncoderFactory, add_embedding
from regidx.operators.keyed import dedupe_chunks
from regidx.plans.index_table import IndexTable
from regidx.schemas import CHUNK


def chunk_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("embed_text", F.coalesce(first_filled(F.col("embed_text")), F.col("text")))


def keep_index_current(
    chunks: DataFrame, table: IndexTable, checkpoint: str, encoder: EncoderFactory | None = None
) -> StreamingQuery:
    """Start the stream; it stops by itself once all files present have been loaded."""

    def load(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            table.upsert(add_embedding(dedupe_chunks(batch), "embed_text", encoder))

    return (
        chunks.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
