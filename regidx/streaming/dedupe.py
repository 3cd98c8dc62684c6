"""De-duplication of a chunk stream by company key and text, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.functions.text import first_filled
from regidx.schemas import CHUNK

KEY = ("cnpj", "text_md5")
STAMP = "loaded_at"


def stamped_chunk_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Chunk files whose rows also carry ``loaded_at``, the time they were produced."""
    schema = T.StructType([*CHUNK.fields, T.StructField(STAMP, T.TimestampType())])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("embed_text", F.coalesce(first_filled(F.col("embed_text")), F.col("text")))


def first_seen(chunks: DataFrame, delay: str) -> DataFrame:
    """The first row of each (key, text digest) in the stream.

    A row is late and dropped if its stamp is more than ``delay`` behind the newest one of the batches before the last
    (Spark judges lateness by the last batch's watermark); so is a row without a stamp. A key is remembered until the watermark passes its first stamp by ``delay``, then its state
    goes, so the state holds the keys of about twice the delay, not of the whole stream; a repeat
    after that counts as new. What the index does with it is an idempotent upsert.
    """
    hashed = chunks.where(F.col(STAMP).isNotNull()).withColumn("text_md5", F.md5("text"))
    return hashed.withWatermark(STAMP, delay).dropDuplicatesWithinWatermark(list(KEY))
