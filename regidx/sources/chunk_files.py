"""Chunks as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regidx.functions.text import first_filled
from regidx.schemas import CHUNK
from regidx.session import empty_frame, matching_paths


def save_chunks(chunks: DataFrame, path: str) -> str:
    """Four keys per line; absent optional metadata is left out."""
    chunks.select("cnpj", "text", "metadata", "embed_text").write.mode("overwrite").json(path)
    return path


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped; a missing ``embed_text`` falls back to ``text``."""
    if not matching_paths(spark, path):
        return empty_frame(spark, CHUNK)
    rows = spark.read.schema(CHUNK).json(path)
    no_metadata = F.from_json(F.lit("{}"), CHUNK["metadata"].dataType)
    return rows.select(
        "cnpj",
        "text",
        F.coalesce(first_filled(F.col("embed_text")), F.col("text")).alias("embed_text"),
        F.coalesce("metadata", no_metadata).alias("metadata"),
    )

