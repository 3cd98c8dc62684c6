"""One row per key, and best rows per group.

Every function here ranks with a bounded ``row_number``, which Spark also
applies before the shuffle (``WindowGroupLimit``): a task never sends more than
``k`` rows per group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regidx.fixed import SOURCES

_RANK = "_rank"


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` keeps the 1-based position."""
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(_RANK) <= k)
    return kept.withColumnRenamed(_RANK, rank) if rank else kept.drop(_RANK)


def spread_best_per_group(
    df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None, spread: int = 1
) -> DataFrame:
    """``best_per_group`` in two steps for few, very large groups.

    Each input partition belongs to one of ``spread`` slices; a slice is reduced
    to ``k`` rows per group first, so the final task sees ``spread * k`` rows.
    """
    if spread <= 1:
        return best_per_group(df, group, order, k, rank)
    sliced = df.withColumn("_slice", F.spark_partition_id() % spread)
    partial = best_per_group(sliced, [*group, "_slice"], order, k).drop("_slice")
    return best_per_group(partial, group, order, k, rank)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key in an explicit order (reading order of the file)."""
    return best_per_group(df, keys, [F.col(order).asc_nulls_last()], 1)


def latest_per_key(df: DataFrame, key: str, stamp: str, tie: str) -> DataFrame:
    """Newest row of each key."""
    return best_per_group(df, [key], [F.col(stamp).desc_nulls_first(), F.col(tie).asc()], 1)


def source_ordinal(source: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    """Position of a source in resolution order; unknown sources come last."""
    position = F.array_position(F.array(*[F.lit(name) for name in sources]), source)
    return F.when(position > 0, position).otherwise(len(sources) + 1)


def dedupe_chunks(chunks: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """One chunk per (key, text); the earliest source in resolution order wins."""
    hashed = chunks.withColumn("_digest", F.md5("text"))
    order = [
        source_ordinal(F.col("metadata.source"), sources).asc(),
        F.col("embed_text").asc(),
        F.to_json("metadata").asc(),
    ]
    return best_per_group(hashed, ["cnpj", "_digest"], order, 1).drop("_digest")
