"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; texts of ASCII alone take the fast way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns (in any letter case) that an operator is about to add."""
    taken = {name.lower() for name in names}
    clash = [column for column in df.columns if column.lower() in taken]
    return df.select(*[f"`{column}`" for column in df.columns if column not in clash]) if clash else df


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Two join columns: equal for rows of the same id and text, never null, so repeated or null ids join once."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"),
        F.xxhash64(F.col(id_column).isNull(), F.col(text_column).isNull(), F.col(text_column)).alias("_row"),
    ]
