"""Filtered company listing, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.operators.keyed import latest_per_key
from regidx.operators.predicates import by_size, by_source, by_state, name_contains, where_all


def latest_companies(
    index: DataFrame, state: str | None = None, size: str | None = None, source: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Newest chunk of each company that passes the filters; vectors are not read."""
    rows = where_all(index, by_state(state), by_size(size), by_source(source), name_contains(name))
    columns = ["cnpj", "text_chunk", "metadata", "created_at", "chunk_id"]
    return latest_per_key(rows.select(*columns), "cnpj", "created_at", "chunk_id").drop("chunk_id")


def index_page(
    index: DataFrame, limit: int = 20, offset: int = 0, state: str | None = None, size: str | None = None,
    source: str | None = None, name: str | None = None,
) -> DataFrame:
    """A page of the newest chunks in key order, out of the index itself.

    Only keys are made distinct and sorted up to the page; its at most 200 keys then fetch their rows, so texts and
    metadata of other companies are not shuffled.
    """
    _check_page(limit, offset)
    rows = where_all(index, by_state(state), by_size(size), by_source(source), name_contains(name))
    keys = rows.select("cnpj").distinct().orderBy("cnpj").offset(offset).limit(limit)
    return latest_companies(rows.join(F.broadcast(keys), "cnpj", "left_semi")).orderBy("cnpj")


def _check_page(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 1..200 and offset must not be negative")


def company_page(companies: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page in key order. Every row before ``offset`` is sorted too; see ``company_page_after``."""
    _check_page(limit, offset)
    return companies.orderBy("cnpj").offset(offset).limit(limit)


def company_page_after(companies: DataFrame, last_key: str, limit: int = 20) -> DataFrame:
    """The page after a known key; the filter reaches the scan, so earlier rows are not read into the sort."""
    _check_page(limit)
    return companies.filter(F.col("cnpj") > last_key).orderBy("cnpj").limit(limit)


def company_items(companies: DataFrame) -> DataFrame:
    texts = ("cnpj_formatado", "razao_social", "uf", "porte", "porte_cod", "situacao", "cnae")
    return companies.select(
        "cnpj",
        *[F.coalesce(F.col(f"metadata.{name}"), F.lit("")).alias(name) for name in texts],
        F.coalesce(F.col("metadata.capital_social"), F.lit(0.0)).alias("capital_social"),
        F.coalesce(F.col("metadata.source"), F.lit("")).alias("source"),
    )
