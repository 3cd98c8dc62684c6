"""Head-office establishments and their join to companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.fixed import HEADQUARTERS_FLAG
from regidx.operators.keyed import keep_first
from regidx.sources.delimited import FILE_ORDER

HEADQUARTERS_COLUMNS = ("cnpj_basico", "uf", "cnae_fiscal_principal", "situacao_cadastral")


def row_cap(limit: int | None) -> int | None:
    """A positive cap, or None for no cap (null, zero or negative)."""
    return limit if limit and limit > 0 else None


def first_rows(df: DataFrame, limit: int | None, order: str = FILE_ORDER) -> DataFrame:
    """The first ``limit`` rows in reading order; all rows without a cap."""
    cap = row_cap(limit)
    return df if cap is None else df.orderBy(order).limit(cap)


def is_headquarters(flag: Column) -> Column:
    return F.trim(flag) == HEADQUARTERS_FLAG


def headquarters(establishments: DataFrame, limit: int | None = None) -> DataFrame:
    """Head offices, capped before the first row per root is kept."""
    offices = establishments.filter(is_headquarters(F.col("identificador_matriz_filial"))).select(
        *HEADQUARTERS_COLUMNS, FILE_ORDER
    )
    return keep_first(first_rows(offices, limit), ["cnpj_basico"], FILE_ORDER).drop(FILE_ORDER)


def companies_with_office(companies: DataFrame, offices: DataFrame) -> DataFrame:
    """Companies that have a head office row (semi join)."""
    return companies.join(offices, "cnpj_basico", "left_semi")


def add_office(companies: DataFrame, offices: DataFrame) -> DataFrame:
    """Left join; the right side is unique, so no row is multiplied."""
    return companies.join(offices, "cnpj_basico", "left")
