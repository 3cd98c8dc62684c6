"""Counts and dashboard aggregates over the index table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regidx.fixed import DASHBOARD_OTHER, EMBEDDING_DIM, SOURCES, UNKNOWN_SOURCE
from regidx.functions.codes import dashboard_size
from regidx.functions.text import filled_or, first_filled
from regidx.operators.predicates import optional_match, where_all


def _count():
    return F.count(F.lit(1))


def total_rows(index: DataFrame) -> DataFrame:
    return index.agg(_count().alias("total_embeddings"))


def distinct_companies(index: DataFrame) -> DataFrame:
    return index.agg(F.count_distinct("cnpj").alias("total_companies"))


def last_ingestion(index: DataFrame) -> DataFrame:
    return index.agg(F.max("created_at").alias("last_ingestion"))


def count_by(df: DataFrame, column, name: str, total: str = "total") -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    counted = df.groupBy(column.alias(name)).agg(_count().alias(total))
    return counted.orderBy(F.desc(total), F.asc_nulls_last(name))


def by_source_named(index: DataFrame) -> DataFrame:
    return count_by(index, filled_or(F.col("metadata.source"), UNKNOWN_SOURCE), "source")


def by_source(index: DataFrame) -> DataFrame:
    return count_by(index, F.col("metadata.source"), "fonte")


def top_states(index: DataFrame, most: int = 10) -> DataFrame:
    known = index.filter(F.col("metadata.uf").isNotNull())
    return count_by(known, F.col("metadata.uf"), "estado").limit(most)


def by_size(index: DataFrame) -> DataFrame:
    return count_by(index, dashboard_size(F.col("metadata.porte_cod")), "porte")


def by_size_description(index: DataFrame) -> DataFrame:
    return count_by(index, F.col("metadata.porte"), "porte")


def participants_by_segment(index: DataFrame) -> DataFrame:
    participants = index.filter(F.col("source") == SOURCES[2])
    segment = filled_or(first_filled(F.col("metadata.segmento")), DASHBOARD_OTHER)
    return count_by(participants, segment, "segmento", "participantes")


def source_names(index: DataFrame) -> DataFrame:
    named = index.select(F.col("metadata.source").alias("source")).filter(F.col("source") != "")
    return named.distinct().orderBy("source")


def company_dashboard(
    index: DataFrame, state: str | None = None, activity: str | None = None, status: str | None = None,
    most: int = 200,
) -> DataFrame:
    """The companies with the largest capital; null parameters do not filter."""
    rows = where_all(
        index,
        optional_match(F.col("metadata.uf"), state),
        optional_match(F.col("metadata.cnae"), activity),
        optional_match(F.col("metadata.situacao"), status),
    )
    return (
        rows.select(
            F.col("metadata.razao_social").alias("empresa"),
            F.col("metadata.cnpj_formatado").alias("cnpj"),
            F.col("metadata.uf").alias("uf"),
            F.col("metadata.cnae").alias("cnae"),
            F.col("metadata.situacao").alias("situacao"),
            F.col("metadata.capital_social").try_cast("decimal(20,2)").alias("capital_social"),
        )
        .orderBy(F.desc_nulls_first("capital_social"), F.asc_nulls_last("cnpj"))
        .limit(most)
    )


def participant_dashboard(index: DataFrame) -> DataFrame:
    return (
        index.filter(F.col("source") == SOURCES[2])
        .select(
            F.col("metadata.razao_social").alias("instituicao"),
            F.col("metadata.municipio").alias("municipio"),
            F.col("metadata.situacao").alias("status"),
        )
        .orderBy(F.asc_nulls_last("instituicao"), F.asc_nulls_last("municipio"), F.asc_nulls_last("status"))
    )


def stats_long(index: DataFrame, top: int = 10) -> DataFrame:
    """``kind, key, total, stamp``: totals, rows per source and rows per state.

    The table is read once for a (source, state) pre-aggregate; grouping sets then
    run on that. Distinct keys need the second, single-column read.
    """
    small = index.groupBy(
        filled_or(F.col("metadata.source"), UNKNOWN_SOURCE).alias("source"), F.col("metadata.uf").alias("uf")
    ).agg(_count().alias("n"), F.max("created_at").alias("newest"))
    return long_of(small, distinct_companies(index), top)


def long_of(small: DataFrame, companies: DataFrame, top: int = 10) -> DataFrame:
    """``stats_long`` out of partial counts (source, uf, n, newest) and the one-row number of companies."""
    source, state = F.col("source"), F.col("uf")
    kind = (
        F.when(F.grouping("source") == 0, "source").when(F.grouping("uf") == 0, "state").otherwise("rows")
    )
    grouped = small.groupingSets([[], [source], [state]], source, state).agg(
        kind.alias("kind"),
        F.sum("n").alias("total"),
        F.max("newest").alias("stamp"),
    )
    keyed = grouped.select("kind", F.coalesce("source", "uf").alias("key"), "total", "stamp")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("total"), F.asc("key")))
    ranked = keyed.filter((F.col("kind") != "state") | F.col("key").isNotNull()).withColumn("place", place)
    rows = ranked.filter((F.col("kind") != "state") | (F.col("place") <= top)).drop("place")
    counted = companies.select(
        F.lit("companies").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("total_companies").alias("total"),
        F.lit(None).cast("timestamp").alias("stamp"),
    )
    return rows.unionByName(counted)


def stats_record(index: DataFrame, dimension: int = EMBEDDING_DIM, top: int = 10) -> DataFrame:
    """One row with all statistics; maps are ordered by count."""
    return record_of(stats_long(index, top), dimension)


def record_of(long: DataFrame, dimension: int = EMBEDDING_DIM) -> DataFrame:

    def one(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    def ordered(kind: str):
        entry = F.struct((-F.col("total")).alias("o"), F.col("key").alias("key"), F.col("total").alias("value"))
        entries = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry)))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))

    return long.agg(
        F.coalesce(one("companies", "total"), F.lit(0)).alias("total_companies"),
        F.coalesce(one("rows", "total"), F.lit(0)).alias("total_embeddings"),
        ordered("source").alias("by_source"),
        ordered("state").alias("top_uf"),
        one("rows", "stamp").alias("last_ingestion"),
    ).select(
        "total_companies",
        "total_embeddings",
        F.array_sort(F.map_keys("by_source")).alias("sources"),
        "by_source",
        "top_uf",
        "last_ingestion",
        F.lit(dimension).alias("embedding_dim"),
    )


def iso_stamp(column: str = "last_ingestion"):
    """Timestamp as ISO-8601 text, null-safe."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
