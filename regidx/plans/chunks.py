"""One display text and one embedding text per company."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regidx.fixed import NOT_INFORMED, UNKNOWN_SOURCE
from regidx.functions.keys import key_mask
from regidx.functions.rendering import display_text, embedding_extras, embedding_text
from regidx.functions.text import clean_text, filled_or, first_filled
from regidx.operators.keyed import dedupe_chunks
from regidx.plans.registry import SourceRun, loaders, run_sources, to_registry, union_registry
from regidx.schemas import CHUNK, METADATA, OPTIONAL_METADATA


def _optional(name: str) -> Column:
    """An optional field, cleaned; null when absent, empty or the sentinel."""
    value = F.col(name)
    return F.when((value != "") & (value != NOT_INFORMED), clean_text(value))


def registry_to_chunks(registry: DataFrame, keys_checked: bool = False) -> DataFrame:
    """Chunk rows for every company that has a key and a name.

    ``keys_checked`` skips the key test for frames whose loader already applied it.
    """
    if not keys_checked:
        registry = registry.filter(F.col("cnpj") != "")
    names = ("c_name", "c_status", "c_activity", "c_size", "c_state", "c_capital", "c_source")
    fields = to_registry(registry).withColumns(
        {
            "c_name": clean_text(F.col("razao_social")),
            "c_status": clean_text(F.col("situacao_desc")),
            "c_activity": clean_text(first_filled(F.col("cnae_fiscal_principal"), F.col("setor_atividade"))),
            "c_size": clean_text(F.col("porte_desc")),
            "c_state": F.upper(clean_text(F.col("uf"))),
            "c_capital": F.coalesce(F.nanvl("capital_social_num", F.lit(0.0)), F.lit(0.0)),
            "c_source": filled_or(first_filled(F.col("source")), UNKNOWN_SOURCE),
        }
    ).filter(F.col("c_name") != NOT_INFORMED)
    name, status, activity, size, state, capital, source = (F.col(n) for n in names)

    extras = embedding_extras(activity, F.col("segmento"), size, F.col("municipio"), state, status)
    places = [f"c_extra{i}" for i in range(len(extras))]
    staged = fields.withColumns(dict(zip(places, extras)))
    metadata = {
        "razao_social": name,
        "cnpj_formatado": key_mask(F.col("cnpj")),
        "situacao": status,
        "cnae": activity,
        "porte": size,
        "porte_cod": filled_or(F.col("porte_cod"), ""),
        "uf": state,
        "capital_social": capital,
        "source": source,
        **{optional: _optional(optional) for optional in OPTIONAL_METADATA},
    }
    return staged.select(
        "cnpj",
        display_text(name, F.col("cnpj"), status, activity, size, state, capital).alias("text"),
        embedding_text(name, [F.col(place) for place in places]).alias("embed_text"),
        F.struct(*[metadata[f].alias(f) for f in METADATA.names]).alias("metadata"),
    ).select(*CHUNK.names)


def build_chunks(
    spark: SparkSession, folder: str, limit: int | None = None, sources: Iterable[str] | None = None
) -> tuple[DataFrame, SourceRun]:
    """Chunks of the chosen sources, de-duplicated; plus what happened to each source."""
    failures: dict[str, str] = {}
    run = run_sources(loaders(spark, folder, limit, failures), sources)
    run.failures.update(failures)
    return dedupe_chunks(registry_to_chunks(union_registry(run.frames.values(), spark), keys_checked=True)), run


def count_duplicates(chunks: DataFrame) -> tuple[DataFrame, Observation, Observation]:
    """De-duplicated chunks with row counters before and after, filled by the first action."""
    before, after = Observation("chunks_before"), Observation("chunks_after")
    rows = F.count(F.lit(1)).alias("rows")
    return dedupe_chunks(chunks.observe(before, rows)).observe(after, rows), before, after
