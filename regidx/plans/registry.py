"""From raw registry files to one standard registry table.

Every step is a chain of named columns: values used more than once are columns
of their own, so Spark evaluates each once and keeps the chain in one
generated stage.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regidx.fixed import (
    COMPANY_FILES,
    COMPANY_MEMBER,
    ESTABLISHMENT_FILES,
    ESTABLISHMENT_MEMBER,
    LISTED_FILE,
    LISTED_RENAMES,
    LISTED_SIZE,
    NOT_INFORMED,
    PARTICIPANT_FILE,
    PARTICIPANT_SIZE,
    SOURCES,
)
from regidx.functions.amounts import parse_amount
from regidx.functions.codes import participant_sector, size_code, size_name, status_name
from regidx.functions.keys import has_key, with_company_key
from regidx.functions.text import city_name, clean_text, filled_or, first_filled, fold_unicode
from regidx.operators.enrich import first_rows, headquarters, is_headquarters, row_cap
from regidx.operators.keyed import keep_first
from regidx.schemas import COMPANY_FILE, ESTABLISHMENT_FILE, REGISTRY
from regidx.session import empty_frame, through_storage
from regidx.sources.archive import read_archive_rows
from regidx.sources.delimited import FILE_ORDER, read_headerless, read_with_header
from regidx.sources.directory import read_participants, server_count
from regidx.sources.landing import discover

log = logging.getLogger(__name__)

SOURCE_ERRORS = (PySparkException, Py4JJavaError, OSError, ValueError, KeyError)


def column_or(df: DataFrame, name: str, default: str = "") -> Column:
    """The column, or a constant when the input lacks it."""
    return F.col(name) if name in df.columns else F.lit(default)


def to_registry(df: DataFrame) -> DataFrame:
    """Project to the registry schema; columns a source lacks become null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in REGISTRY.fields
        ]
    )


def named(df: DataFrame) -> DataFrame:
    """Rows with a real name."""
    return df.filter(F.col("razao_social") != NOT_INFORMED)


# --- tax registry --------------------------------------------------------------
def standardise_companies(companies: DataFrame, offices: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Companies in the standard layout.

    With head offices, only companies that have one are kept and enriched: the
    semi join and the left join are one inner join, done on the raw narrow
    columns so that all cleaning runs after the shuffle has spread the rows.
    """
    columns = ["cnpj_basico", "razao_social", "capital_social", "porte", FILE_ORDER]
    rows = companies.select(*columns)
    if offices is not None:
        rows = rows.join(offices, "cnpj_basico", "inner")
    else:
        rows = rows.withColumns(
            {name: F.lit(None).cast("string") for name in ("uf", "cnae_fiscal_principal", "situacao_cadastral")}
        )
    rows = first_rows(rows, limit).na.drop(subset=["razao_social"])
    keyed = with_company_key(rows.filter(has_key(F.col("cnpj_basico"))), "cnpj_basico")
    joined = offices is not None

    def office_text(name: str) -> Column:
        return clean_text(F.col(name), "") if joined else F.lit(NOT_INFORMED)

    cleaned = keyed.withColumns(
        {
            "razao_social": clean_text(F.col("razao_social"), title=True),
            "capital_social_num": parse_amount(F.col("capital_social")),
            "porte_desc": size_name(F.col("porte")),
            "porte_cod": size_code(F.col("porte")),
            "uf": F.upper(office_text("uf")),
            "cnae_fiscal_principal": office_text("cnae_fiscal_principal"),
            "situacao_desc": status_name(F.col("situacao_cadastral")),
            "source": F.lit(SOURCES[0]),
        }
    )
    return to_registry(cleaned)


def _read_layout(spark: SparkSession, paths: list[str], marker: str, schema) -> DataFrame:
    """Zip members and plain files of one layout as one frame."""
    zips = [path for path in paths if path.lower().endswith(".zip")]
    plain = [path for path in paths if path not in zips]
    parts = []
    if zips:
        parts.append(read_archive_rows(spark, zips, marker, schema))
    if plain:
        parts.append(read_headerless(spark, plain, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def load_companies(
    spark: SparkSession, folder: str, limit: int | None = None, failures: dict[str, str] | None = None
) -> DataFrame:
    """Tax registry with head-office data where establishment files are present (all slices).

    Establishments that cannot be read are noted in ``failures``; the companies come without their data.
    """
    company_paths = discover(spark, folder, COMPANY_FILES)
    if not company_paths:
        log.warning("no company file in %s", folder)
        return empty_frame(spark, REGISTRY)
    companies = _read_layout(spark, company_paths, COMPANY_MEMBER, COMPANY_FILE)
    office_paths = discover(spark, folder, *ESTABLISHMENT_FILES)
    offices = None
    if office_paths:
        try:
            establishments = _read_layout(spark, office_paths, ESTABLISHMENT_MEMBER, ESTABLISHMENT_FILE)
            # Stored, so that a file that cannot be read shows here and costs the enrichment, not the companies.
            found = through_storage(headquarters(establishments, limit), "head-offices")
            offices = None if found.isEmpty() else found
        except SOURCE_ERRORS as error:
            log.error("companies without head offices: %s", error)
            if failures is not None:
                failures["establishments"] = str(error)
    return standardise_companies(companies, offices, limit)


# --- listed companies ------------------------------------------------------------
def standardise_listed(rows: DataFrame) -> DataFrame:
    renamed = rows.withColumnsRenamed(LISTED_RENAMES)
    if "razao_social" not in renamed.columns:
        log.warning("listed companies: unexpected columns %s", renamed.columns[:10])
        return empty_frame(rows.sparkSession, REGISTRY)
    prepared = renamed.withColumn("cnpj_raw", column_or(renamed, "cnpj_raw"))
    keyed = with_company_key(prepared.filter(has_key(F.col("cnpj_raw"))), "cnpj_raw", pad_to_head_office=False)
    cleaned = keyed.withColumns(
        {
            "razao_social": clean_text(F.col("razao_social"), title=True),
            "uf": F.upper(clean_text(column_or(renamed, "uf", NOT_INFORMED))),
            "situacao_desc": status_name(column_or(renamed, "situacao_cadastral")),
            "setor_atividade": clean_text(column_or(renamed, "setor_atividade", NOT_INFORMED)),
            "capital_social_num": F.lit(0.0),
            "porte_desc": F.lit(LISTED_SIZE[0]),
            "porte_cod": F.lit(LISTED_SIZE[1]),
            "source": F.lit(SOURCES[1]),
        }
    )
    return to_registry(keep_first(named(cleaned), ["cnpj"], FILE_ORDER))


def load_listed(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    paths = discover(spark, folder, LISTED_FILE)
    if not paths:
        log.warning("no listed-company file in %s", folder)
        return empty_frame(spark, REGISTRY)
    return standardise_listed(first_rows(read_with_header(spark, paths, multi_line=True), limit))


# --- participants ----------------------------------------------------------------
def standardise_participants(items: DataFrame) -> DataFrame:
    """Participants publish a city and a segment, never a state or a size."""
    raw_names = ("OrganisationName", "LegalEntityName", "RegisteredName")
    texts = items.withColumns(
        {
            "razao_social": fold_unicode(first_filled(*[F.col(name) for name in raw_names])),
            "status": fold_unicode(F.col("Status")),
            "city": fold_unicode(F.col("City")),
            "size": fold_unicode(F.col("Size")),
            "organisation_id": fold_unicode(F.col("OrganisationId")),
        }
    )
    number = "RegistrationNumber"
    keyed = with_company_key(texts.filter(has_key(F.col(number))), number, pad_to_head_office=False)
    cleaned = keyed.withColumns(
        {
            "razao_social": clean_text(F.col("razao_social"), title=True),
            "situacao_desc": clean_text(F.col("status"), "Ativa"),
            "uf": F.lit(NOT_INFORMED),
            "municipio": city_name(F.col("city")),
            "segmento": clean_text(F.col("size"), ""),
            "capital_social_num": F.lit(0.0),
            "porte_desc": F.lit(PARTICIPANT_SIZE[0]),
            "porte_cod": F.lit(PARTICIPANT_SIZE[1]),
            "organisation_id": clean_text(F.col("organisation_id"), ""),
            "authorisation_servers": server_count(F.col("AuthorisationServers")),
            "source": F.lit(SOURCES[2]),
        }
    ).withColumn("setor_atividade", participant_sector(F.col("segmento")))
    return to_registry(keep_first(named(cleaned), ["cnpj"], FILE_ORDER))


def load_participants(spark: SparkSession, folder: str) -> DataFrame:
    paths = discover(spark, folder, PARTICIPANT_FILE)
    if not paths:
        log.warning("no participant file in %s", folder)
        return empty_frame(spark, REGISTRY)
    return standardise_participants(read_participants(spark, paths))


# --- all sources -----------------------------------------------------------------
@dataclass
class SourceRun:
    """Frames of the sources that could be planned, and why the others could not."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    observations: dict[str, Observation] = field(default_factory=dict)

    def rows_read(self) -> dict[str, int]:
        """Rows per source, known once an action has run on its frame."""
        return {name: seen.get["rows"] for name, seen in self.observations.items()}


def loaders(
    spark: SparkSession, folder: str, limit: int | None = None, failures: dict[str, str] | None = None
) -> dict[str, Callable[[], DataFrame]]:
    builders = (
        lambda: load_companies(spark, folder, row_cap(limit), failures),
        lambda: load_listed(spark, folder, row_cap(limit)),
        lambda: load_participants(spark, folder),
    )
    return dict(zip(SOURCES, builders))


def run_sources(builders: dict[str, Callable[[], DataFrame]], only: Iterable[str] | None = None) -> SourceRun:
    """Build and store the chosen sources; one that cannot be planned or read is reported and skipped."""
    chosen = set(only) if only else set(builders)
    run = SourceRun()
    for name, build in builders.items():
        if name not in chosen:
            continue
        try:
            seen = Observation(f"rows_{name}")
            run.frames[name] = through_storage(build().observe(seen, F.count(F.lit(1)).alias("rows")), f"source-{name}")
            run.observations[name] = seen
        except SOURCE_ERRORS as error:
            log.error("source %s skipped: %s", name, error)
            run.failures[name] = str(error)
    return run


def union_registry(frames: Iterable[DataFrame], spark: SparkSession) -> DataFrame:
    """Bag union by column name; columns a source lacks become null."""
    result = None
    for frame in frames:
        result = frame if result is None else result.unionByName(frame, allowMissingColumns=True)
    return empty_frame(spark, REGISTRY) if result is None else to_registry(result)


def enrichment_rate(registry: DataFrame) -> DataFrame:
    """Rows and rows that carry a state, in one pass."""
    return registry.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(filled_or(F.col("uf"), NOT_INFORMED) != NOT_INFORMED, 1)).alias("enriched"),
    )

