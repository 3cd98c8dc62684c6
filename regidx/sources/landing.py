"""Landing zone: discovery, validity audit and period selection."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regidx.fixed import PERIOD_PATTERN
from regidx.session import matching_paths
from regidx.sources.archive import open_path
from regidx.sources.json_items import parts


def discover(spark: SparkSession, folder: str, *patterns: str) -> list[str]:
    """All files of a folder matching any pattern, each once, sorted."""
    found: set[str] = set()
    for pattern in patterns:
        found.update(matching_paths(spark, f"{folder}/{pattern}"))
    return sorted(found)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and length of every file; contents are not read.

    Spark plans no split for an empty file, so those come from the listing itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    names = spark.createDataFrame([(unquote(path),) for path in files.inputFiles()], "path string")
    same = F.regexp_replace("path", r"^([a-z0-9+.-]+):/+", "$1:/").alias("same")  # file:/x is file:///x
    sized = files.select(same, "length")
    found = names.select("path", same).join(sized, "same", "left")
    return found.select("path", F.coalesce("length", F.lit(0)).alias("length"))


def file_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("zip", "json"), suffix).otherwise("csv")


def _problem(path: str, kind: str) -> str | None:
    """Why a non-empty file is unusable; None when it is fine."""
    try:
        with open_path(path) as handle:
            if kind == "zip":
                with zipfile.ZipFile(handle) as archive:
                    return None if archive.namelist() else "no members"
            read = sum(1 for _ in parts(handle, errors="strict"))
            return None if read else "not valid JSON"
    except zipfile.BadZipFile:
        return "not a zip archive"
    except ValueError:
        return "not valid JSON"
    except OSError:
        return "unreadable"


def audit_files(files: DataFrame) -> DataFrame:
    """``path, kind, length, valid, reason`` per file; only zip and JSON files are opened.

    The kind comes from a ``kind`` column if there is one, else from the file name.
    A zip check reads the central directory alone, so archive size does not matter.
    """

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            reasons = [
                "empty file" if length == 0 else None if kind == "csv" else _problem(path, kind)
                for path, kind, length in zip(frame["path"], frame["kind"], frame["length"])
            ]
            yield frame.assign(valid=[reason is None for reason in reasons], reason=reasons)

    kind = F.col("kind") if "kind" in files.columns else file_kind(F.col("path")).alias("kind")
    typed = files.select("path", kind, "length")
    return typed.mapInPandas(check, "path string, kind string, length long, valid boolean, reason string")


def usable_paths(audit: DataFrame) -> DataFrame:
    return audit.filter("valid").select("path")


def period_of(path: Column) -> Column:
    """The ``YYYY-MM`` token of a path, null when it has none."""
    token = F.regexp_extract(path, PERIOD_PATTERN, 1)
    return F.when(token != "", token)


def periods(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct periods, ascending."""
    return (
        paths.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(PERIOD_PATTERN), F.lit(1))).alias("period"))
        .distinct()
        .orderBy("period")
    )


def latest_period(paths: DataFrame, fallback: str | None = None, column: str = "path") -> DataFrame:
    """One row with the newest period, or the fallback when no path has one."""
    return periods(paths, column).agg(F.coalesce(F.max("period"), F.lit(fallback)).alias("period"))


def read_latest_period(spark: SparkSession, folder: str, fallback: str | None = None) -> DataFrame:
    """Rows of the newest ``period=YYYY-MM`` partition, else of the fallback; the others are pruned, not read.

    Partitions of any other name, the one of null periods included, are no periods.
    """
    rows = spark.read.parquet(folder)
    names = [unquote(path.rstrip("/").rsplit("period=", 1)[1]) for path in matching_paths(spark, f"{folder}/period=*")]
    newest = max((name for name in names if re.fullmatch(PERIOD_PATTERN, name)), default=fallback)
    if newest is None:
        raise ValueError(f"no period in {folder} and no fallback")
    return rows.filter(F.col("period").cast("string") == newest)
