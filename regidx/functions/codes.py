"""Code tables as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regidx.fixed import (
    DASHBOARD_OTHER,
    DASHBOARD_SIZE_NAMES,
    LISTED_STATUS_NAMES,
    NOT_INFORMED,
    PARTICIPANT_SECTOR,
    SEGMENT_LABEL,
    SIZE_NAMES,
    STATUS_NAMES,
)
from regidx.functions.keys import digits_only
from regidx.functions.text import clean_text, first_filled


def decode(code: Column, names: dict[str, str]) -> Column:
    """Name of a code, null when the table has none."""
    branches = None
    for key, name in names.items():
        branches = (F if branches is None else branches).when(code == key, F.lit(name))
    return branches


def two_digits(code: Column) -> Column:
    """First two digits, zero-filled; blank gives ``00``."""
    return F.lpad(digits_only(clean_text(code, "")), 2, "0")


def size_code(code: Column) -> Column:
    return two_digits(code)


def size_name(code: Column) -> Column:
    return F.coalesce(
        decode(two_digits(code), SIZE_NAMES), first_filled(clean_text(code, "")), F.lit(NOT_INFORMED)
    )


def status_name(code: Column) -> Column:
    cleaned = clean_text(code, "")
    return F.coalesce(
        decode(two_digits(code), STATUS_NAMES),
        decode(F.upper(cleaned), LISTED_STATUS_NAMES),
        first_filled(cleaned),
        F.lit(NOT_INFORMED),
    )


def participant_sector(segment: Column) -> Column:
    """Sector text of a participant; ``segment`` is already cleaned."""
    return F.when(
        segment != "", F.concat(F.lit(f"{PARTICIPANT_SECTOR} - {SEGMENT_LABEL}"), segment)
    ).otherwise(PARTICIPANT_SECTOR)


def dashboard_size(code: Column) -> Column:
    return F.coalesce(decode(code, DASHBOARD_SIZE_NAMES), F.lit(DASHBOARD_OTHER))
