"""Amounts in the Brazilian notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(text: Column) -> Column:
    """``1.000.000,00`` or ``1000000`` as a double; 0 when it is not a number."""
    kept = F.regexp_replace(text, r"[^0-9,.\-]", "")
    plain = F.when(
        F.contains(kept, F.lit(",")),
        F.translate(F.replace(kept, F.lit("."), F.lit("")), ",", "."),
    ).otherwise(kept)
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def format_amount(value: Column) -> Column:
    """``1234567.5`` as ``1.234.567,50``."""
    return F.translate(F.format_number(value, 2), ",.", ".,")


def fixed_places(value: Column, places: int) -> Column:
    """Plain decimal text. Exact halves go to the even digit, unlike ``format_string``."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def json_amount(text: Column) -> Column:
    """A JSON number read as text, as an exact decimal; null when it is not one."""
    return text.try_cast("decimal(20,2)")
