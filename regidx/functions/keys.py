"""Company key (14-digit registration number) expressions.

Check digits are plain integer arithmetic on the twelve-digit number, so the
whole computation stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.fixed import CHECK_WEIGHTS, HEAD_OFFICE_SUFFIX, KEY_PATTERN


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def has_key(raw: Column) -> Column:
    """Whether ``raw`` yields a key. Filter on this rather than on the finished key:
    Catalyst pushes filters down by substitution, and the key is a long expression."""
    return raw.rlike("[0-9]")


def _weighted_sum(number: str, weights) -> str:
    width = len(weights)
    return " + ".join(
        f"(({number} div {10 ** (width - 1 - place)}) % 10) * {weight}" for place, weight in enumerate(weights)
    )


def _check_digit(total: str) -> str:
    """11 minus the remainder of 11, with 10 and 11 folded to 0."""
    return f"((({total}) * 10) % 11) % 10"


def with_check_digits(df: DataFrame, twelve: str, out: str) -> DataFrame:
    """Add ``out``: the two modulo-11 digits for the twelve-digit text column.

    The second digit weighs the same twelve digits one place on, plus the first digit times two.
    """
    number, first = f"_{out}_n", f"_{out}_d1"
    last = CHECK_WEIGHTS[-1]
    shifted = (CHECK_WEIGHTS[0] + 1, *CHECK_WEIGHTS[:-1])
    second = _check_digit(f"{_weighted_sum(number, shifted)} + {first} * {last}")
    return (
        df.withColumn(number, F.col(twelve).try_cast("bigint"))
        .withColumn(first, F.expr(_check_digit(_weighted_sum(number, CHECK_WEIGHTS))))
        .withColumn(out, F.concat(F.col(first).cast("string"), F.expr(second).cast("string")))
        .drop(number, first)
    )


def with_company_key(df: DataFrame, raw: str, out: str = "cnpj", pad_to_head_office: bool = True) -> DataFrame:
    """Add ``out``: ``raw`` as a 14-digit key, empty when it holds no digit.

    Twelve digits get their check digits; eight or fewer become the head office
    of that root when padding is on; every other length is cut or zero-filled.
    """
    digits, twelve, check = f"_{out}_digits", f"_{out}_twelve", f"_{out}_check"
    length = F.length(digits)
    root = F.concat(F.lpad(F.col(digits), 8, "0"), F.lit(HEAD_OFFICE_SUFFIX))
    base = F.when(length == 12, F.col(digits))
    if pad_to_head_office:
        base = base.when(length <= 8, root)
    prepared = df.withColumn(digits, F.coalesce(digits_only(F.col(raw)), F.lit(""))).withColumn(
        twelve, F.when(length > 0, base)
    )
    key = (
        F.when(length == 0, "")
        .when(F.col(twelve).isNotNull(), F.concat(twelve, check))
        .otherwise(F.lpad(F.col(digits), 14, "0"))  # lpad also cuts longer values to 14
    )
    return with_check_digits(prepared, twelve, check).withColumn(out, key).drop(digits, twelve, check)


def key_mask(key: Column) -> Column:
    """``00000000000191`` as ``00.000.000/0001-91``."""
    filled = F.lpad(F.coalesce(digits_only(key), F.lit("")), 14, "0")
    return F.regexp_replace(filled, r"^(..)(...)(...)(....)(..)$", r"$1.$2.$3/$4-$5")


def lookup_key(text: Column) -> Column:
    """The digits used for exact lookup: at most the first 14."""
    return F.substring(digits_only(text), 1, 14)


def key_in_text(text: Column) -> Column:
    """The first key-shaped run in a question as 14 digits; null when there is none."""
    found = digits_only(F.regexp_extract(text, KEY_PATTERN, 0))
    return F.when(F.length(found) == 14, found)
