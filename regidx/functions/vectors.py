"""Expressions on ``ARRAY<FLOAT>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regidx.functions.amounts import fixed_places


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_doubles(left), _doubles(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors; null when either is all zeros."""
    return F.try_divide(dot(left, right), l2_norm(left) * l2_norm(right))


def unit_vector(vector: Column, norm: Column) -> Column:
    """``vector`` divided by its ``norm``; unchanged when the norm is zero."""
    return F.when(
        norm > 0, F.transform(_doubles(vector), lambda x: x / norm).cast("array<float>")
    ).otherwise(vector)


def vector_text(vector: Column) -> Column:
    """``[0.1,-0.25,3]``: seven significant digits, no padding zeros."""

    def number(value: Column) -> Column:
        wide = value.cast("double")
        power = F.when(wide == 0, 0).otherwise(F.floor(F.log10(F.abs(wide)))).cast("int")
        # The number of decimals that leaves seven significant digits depends on the magnitude.
        by_power = [fixed_places(wide, 6 - p) for p in range(-4, 7)]
        plain = F.element_at(F.array(*by_power), F.least(F.greatest(power, F.lit(-4)), F.lit(6)) + 5)
        plain = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        exponent = F.call_function("format_number", wide, F.lit("0.######E00"))
        scientific = F.replace(F.regexp_replace(exponent, r"E(\d)", "e+$1"), F.lit("E"), F.lit("e"))
        return F.when(power.between(-4, 6), plain).otherwise(scientific)

    return F.concat(F.lit("["), F.array_join(F.transform(vector, number), ","), F.lit("]"))
