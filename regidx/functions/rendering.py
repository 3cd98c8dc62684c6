"""The two texts written for each company."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regidx.fixed import ACTIVE, CHUNK_TEMPLATE, NOT_INFORMED, SEGMENT_LABEL
from regidx.functions.amounts import format_amount


def display_text(name: Column, key: Column, status: Column, activity: Column, size: Column,
                 state: Column, capital: Column) -> Column:
    """Full labelled text shown to the reader."""
    parts: list[Column] = []
    values = iter((name, key, status, activity, size, state, format_amount(capital)))
    for piece in CHUNK_TEMPLATE.split("%s"):
        if piece:
            parts.append(F.lit(piece))
        value = next(values, None)
        if value is not None:
            parts.append(value)
    return F.concat(*parts)


def embedding_text(name: Column, extras: list[Column]) -> Column:
    """Name, then the extras joined by commas, each kept once ignoring case.

    ``extras`` are null where absent (see ``embedding_extras``). The comparison is
    unrolled over the few extras, so no interpreted lambda is involved.
    """
    kept = []
    for place, extra in enumerate(extras):
        repeated = F.lit(False)
        for earlier in extras[:place]:
            repeated = repeated | F.coalesce(F.lower(extra) == F.lower(earlier), F.lit(False))
        kept.append(F.when(~repeated, extra))
    return F.concat_ws(" - ", F.trim(name), F.when(F.coalesce(*extras).isNotNull(), F.concat_ws(", ", *kept)))


def embedding_extras(activity: Column, segment: Column, size: Column, city: Column,
                     state: Column, status: Column) -> list[Column]:
    """The optional parts in order; blank or sentinel values and active status are null."""

    def usable(value: Column) -> Column:
        text = F.trim(value)
        return F.when((text != "") & (text != NOT_INFORMED), text)

    return [
        usable(activity),
        F.when(F.coalesce(segment, F.lit("")) != "", F.trim(F.concat(F.lit(SEGMENT_LABEL), segment))),
        usable(size),
        usable(city),
        usable(state),
        F.when(status != ACTIVE, usable(status)),
    ]
