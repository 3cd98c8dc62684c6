"""Row-wise Arrow operators: append columns to record batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from regidx.llm.common import replaced


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable, rows: int = 512) -> DataFrame:
    """``df`` with columns computed from its text column.

    ``make()`` runs once per task and returns a function from a list of texts (None
    for null) to one Arrow array per field. Batches are cut to ``rows`` texts, so a task
    holds the work of a few hundred texts at most. Columns with the names of the
    new ones are replaced.
    """
    kept = replaced(df, *[f.name for f in fields])
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, *fields])
    names = schema.fieldNames()

    def run(batches):
        columns_of = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                added = columns_of(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return kept.mapInArrow(run, schema)
