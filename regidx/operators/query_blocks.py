"""Queries stored in the shared folder and streamed, block by block, by the tasks that scan the index.

No query passes through the driver and the index is scanned once, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.operators.hybrid import Query
from regidx.session import scratch_path
from regidx.sources.archive import arrow_path

FILE_QUERIES = 16_384
FILTERS = ("uf", "porte", "source")


def store_queries(queries: DataFrame, file_queries: int = FILE_QUERIES) -> str:
    """Write the queries and return their folder; files are bounded, so a task never holds more than a part of one."""
    path = scratch_path(queries.sparkSession, "queries")
    vector = [F.col("embedding").cast("array<double>").alias("embedding")] if "embedding" in queries.columns else []
    cells = [F.col("cells").cast("array<int>").alias("cells")] if "cells" in queries.columns else []
    spread = queries.select("query_id", "text", *FILTERS, *vector, *cells).hint("rebalance")
    # Sorted, so that a block's queries mostly have the same filters and meet only the rows that pass them.
    spread.sortWithinPartitions(*FILTERS).write.option("maxRecordsPerFile", file_queries).parquet(path)
    return path


def queries_of(batch: pa.RecordBatch) -> list[Query]:
    columns = {field: batch.column(field).to_pylist() for field in ("query_id", "text", *FILTERS)}
    cells = batch.column("cells").to_pylist() if "cells" in batch.schema.names else None
    vectors = [None] * batch.num_rows
    if "embedding" in batch.schema.names:
        vectors = [
            np.asarray(value.values, dtype=np.float64) if value.is_valid else None for value in batch.column("embedding")
        ]
    return [
        Query(columns["query_id"][i], columns["text"][i], vectors[i], *(columns[field][i] for field in FILTERS),
              None if cells is None else frozenset(cells[i] or ()))
        for i in range(batch.num_rows)
    ]


def stream_queries(path: str, size: int) -> Iterator[list[Query]]:
    """The stored queries in blocks of at most ``size``, in the same order at every call."""
    system, folder = arrow_path(path)
    files = system.get_file_info(pafs.FileSelector(folder))
    for name in sorted(info.path for info in files if info.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=size):
                yield queries_of(batch)
