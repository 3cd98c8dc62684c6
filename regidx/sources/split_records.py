"""Records of quoted text files whose fields may hold line breaks, read by many tasks per file.

Whether a line begins inside quotes depends on all lines before it, but each line only maps two
states to two states. A first pass composes these maps for each split; going through the splits
of a file in order (one row per split) tells the state in which each begins. A second pass then
cuts every split into records by itself. A record that runs over the end of a split is put together
from its pieces, of which there is one per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regidx.fixed import FIELD_SEPARATOR, FILE_ENCODING, QUOTE

#: Characters of a record at most; more is taken for a quote that is never closed.
MOST_CHARS = 16 << 20
_FIELD = rf"{QUOTE}(?:[^{QUOTE}]|{QUOTE}{QUOTE})*+{QUOTE}"
_CLOSED = rf"(?<=^|{FIELD_SEPARATOR}){_FIELD}"
_OPENS = rf"(?:^|{FIELD_SEPARATOR}){QUOTE}"
_CLOSES = rf"^(?:[^{QUOTE}]|{QUOTE}{QUOTE})*+{QUOTE}(?!{QUOTE})"


class UnclosedQuote(ValueError):
    """A quoted field that the file never closes."""


def _opens(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside; quotes within a bare field mean nothing."""
    return F.regexp_replace(line, _CLOSED, "").rlike(_OPENS)


def _stays(line: Column) -> Column:
    """Whether a line that begins inside quotes ends inside: nothing closes them, or another field opens."""
    rest = F.regexp_replace(line, _CLOSES, "x")  # the x stands for the field that was closed
    return ~line.rlike(_CLOSES) | _opens(rest)


def _lines(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """Every line with its split, in the order of the file within each task, and its two maps."""
    read = spark.read.option("lineSep", "\n").text(paths)
    line = F.decode(F.col("value").cast("binary"), encoding)
    placed = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), line.alias("line")
    )
    quoted = F.contains("line", F.lit(QUOTE))
    return placed.select(
        "file", "offset", "line",
        (quoted & _opens(F.col("line"))).alias("opens"),
        (~quoted | _stays(F.col("line"))).alias("stays"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch that lie in one split."""
    offsets = batch.column("offset").to_numpy()
    files = batch.column("file")
    codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(offsets) != 0) | (np.diff(codes) != 0)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: where states 0 and 1 lead, and whether a record begins in it for either."""
    held: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for run in _runs(batch) if batch.num_rows else ():
            key = (run.column("file")[0].as_py(), run.column("offset")[0].as_py())
            to = held.setdefault(key, [False, True, False, False])
            for opens, stays in zip(run.column("opens").to_pylist(), run.column("stays").to_pylist(), strict=True):
                for state in (0, 1):
                    to[2 + state] |= not to[state]
                    to[state] = stays if to[state] else opens
    columns = [[k[0] for k in held], [k[1] for k in held], *[[to[i] for to in held.values()] for i in range(4)]]
    names = ["file", "offset", "from_out", "from_in", "begins_out", "begins_in"]
    kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _inside_splits(lines: DataFrame) -> dict[tuple[str, int], int]:
    """The splits that begin inside quotes, each with the split where that record began."""
    composed = lines.select("file", "offset", "opens", "stays").mapInArrow(
        _composed, "file string, offset bigint, from_out boolean, from_in boolean, begins_out boolean, begins_in boolean"
    )
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    maps = F.collect_list(F.struct("from_out", "from_in")).over(before)
    begins_inside = F.aggregate(
        maps, F.lit(False), lambda state, to: F.when(state, to["from_in"]).otherwise(to["from_out"])
    )
    known = composed.withColumn("inside", begins_inside)
    begun = F.when(F.col("inside"), F.col("begins_in")).otherwise(F.col("begins_out"))
    known = known.withColumn("head", F.last(F.when(begun, F.col("offset")), ignorenulls=True).over(before))
    # A row for each split that begins inside quotes: rare, and no more than there are splits.
    return {(r["file"], r["offset"]): r["head"] for r in known.where("inside").select("file", "offset", "head").collect()}


_PIECE = "file string, offset bigint, row bigint, record string, whole boolean, head bigint"


def _cut(inside: dict[tuple[str, int], int], most_chars: int):
    """Cuts splits into records; the first piece of a split that begins inside quotes belongs to an earlier split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row, pending, size, head = None, 0, [], 0, None
        out: list[tuple] = []

        def flush():
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
            names = ["file", "offset", "row", "record", "whole", "head"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            out.clear()
            return batch

        def close(whole: bool):
            nonlocal row, pending, size, head
            own = split[1] if head is None else head
            out.append((split[0], split[1], row, "\n".join(pending), whole and head is None, own))
            row, pending, size, head = row + 1, [], 0, None

        for batch in batches:
            for part in _runs(batch) if batch.num_rows else ():
                key = (part.column("file")[0].as_py(), part.column("offset")[0].as_py())
                if key != split:
                    if pending:
                        close(False)
                    split, row, head = key, 0, inside.get(key)
                    state = head is not None
                columns = (part.column(name).to_pylist() for name in ("line", "opens", "stays"))
                for line, opens, stays in zip(*columns, strict=True):
                    pending.append(line)
                    size += len(line) + 1
                    state = stays if state else opens
                    if size > most_chars:
                        raise UnclosedQuote(f"a record of more than {most_chars} characters in {split[0]}, split {split[1]}")
                    if not state:
                        close(True)
            yield flush()
        if pending:
            close(False)
        yield flush()

    return run


def quoted_records(spark: SparkSession, paths: str | list[str], encoding: str = FILE_ENCODING, most_chars: int = MOST_CHARS) -> DataFrame:
    """Rows (file, offset, row, record): the records of the files, line breaks in quotes kept, in reading order by those.

    ``offset`` is the start of the split where a record begins and ``row`` its place there. Records end at a line feed outside
    quotes; a carriage return before it is cut off. A quote counts at the start of a field only. A quote that a
    file never closes is an error; so is a record of more than ``most_chars`` characters within one split. Empty files have no records.
    """
    lines = _lines(spark, paths, encoding)
    inside = _inside_splits(lines)
    pieces = lines.mapInArrow(_cut(inside, most_chars), _PIECE)
    whole = pieces.where("whole").select("file", "offset", "row", "record")
    broken = pieces.where("NOT whole").groupBy("file", "head").agg(
        F.sort_array(F.collect_list(F.struct("offset", "row", "record"))).alias("parts")
    )
    record = F.array_join("parts.record", "\n")
    joined = broken.select("file", F.col("head").alias("offset"), F.col("parts")[0]["row"].alias("row"), record.alias("record"))
    # An odd end is a quote that was never closed; the marker is only evaluated for records over several splits.
    checked = F.when(_opens(F.col("record")), F.raise_error(F.concat(F.lit("a quote is never closed in "), "file"))).otherwise(F.col("record"))
    rows = whole.unionByName(joined.select("file", "offset", "row", checked.alias("record")))
    return rows.withColumn("record", F.regexp_replace("record", r"\r$", ""))
