"""Zip archives as a Spark data source.

Each matching member is one input partition, streamed line by line and handed
over in Arrow batches: a compressed member cannot be split, but no task holds
more than one batch of it. Later stages spread the rows (the company job joins
on the raw key before it cleans anything).
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from regidx.fixed import FIELD_SEPARATOR, FILE_ENCODING
from regidx.session import _hadoop_path, matching_paths, remove_path, scratch_path
from regidx.sources.delimited import parse_lines
from regidx.sources.split_records import MOST_CHARS, UnclosedQuote

LINES_PER_BATCH = 8192
ARCHIVE_LINE = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)
_ARROW_LINE = pa.schema(
    [("archive", pa.string()), ("member", pa.string()), ("line_number", pa.int64()), ("line", pa.string())]
)
# A line that begins outside quotes and ends inside; quotes count only at the start of a field.
_OPENS = re.compile(
    rf'(?:(?:"(?:[^"]|"")*+"[^{FIELD_SEPARATOR}]*+|[^"{FIELD_SEPARATOR}][^{FIELD_SEPARATOR}]*+)?{FIELD_SEPARATOR})*+'
    rf'"(?:[^"]|"")*+\Z'
).match
# What ends a quoted field that an earlier line began, with the rest of that field.
_CLOSES = re.compile(rf'(?:[^"]|"")*+"(?!")[^{FIELD_SEPARATOR}]*+').match


def arrow_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the inner path of a path as Hadoop writes it, on any storage Arrow knows."""
    if re.match(r"^(file:|/)", path) or not re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    # Arrow decodes per cent signs, Hadoop's paths mean them as they are.
    return pafs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe="/:@"))


def open_path(path: str):
    """A seekable file."""
    filesystem, inner = arrow_path(path)
    return filesystem.open_input_file(inner)


def base_name(member: str) -> str:
    """File name without folders, so expansion never leaves its target."""
    return re.split(r"[\\/]", member)[-1]


def matching_members(names: list[str], marker: str, first_only: bool) -> list[str]:
    found = [n for n in names if marker.upper() in n.upper() and not n.endswith("/")]
    return found[:1] if first_only else found


def rows_of(lines: Iterator[str], most_chars: int = MOST_CHARS) -> Iterator[str]:
    """Join lines that a quoted line break split; each line is looked at once.

    A quote that is never closed is an error, and so is a row of more than ``most_chars`` characters.
    """
    pending: list[str] = []
    size = 0
    for line in lines:
        if '"' not in line:
            inside = bool(pending)
        elif not pending:
            inside = _OPENS(line) is not None
        else:
            closed = _CLOSES(line)
            inside = closed is None or _OPENS(line, closed.end() + 1) is not None
        if not inside and not pending:
            yield line
            continue
        pending.append(line)
        size += len(line) + 1
        if size > most_chars:
            raise UnclosedQuote(f"a row of more than {most_chars} characters")
        if not inside:
            yield "\n".join(pending)
            pending, size = [], 0
    if pending:
        raise UnclosedQuote("a quote is never closed")


@dataclass
class MemberPartition(InputPartition):
    archive: str
    member: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.marker = options.get("marker", "")
        self.encoding = options.get("encoding", FILE_ENCODING)
        self.first_only = options.get("firstonly", "true") == "true"

    def partitions(self) -> list[MemberPartition]:
        if self.first_only:  # each task looks for its member itself
            return [MemberPartition(path, "") for path in self.paths] or [MemberPartition("", "")]
        parts = []
        for path in self.paths:
            with open_path(path) as handle, zipfile.ZipFile(handle) as archive:
                names = matching_members(archive.namelist(), self.marker, False)
            parts.extend(MemberPartition(path, name) for name in names)
        return parts or [MemberPartition("", "")]

    def read(self, partition: MemberPartition) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        with open_path(partition.archive) as handle, zipfile.ZipFile(handle) as archive:
            members = [partition.member] if partition.member else matching_members(archive.namelist(), self.marker, True)
            for member in members:
                place = MemberPartition(partition.archive, member)
                with archive.open(member) as raw:
                    text = io.TextIOWrapper(raw, encoding=self.encoding, newline=None)
                    try:
                        yield from self._batches(place, rows_of(line.rstrip("\n") for line in text))
                    except UnclosedQuote as error:
                        raise UnclosedQuote(f"{place.archive}, {member}: {error}") from error

    def _batches(self, place: MemberPartition, rows: Iterator[str]) -> Iterator[pa.RecordBatch]:
        start = 0
        while batch := list(islice(rows, LINES_PER_BATCH)):
            yield self._arrow(place, start, batch)
            start += len(batch)

    def _arrow(self, partition: MemberPartition, start: int, lines: list[str]) -> pa.RecordBatch:
        size = len(lines)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([partition.archive] * size, pa.string()),
                pa.array([partition.member] * size, pa.string()),
                pa.array(range(start, start + size), pa.int64()),
                pa.array(lines, pa.string()),
            ],
            schema=_ARROW_LINE,
        )


class ArchiveLines(DataSource):
    """``spark.read.format("archive_lines")``: the text rows of zip members."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> T.StructType:
        return ARCHIVE_LINE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archive_lines(
    spark: SparkSession, paths: list[str], marker: str, encoding: str = FILE_ENCODING, first_only: bool = True
) -> DataFrame:
    spark.dataSource.register(ArchiveLines)
    return (
        spark.read.format("archive_lines")
        .option("paths", "\n".join(paths))
        .option("marker", marker)
        .option("encoding", encoding)
        .option("firstonly", str(first_only).lower())
        .load()
    )


def read_archive_rows(spark: SparkSession, paths: list[str], marker: str, schema: T.StructType) -> DataFrame:
    """Delimited rows of the first matching member of each archive, plus ``file_order``."""
    order = F.struct(
        F.col("archive").alias("file"), F.lit(0).cast("long").alias("offset"), F.col("line_number").alias("row")
    )
    return parse_lines(read_archive_lines(spark, paths, marker), schema, order)


def expand_archives(spark: SparkSession, pattern: str, target: str, marker: str = "") -> list[str]:
    """Unpack every member into text files below ``target``: one folder per archive, in it one per member base name.

    An archive's folder is named by its file, its whole path and its size, so members of one name in
    two archives both stay, and an archive that has changed is unpacked anew in place of its old copy.
    Archives already unpacked are skipped. Returns the member folders. The output is UTF-8.
    """
    folders = {}
    for path in matching_paths(spark, pattern):
        fs, hadoop_path = _hadoop_path(spark, path)
        # Only characters that a partition folder's name keeps as they are.
        place = f"{re.sub(r'[^A-Za-z0-9._-]', '_', base_name(path))}-{hashlib.md5(path.encode()).hexdigest()[:8]}"
        folders[path] = (place, f"{place}-{fs.getFileStatus(hadoop_path).getLen()}")
    done = {base_name(found.rstrip("/")).partition("=")[2] for found in matching_paths(spark, f"{target}/archive=*")}
    fresh = {path: name for path, (_, name) in folders.items() if name not in done}
    if fresh:
        names = spark.createDataFrame(list(fresh.items()), "archive string, name string")
        staged = scratch_path(spark, "expanded")
        lines = read_archive_lines(spark, list(fresh), marker, first_only=False).join(names, "archive")
        lines.select(
            F.col("name").alias("archive"), F.regexp_extract("member", r"[^\\/]*$", 0).alias("member"), "line"
        ).write.partitionBy("archive", "member").text(staged)
        # Whole folders move, so an archive is there entirely or not at all.
        for path, name in fresh.items():
            fs, source = _hadoop_path(spark, f"{staged}/archive={name}")
            _, home = _hadoop_path(spark, f"{target}/archive={name}")
            fs.mkdirs(home if not fs.exists(source) else home.getParent())
            if fs.exists(source) and not fs.rename(source, home):
                raise OSError(f"cannot move {source} to {home}")
            for old in done:
                if old.startswith(f"{folders[path][0]}-"):
                    remove_path(spark, f"{target}/archive={old}")
        remove_path(spark, staged)
    return matching_paths(spark, f"{target}/archive=*/member=*")


def write_archives(df: DataFrame, member: str, label: str = "archives") -> str:
    """Each task writes its rows (one text column) as one zip; returns the folder."""
    target = scratch_path(df.sparkSession, label)
    filesystem, root = arrow_path(target)
    filesystem.create_dir(root)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, folder = arrow_path(target)
        count = 0
        with fs.open_output_stream(f"{folder}/part-{number:05d}.zip") as sink:
            with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(
                f"{number:05d}.{member}", "w"
            ) as out:
                for batch in batches:
                    lines = batch.column(0).to_pylist()
                    count += len(lines)
                    out.write("".join(f"{line}\n" for line in lines).encode(FILE_ENCODING))
        yield pa.RecordBatch.from_pydict({"written": pa.array([count], pa.int64())})

    df.mapInArrow(save, "written long").agg(F.sum("written")).collect()
    return target
