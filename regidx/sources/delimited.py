"""Delimited registry files.

Dialect: ``;`` separator, Latin-1, doubled quotes, three null tokens; rows with
too many fields are dropped, short rows are padded with nulls. Files split into
many input partitions (``spark.sql.files.maxPartitionBytes``), also with
``multi_line=True``, which lets a quoted field span lines at the price of a second scan.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.fixed import FIELD_SEPARATOR, FILE_ENCODING, QUOTE, READ_NULLS
from regidx.schemas import COMPANY_FILE, ESTABLISHMENT_FILE
from regidx.sources.split_records import quoted_records

FILE_ORDER = "file_order"
_BAD = "_bad_row"
_QUOTED = rf"{QUOTE}(?:[^{QUOTE}]|{QUOTE}{QUOTE})*+{QUOTE}"
# Quoting opens a field only right after a separator or at the start of the row.
_QUOTED_FIELD = rf"(?<=^|{FIELD_SEPARATOR}){_QUOTED}"


def dialect_options(multi_line: bool = False) -> dict[str, str]:
    return {
        "sep": FIELD_SEPARATOR,
        "encoding": FILE_ENCODING,
        "quote": QUOTE,
        "escape": QUOTE,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _BAD,
        "multiLine": str(multi_line).lower(),
        "maxCharsPerColumn": "-1",
        "columnPruning": "false",  # the field count is checked only when every field is parsed
    }


def surplus_fields(row: Column, width: int) -> Column:
    """Whether a raw row has more than ``width`` fields, ignoring quoted separators."""
    bare = F.regexp_replace(row, _QUOTED_FIELD, "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(FIELD_SEPARATOR), F.lit("")))
    return separators > width - 1


def null_token(value: Column) -> Column:
    return F.when(~value.isin(*READ_NULLS), value)


def _finish(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """Drop over-long rows, fold null tokens, keep the reading order as one column."""
    kept = rows.filter(F.col(_BAD).isNull() | ~surplus_fields(F.col(_BAD), len(columns)))
    return kept.select(*[null_token(F.col(c)).alias(c) for c in columns], order.alias(FILE_ORDER))


def _split_order() -> Column:
    """Position of a row in reading order: file, split offset, place within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_headerless(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, multi_line: bool = False,
    encoding: str = FILE_ENCODING,
) -> DataFrame:
    """Positional all-text columns, plus ``file_order``. Expanded archives are UTF-8."""
    if multi_line:
        return parse_lines(_records(spark, paths, encoding), schema, F.col("order"))
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(full).options(**dialect_options() | {"encoding": encoding}).csv(paths)
    return _finish(rows, schema.names, _split_order())


def _records(spark: SparkSession, paths: str | list[str], encoding: str = FILE_ENCODING) -> DataFrame:
    order = F.struct("file", "offset", "row")
    return quoted_records(spark, paths, encoding).select(F.col("record").alias("line"), order.alias("order"))


def read_companies(
    spark: SparkSession, paths: str | list[str], multi_line: bool = False, encoding: str = FILE_ENCODING
) -> DataFrame:
    return read_headerless(spark, paths, COMPANY_FILE, multi_line, encoding)


def read_establishments(
    spark: SparkSession, paths: str | list[str], multi_line: bool = False, encoding: str = FILE_ENCODING
) -> DataFrame:
    return read_headerless(spark, paths, ESTABLISHMENT_FILE, multi_line, encoding)


def normalised_names(names: list[str]) -> list[str]:
    return [name.strip().lower() for name in names]


def read_with_header(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> DataFrame:
    """Header-driven text columns with lower-cased, stripped names, plus ``file_order``.

    Every file has its own header: columns are matched by name, those that a file lacks are null.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(unquote(name) for name in spark.read.text(paths).inputFiles()):
        header = spark.read.options(**dialect_options(multi_line)).option("header", True).csv(path).columns
        by_header.setdefault(tuple(normalised_names([name for name in header if name != _BAD])), []).append(path)
    parts = [_with_names(spark, files, list(names), multi_line) for names, files in by_header.items()]
    if not parts:
        return _with_names(spark, paths, [], multi_line)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.select(*[c for c in rows.columns if c != FILE_ORDER], FILE_ORDER)


def _with_names(spark: SparkSession, paths: str | list[str], names: list[str], multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if multi_line and names:
        below = _records(spark, paths).where((F.col("order.offset") > 0) | (F.col("order.row") > 0))
        return parse_lines(below, schema, F.col("order"))
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(full).options(**dialect_options()).option("header", True).csv(paths)
    return _finish(rows, names, _split_order())


def parse_lines(lines: DataFrame, schema: T.StructType, order: Column) -> DataFrame:
    """Parse raw text rows (column ``line``), which may hold line breaks in quotes."""
    ddl = ", ".join(f"`{name}` STRING" for name in [*schema.names, _BAD])
    options = {k: v for k, v in dialect_options(True).items() if k != "encoding"}
    parsed = lines.filter(F.trim("line") != "").select(
        F.from_csv("line", ddl, options).alias("fields"),
        order.alias("_order"),
    )
    return _finish(parsed.select("fields.*", "_order"), schema.names, F.col("_order"))
