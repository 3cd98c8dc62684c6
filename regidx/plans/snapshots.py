"""Versions of a table of immutable data files.

A change writes its rows to files of its own and then a manifest: one row per live file with the
range of its keys. The version exists once its pointer is created, which is the last step and
fails when somebody else has published that version meanwhile; until then readers see the version
before. Bloom filters tell which files may hold a key without opening them. All of it is made by
Spark jobs; the driver sees file names only.

    commit=<id>/source=.../key_bucket=.../part-*.parquet   below data/: rows
    commit=<id>                                            below blooms/: Bloom pages of its files
    commit=<id>                                            below summaries/: what the table's owner sums up of each file
    manifests/<id>, published/<version>                    live files; the name of the manifest
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.session import create_text, empty_frame, matching_paths, read_text, remove_path, through_storage

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("key_bucket", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("low", T.StringType()),
        T.StructField("high", T.StringType()),
        T.StructField("pages", T.LongType()),
    ]
)
BLOOM = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("page", T.LongType()), T.StructField("bits", T.BinaryType())]
)
#: A Bloom page is one bitmap of 32,768 bits for some 2,048 keys: with 4 bits a key, one in 400 absent keys seems present.
PAGE_KEYS, PAGE_BITS, KEY_BITS = 2048, 32_768, 4
KEY = ("cnpj", "text_md5")


class ConcurrentChange(RuntimeError):
    """Another writer published the version that this one was about to publish; nothing has changed, try again."""


def _page(pages: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *KEY), F.greatest(pages, F.lit(1)))


def _positions() -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i + 1), *KEY), F.lit(PAGE_BITS)) for i in range(KEY_BITS)])


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return value.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (position % 8 + 1).cast("int"))) != 0


class Snapshots:
    """The versions below one folder; ``schema`` has the columns of :data:`KEY`, ``source`` and ``key_bucket``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.data, self.blooms, self.summaries = (f"{self.path}/{name}" for name in ("data", "blooms", "summaries"))

    # --- versions ----------------------------------------------------------------
    def _pointer(self, version: int) -> str:
        return f"{self.path}/published/{version:012d}"

    def versions(self) -> dict[int, str]:
        """Manifest folder of each published version; a pointer still being written is not published."""
        out = {}
        for pointer in matching_paths(self.spark, f"{self.path}/published/[0-9]*"):
            named = read_text(self.spark, pointer)
            if named.endswith("\n"):
                out[int(pointer.rsplit("/", 1)[1])] = named.strip()
        return out

    def current(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live files of a version (the newest one if None)."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if not version:
            return empty_frame(self.spark, MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{known[version]}")

    def publish(self, manifest: DataFrame, after: int) -> int:
        """Make ``manifest`` the version after version ``after``."""
        name = uuid.uuid4().hex
        manifest.select(*MANIFEST.names).repartitionByRange("key_bucket", "file").write.parquet(f"{self.path}/manifests/{name}")
        if not create_text(self.spark, self._pointer(after + 1), f"{name}\n"):
            raise ConcurrentChange(f"version {after + 1} of {self.path} was published by another writer")
        return after + 1

    # --- files -----------------------------------------------------------------------
    def _file(self) -> Column:
        """A data file's name below ``data/``; Spark shows paths URL-encoded."""
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        return F.concat(F.lit("commit="), F.substring_index(path, "/commit=", -1))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("commit", T.StringType())])).option(
            "basePath", self.data
        ).parquet(*paths)

    def rows(self, manifest: DataFrame, with_file: bool = False) -> DataFrame:
        """The rows of the files of ``manifest``, with the name of each row's file in ``_file`` if asked for."""
        files = [row["file"] for row in manifest.select("file").collect()]
        if not files:
            fields = [*self.schema.fields, *[T.StructField("_file", T.StringType())] * with_file]
            return empty_frame(self.spark, T.StructType(fields))
        found = self._read([f"{self.data}/{file}" for file in files])
        return found.select(*self.schema.names, *[self._file().alias("_file")] * with_file)

    def write(self, rows: DataFrame, file_rows: int, summary: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Store ``rows`` in files of their own, of at most ``file_rows`` rows sorted by key; returns their manifest rows.

        ``summary`` makes of the stored rows, with their ``file``, mergeable partial results of each file to be kept.
        """
        commit = uuid.uuid4().hex
        folder = f"{self.data}/commit={commit}"
        # A bucket of many rows is split over tasks; its rows are dealt at random, so split files overlap in range.
        spread = rows.select(*self.schema.names).hint("rebalance", F.col("source"), F.col("key_bucket"))
        spread.sortWithinPartitions("source", "key_bucket", *KEY).write.option("maxRecordsPerFile", file_rows).partitionBy(
            "source", "key_bucket"
        ).parquet(folder)
        keys = self._read([folder]).select(self._file().alias("file"), "source", "key_bucket", *KEY)
        described = keys.groupBy("file", "source", "key_bucket").agg(
            F.count("*").alias("rows"),
            F.min("cnpj").alias("low"),
            F.max("cnpj").alias("high"),
            F.ceil(F.count("*") / PAGE_KEYS).alias("pages"),
        )
        described = through_storage(described, "files")
        bits = keys.select("file", *KEY).join(described.select("file", "pages"), "file").select(
            "file", _page(F.col("pages")).alias("page"), F.explode(_positions()).alias("position")
        )
        bits.groupBy("file", "page").agg(F.bitmap_construct_agg("position").alias("bits")).write.parquet(
            f"{self.blooms}/commit={commit}"
        )
        if summary:
            stored = self._read([folder]).withColumn("file", self._file()).drop("commit")
            summary(stored).coalesce(1).write.parquet(f"{self.summaries}/commit={commit}")
        return described

    def summary(self, manifest: DataFrame, schema: T.StructType) -> DataFrame:
        """The kept partial results of the files of ``manifest``; data files are not read."""
        if not matching_paths(self.spark, f"{self.summaries}/commit=*"):
            return empty_frame(self.spark, schema)
        kept = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.summaries)
        return kept.join(manifest.select("file"), "file", "left_semi")

    def may_hold(self, manifest: DataFrame, keys: DataFrame) -> DataFrame:
        """The files of ``manifest`` whose range and Bloom filter admit one of ``keys`` (KEY and key_bucket)."""
        near = manifest.join(keys.select(*KEY, "key_bucket"), "key_bucket").where(F.col("cnpj").between(F.col("low"), F.col("high")))
        asked = near.select("file", _page(F.col("pages")).alias("page"), _positions().alias("positions"))
        if not matching_paths(self.spark, f"{self.blooms}/commit=*"):
            return manifest.limit(0)
        pages = self.spark.read.schema(BLOOM).option("recursiveFileLookup", "true").parquet(self.blooms)
        admitted = asked.join(pages, ["file", "page"]).where(F.forall("positions", lambda p: _has_bit(F.col("bits"), p)))
        return manifest.join(admitted.select("file").distinct(), "file", "left_semi")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the newest ``keep`` versions names, and older versions; returns how many files.

        Files of a change that is still under way count as unused: run it while nobody writes.
        """
        known = self.versions()
        kept = sorted(known)[-keep:]
        if not kept:
            return 0
        live = None
        for version in kept:
            files = self.manifest(version).select("file")
            live = files if live is None else live.unionByName(files)
        if not matching_paths(self.spark, f"{self.data}/commit=*"):
            return 0
        stored = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", "true"
        ).load(self.data).select(F.concat(F.lit("commit="), F.substring_index("path", "/commit=", -1)).alias("file"))
        dead = 0
        for row in stored.join(live.distinct(), "file", "left_anti").toLocalIterator():
            dead += remove_path(self.spark, f"{self.data}/{row['file']}")
        for version in sorted(known)[:-keep]:
            remove_path(self.spark, self._pointer(version))
            remove_path(self.spark, f"{self.path}/manifests/{known[version]}")
        return dead
