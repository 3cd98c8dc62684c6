"""The index: versioned Parquet files by source and key bucket.

A change adds files and publishes a new version as its last step, so a job that fails
leaves the version before. ``source`` lets a source be replaced or deleted without touching
data; ``key_bucket`` (a hash of the company key) splits a large source and lets a key lookup
read one bucket. An upsert rewrites the files that hold one of its keys and adds the rest.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.fixed import EMBEDDING_DIM, UNKNOWN_SOURCE
from regidx.functions.text import filled_or
from regidx.functions.vectors import l2_norm
from regidx.operators.keyed import best_per_group, source_ordinal
from regidx.operators.predicates import key_bucket
from regidx.schemas import INDEX
from regidx.plans.snapshots import Snapshots
from regidx.plans.statistics import distinct_companies, long_of, record_of
from regidx.session import through_storage

KEY = ["cnpj", "text_md5"]
#: Rows of a data file at most (some 100 MB of vectors).
FILE_ROWS = 65_536
#: What is kept of each file, per source and state: rows, newest row, and a mergeable sketch of the distinct keys.
SUMMARY = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("newest", T.TimestampType()),
        T.StructField("keys", T.BinaryType()),
    ]
)


def index_rows(chunks: DataFrame, buckets: int, created_at: datetime | None = None) -> DataFrame:
    """Index rows for chunks that already carry an ``embedding`` column."""
    key = F.left("cnpj", F.lit(14))
    stamp = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    rows = chunks.select(
        key.alias("cnpj"),
        F.col("text").alias("text_chunk"),
        F.md5("text").alias("text_md5"),
        "embedding",
        "metadata",
    )
    return rows.select(
        F.md5(F.concat("cnpj", "text_chunk")).alias("chunk_id"),
        *rows.columns[:3],
        F.col("embedding").cast("array<float>").alias("embedding"),
        l2_norm(F.col("embedding")).cast("float").alias("norm"),
        "metadata",
        stamp.alias("created_at"),
        F.col("metadata.source").alias("source"),
        key_bucket(F.col("cnpj"), buckets).alias("key_bucket"),
    ).select(*INDEX.names)


def file_summary(stored: DataFrame) -> DataFrame:
    """Partial statistics of each stored file."""
    source = filled_or(F.col("metadata.source"), UNKNOWN_SOURCE)
    return stored.groupBy("file", source.alias("source"), F.col("metadata.uf").alias("uf")).agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"), F.hll_sketch_agg("cnpj").alias("keys")
    ).select(*SUMMARY.names)


def once_per_key(incoming: DataFrame) -> DataFrame:
    """A batch that repeats a key counts once; the earliest source in registry order wins.

    Only the rows of repeated keys are sorted; a stored count of the narrow keys tells which those are.
    """
    counted = incoming.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = through_storage(counted.select(*[F.col(name).alias(f"again_{name}") for name in KEY]), "batch-repeated")
    same = F.lit(True)
    for name in KEY:
        same = same & F.col(name).eqNullSafe(F.col(f"again_{name}"))
    order = [source_ordinal(F.col("source")).asc_nulls_last(), F.to_json("metadata").asc()]
    return incoming.join(again, same, "left_anti").unionByName(
        best_per_group(incoming.join(again, same, "left_semi"), KEY, order, 1)
    )


def merge_rows(existing: DataFrame, once: DataFrame, stamps: DataFrame) -> DataFrame:
    """Upsert result on (key, text digest): new vector and metadata, original ``created_at``.

    ``stamps`` has the first ``created_at`` of the keys known so far. The existing side is only filtered, never
    aggregated, so its wide rows move only when the incoming keys are too many to broadcast.
    """
    updated = once.join(stamps, KEY, "left").withColumn("created_at", F.coalesce("first_seen", "created_at"))
    kept = existing.join(once.select(*KEY), KEY, "left_anti")
    return kept.select(*INDEX.names).unionByName(updated.select(*INDEX.names))


class IndexTable:
    """Batch operations on one index table. Each change is one new version, or none at all if it fails."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.path, self.buckets, self.file_rows = spark, path.rstrip("/"), buckets, file_rows
        self.snapshots = Snapshots(spark, self.path, INDEX)

    def create(self) -> IndexTable:
        """Create the table if it is absent."""
        if not self.snapshots.current():
            self.snapshots.publish(self.snapshots.manifest(), 0)
        return self

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one if None; later changes do not alter the frame."""
        return self.snapshots.rows(self.snapshots.manifest(version))

    def lookup(self, key: str) -> DataFrame:
        """Rows of one company: digits only, first 14; reads the files of its bucket whose range covers it."""
        digits = "".join(ch for ch in key if ch.isdigit())[:14]
        bucket = F.col("key_bucket") == key_bucket(F.lit(digits), self.buckets)
        files = self.snapshots.manifest().where(bucket & F.lit(digits).between(F.col("low"), F.col("high")))
        return self.snapshots.rows(files).where(bucket & (F.col("cnpj") == digits))

    def files(self, version: int | None = None) -> DataFrame:
        """The live data files with source, bucket, rows and key range."""
        return self.snapshots.manifest(version)

    def statistics(self, version: int | None = None, exact: bool = True, dimension: int = EMBEDDING_DIM, top: int = 10) -> DataFrame:
        """``stats_record`` of a version out of what is kept of its files: a change only costs the files it wrote.

        The number of companies is counted from the key column (``exact``) or estimated from the merged sketches, without
        reading any data file.
        """
        manifest = self.snapshots.manifest(version)
        kept = self.snapshots.summary(manifest, SUMMARY)
        if exact:
            companies = distinct_companies(self.snapshots.rows(manifest).select("cnpj"))
        else:
            companies = kept.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("keys")), F.lit(0)).alias("total_companies"))
        return record_of(long_of(kept.select("source", "uf", "n", "newest"), companies, top), dimension)

    # --- changes ---------------------------------------------------------------
    def upsert(self, chunks: DataFrame, created_at: datetime | None = None) -> int:
        """Insert or update embedded chunks; returns the number of rows in the batch."""
        version = self.snapshots.current()
        return self._merge(chunks, created_at, version, self.snapshots.manifest(version))

    def _merge(self, chunks: DataFrame, created_at: datetime | None, version: int, manifest: DataFrame) -> int:
        """Publish ``manifest`` with the chunks upserted, as the version after ``version``."""
        staged = through_storage(index_rows(chunks, self.buckets, created_at), "batch")
        total = staged.count()
        if total:
            changed, rows = self._changes(manifest, once_per_key(staged))
            manifest = manifest.join(changed, "file", "left_anti").unionByName(self.snapshots.write(rows, self.file_rows, file_summary))
        self.snapshots.publish(manifest, version)
        return total

    def _changes(self, manifest: DataFrame, once: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The names of the files that hold a key of the batch, and the rows that take their place."""
        if manifest.isEmpty():
            return manifest.select("file"), once
        keys = through_storage(once.select(*KEY, "key_bucket"), "batch-keys")
        # Bloom filters leave few files to look into; there, only key columns are read.
        candidates = self.snapshots.rows(self.snapshots.may_hold(manifest, keys), with_file=True)
        known = candidates.select(*KEY, "created_at", "_file").join(keys.select(*KEY), KEY, "left_semi")
        known = through_storage(known, "batch-known")
        stamps = known.groupBy(*KEY).agg(F.min("created_at").alias("first_seen"))
        changed = known.select(F.col("_file").alias("file")).distinct()
        return changed, merge_rows(self.snapshots.rows(manifest.join(changed, "file", "left_semi")), once, stamps)

    def delete_source(self, source: str) -> int:
        """Drop one source; returns how many rows it had. No data file is read or written."""
        version = self.snapshots.current()
        manifest = self.snapshots.manifest(version)
        mine = F.col("source").eqNullSafe(F.lit(source))
        removed = manifest.where(mine).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        self.snapshots.publish(manifest.where(~mine), version)
        return removed

    def replace_sources(
        self, chunks: DataFrame, sources: list[str], created_at: datetime | None = None, allow_empty: bool = False
    ) -> int:
        """Drop the named sources and load the chunks in one step; other sources stay.

        The new rows may come out of this very table. A named source without a new row keeps its old ones, unless
        ``allow_empty`` is set.
        """
        version = self.snapshots.current()
        staged = through_storage(chunks, "replacement")
        filled = {row.source for row in staged.select("metadata.source").where(F.col("source").isin(sources)).distinct().collect()}
        dropped = [source for source in sources if allow_empty or source in filled]
        manifest = self.snapshots.manifest(version)
        manifest = manifest.where(~F.coalesce(F.col("source").isin(dropped), F.lit(False))) if dropped else manifest
        return self._merge(staged, created_at, version, manifest)

    def truncate(self) -> None:
        version = self.snapshots.current()
        self.snapshots.publish(self.snapshots.manifest(version).limit(0), version)

    # --- upkeep ----------------------------------------------------------------
    def compact(self, most_files: int = 8) -> int:
        """Rewrite the buckets of a source that have more than ``most_files`` files; returns how many files went."""
        version = self.snapshots.current()
        manifest = self.snapshots.manifest(version)
        full = F.ceil(F.sum("rows") / self.file_rows)
        crowded = manifest.groupBy("source", "key_bucket").agg(F.count("*").alias("n"), full.alias("least"))
        crowded = crowded.where(F.col("n") > F.greatest(F.lit(most_files), F.col("least")))
        same = crowded["source"].eqNullSafe(manifest["source"]) & (crowded["key_bucket"] == manifest["key_bucket"])
        old = manifest.join(crowded, same, "left_semi")
        gone = old.count()
        if gone:
            added = self.snapshots.write(self.snapshots.rows(old), self.file_rows, file_summary)
            self.snapshots.publish(manifest.join(old.select("file"), "file", "left_anti").unionByName(added), version)
        return gone

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that the newest ``keep`` versions no longer use; readers of older versions fail after that."""
        return self.snapshots.vacuum(keep)
