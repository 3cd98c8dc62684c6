"""Repeats, late rows and forgotten keys of a chunk stream."""

import datetime as dt

from pyspark.sql import functions as F

from regidx.operators.embedding import hashed_trigrams
from regidx.plans.index_table import IndexTable
from regidx.schemas import METADATA
from regidx.streaming.dedupe import first_seen, stamped_chunk_stream
from regidx.streaming.ingest import keep_index_current


def write_load(spark, folder, rows):
    df = spark.createDataFrame(rows, "cnpj string, text string, loaded_at timestamp")
    fields = [(F.lit("cvm") if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    df.withColumn("metadata", F.struct(*fields)).coalesce(1).write.mode("append").json(folder)


def at(hour, minute=0):
    return dt.datetime(2026, 1, 1, hour, minute)


def test_repeats_late_rows_and_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_load(spark, folder, [("1", "a", at(1)), ("1", "a", at(1)), ("1", "b", at(1)), ("2", "a", at(1)), ("9", "x", None)])
    write_load(spark, folder, [("1", "a", at(1, 30)), ("3", "a", at(4))])
    write_load(spark, folder, [("5", "in time", at(3, 30)), ("3", "a", at(4, 10))])
    write_load(spark, folder, [("4", "late", at(2)), ("1", "a", at(8))])
    unique = first_seen(stamped_chunk_stream(spark, folder, 1), "1 hour")
    stream = unique.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
    stream.awaitTermination()
    got = sorted((r.cnpj, r.text, r.loaded_at) for r in spark.read.parquet(out).collect())
    assert got == [("1", "a", at(1)), ("1", "a", at(8)), ("1", "b", at(1)), ("2", "a", at(1)), ("3", "a", at(4)), ("5", "in time", at(3, 30))]
    states = [p.stateOperators[0] for p in stream.recentProgress if p.stateOperators]
    assert sum(s.numRowsDroppedByWatermark for s in states) == 1
    # Seven rows passed, four of them repeats or new keys of old times: the last states hold recent keys only.
    assert max(s.numRowsTotal for s in states) <= 5 and states[-1].numRowsTotal < max(s.numRowsTotal for s in states)


def test_deduped_stream_feeds_the_index(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_load(spark, folder, [(f"{i:014d}", "a", at(1)) for i in range(20)])
    write_load(spark, folder, [(f"{i:014d}", "a", at(1, 5)) for i in range(15, 25)])
    table = IndexTable(spark, str(tmp_path / "t"), 2).create()
    stream = first_seen(stamped_chunk_stream(spark, folder, 1), "1 hour")
    keep_index_current(stream, table, str(tmp_path / "check"), hashed_trigrams(16)).awaitTermination()
    assert sorted(r.cnpj for r in table.read().collect()) == [f"{i:014d}" for i in range(25)]
    # Only the five new keys reached the second upsert, so it rewrote nothing.
    first, last = (set(r.file for r in table.files(v).collect()) for v in (2, 3))
    assert first < last
