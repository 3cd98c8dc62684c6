"""Versions of the index table: what a change rewrites, what a failed one leaves, and who may publish."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regidx.catalog import standins
from regidx.plans import index_table
from regidx.plans.index_table import IndexTable
from regidx.plans.registry import standardise_participants
from regidx.plans.snapshots import ConcurrentChange, Snapshots
from regidx.plans.statistics import stats_record
from regidx.schemas import METADATA

FIRST, LATER = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
SOURCES = ("a b", "c%d/é", "x+y:z", "{q}[1]*?", None)


def chunks(spark, numbers, source=None, municipio=None, text="text"):
    """Embedded chunks; a company's source follows from its number unless given."""
    rows = [(f"{i:014d}", f"{text} {i}", source or SOURCES[i % len(SOURCES)], municipio) for i in numbers]
    df = spark.createDataFrame(rows, "cnpj string, text string, source string, municipio string")
    fields = [(F.col(f.name) if f.name in ("source", "municipio") else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields]
    return df.select("cnpj", "text", F.struct(*fields).alias("metadata"), F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))


@pytest.fixture
def table(spark, tmp_path):
    made = IndexTable(spark, str(tmp_path / "index"), buckets=4, file_rows=6).create()
    made.upsert(chunks(spark, range(200)), FIRST)
    return made


def names(table, version=None):
    return {row.file: row for row in table.files(version).collect()}


def shown(table, version=None):
    return {(r.cnpj, r.text_chunk): (r.source, r.metadata.municipio, r.created_at) for r in table.read(version).collect()}


def expected(numbers, **change):
    return {(f"{i:014d}", f"text {i}"): (SOURCES[i % len(SOURCES)], None, FIRST) for i in numbers} | change


def test_files_are_bounded_and_described(table):
    files = names(table)
    assert len(files) > 20 and all(row.rows <= 6 and row.low <= row.high for row in files.values())
    assert sum(row.rows for row in files.values()) == 200 and shown(table) == expected(range(200))
    assert {row.source for row in files.values()} == set(SOURCES)


def test_update_rewrites_only_the_files_that_hold_its_keys(spark, table):
    before = names(table)
    touched = {7, 93}
    holding = {f for f, row in before.items() if any(
        row.source == SOURCES[i % 5] and row.low <= f"{i:014d}" <= row.high for i in touched)}
    table.upsert(chunks(spark, touched, municipio="X"), LATER)
    after = names(table)
    gone = set(before) - set(after)
    assert len(gone) == 2 and gone <= holding
    now = shown(table)
    assert len(now) == 200
    assert all(now[f"{i:014d}", f"text {i}"] == (SOURCES[i % 5], "X" if i in touched else None, FIRST) for i in range(200))


def test_insert_appends(spark, table):
    before = names(table)
    assert table.upsert(chunks(spark, range(190, 260), text="other"), LATER) == 70
    after = names(table)
    assert set(before) < set(after) and sum(after[f].rows for f in set(after) - set(before)) == 70
    assert table.read().count() == 270
    assert {r.created_at for r in table.read().filter("text_chunk LIKE 'other%'").collect()} == {LATER}


def test_a_row_that_moves_to_another_source_is_in_one_file(spark, table):
    table.upsert(chunks(spark, [5], source="moved"), LATER)
    assert [r.source for r in table.read().filter("cnpj = '00000000000005'").collect()] == ["moved"]
    assert table.read().count() == 200


def test_bloom_filters_admit_all_known_and_few_unknown_keys(spark, table):
    def keys(numbers, text):
        rows = chunks(spark, numbers, text=text)
        return rows.select("cnpj", F.md5("text").alias("text_md5"), F.expr("cast(pmod(crc32(cast(cnpj as binary)), 4) as int)").alias("key_bucket"))

    snapshots = table.snapshots
    for number in (0, 77, 199):
        admitted = {r.file for r in snapshots.may_hold(snapshots.manifest(), keys([number], "text")).collect()}
        holding = {r._file for r in snapshots.rows(snapshots.manifest(), True).filter(f"cnpj = '{number:014d}'").collect()}
        assert holding <= admitted
    assert snapshots.may_hold(snapshots.manifest(), keys(range(200), "absent")).count() <= 4


@pytest.mark.parametrize("step", ["write", "publish"])
def test_a_failed_change_leaves_the_version_before(spark, table, monkeypatch, step):
    version, before = table.snapshots.current(), shown(table)

    def fail(*_):
        raise OSError("lost")

    for change in (
        lambda: table.upsert(chunks(spark, range(30), municipio="X"), LATER),
        lambda: table.replace_sources(chunks(spark, range(3), source="a b"), ["a b"]),
    ):
        with monkeypatch.context() as broken:
            broken.setattr(Snapshots, step, fail)
            with pytest.raises(OSError):
                change()
        assert table.snapshots.current() == version and shown(table) == before
    table.upsert(chunks(spark, [1], municipio="Y"), LATER)
    assert shown(table)["00000000000001", "text 1"][1] == "Y"


def test_a_pointer_half_written_is_no_version(spark, table):
    before = shown(table)
    with open(f"{table.path}/published/{table.snapshots.current() + 1:012d}", "w") as pointer:
        pointer.write("abc")
    assert shown(table) == before


def test_two_writers_cannot_publish_the_same_version(spark, table, monkeypatch):
    other = IndexTable(spark, table.path, 4, 6)
    publish = Snapshots.publish

    def late(self, manifest, after):
        monkeypatch.setattr(Snapshots, "publish", publish)
        other.upsert(chunks(spark, [300]), LATER)
        return publish(self, manifest, after)

    monkeypatch.setattr(Snapshots, "publish", late)
    with pytest.raises(ConcurrentChange):
        table.upsert(chunks(spark, [301]), LATER)
    numbers = {r.cnpj for r in table.read().collect()}
    assert f"{300:014d}" in numbers and f"{301:014d}" not in numbers


def test_replace_and_delete_are_one_version_each(spark, table):
    version, before = table.snapshots.current(), names(table)
    table.replace_sources(chunks(spark, [0, 1000], source="a b"), ["a b", "x+y:z"], LATER)
    assert table.snapshots.current() == version + 1
    kept = {f for f, row in before.items() if row.source != "a b"}
    assert kept <= set(names(table))
    assert sorted(r.cnpj for r in table.read().filter("source = 'a b'").collect()) == [f"{i:014d}" for i in (0, 1000)]
    assert shown(table, version) == expected(range(200))
    assert table.delete_source("x+y:z") == 40 and table.snapshots.current() == version + 2
    assert table.read().filter("source = 'x+y:z'").isEmpty()


def test_replay_compact_vacuum_and_truncate(spark, table):
    for number in range(4):
        table.upsert(chunks(spark, [500 + number], source="a b"), LATER)
    rows = shown(table)
    table.upsert(chunks(spark, range(200)), LATER)
    assert shown(table) == rows
    assert table.compact(1) > 0 and shown(table) == rows
    version = table.snapshots.current()
    assert table.vacuum() > 0 and shown(table) == rows
    assert set(table.snapshots.versions()) == {version}
    assert table.upsert(chunks(spark, []), LATER) == 0 and shown(table) == rows
    table.truncate()
    assert table.read().isEmpty() and table.upsert(chunks(spark, [1]), FIRST) == 1


def test_lookup_reads_the_files_of_one_bucket(table):
    rows = table.lookup("00.000.000/0000-42")
    assert [r.cnpj for r in rows.collect()] == ["00000000000042"]
    assert len(rows.inputFiles()) <= 6 < len(names(table))


def test_statistics_of_kept_summaries_equal_the_scan(spark, table):
    def same(version=None):
        kept, scanned = table.statistics(version), stats_record(table.read(version))
        assert kept.collect() == scanned.collect()
        return kept.first()

    first = table.snapshots.current()
    before = same()
    table.upsert(chunks(spark, range(150, 230), municipio="X"), LATER)
    assert same().total_embeddings == 230 and same().last_ingestion == LATER
    table.delete_source("a b")
    assert "a b" not in same().by_source
    assert same(first) == before
    plan = table.statistics(exact=False)
    assert abs(plan.first().total_companies - 184) <= 9
    assert not [file for file in plan.inputFiles() if "/data/" in file]
    table.truncate()
    assert same().total_embeddings == 0 and table.statistics(exact=False).first().total_companies == 0


def test_a_batch_without_repeated_keys_is_not_sorted_and_null_keys_count_as_equal(spark):
    schema = "cnpj string, text_md5 string, source string, metadata struct<a: string>, embedding array<float>"
    rows = [("1", "x", "bacen", ("p",), [1.0]), ("1", "x", "receita_federal", ("q",), [2.0]), ("2", "x", "cvm", ("p",), [3.0]),
            (None, "x", "cvm", ("z",), [4.0]), (None, "x", "cvm", ("b",), [5.0]), ("3", None, "cvm", ("z",), [6.0])]
    found = index_table.once_per_key(spark.createDataFrame(rows, schema))
    assert sorted(r.embedding[0] for r in found.collect()) == [2.0, 3.0, 5.0, 6.0]
    single = index_table.once_per_key(spark.range(4000).selectExpr(
        "cast(id as string) cnpj", "'x' text_md5", "'cvm' source", "named_struct('a', 'p') metadata", "array(1f) embedding"))
    assert single.count() == 4000
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.index("Union") < plan.index("Window")  # the window is the repeated rows' alone


def test_a_table_in_one_file_is_cleaned_by_all_cores(spark, tmp_path):
    spark.range(2000).selectExpr("id p_partkey", "'ring' p_name", "'Brand#1' p_brand", "'LARGE' p_type", "3 p_size").coalesce(
        1).write.parquet(f"{tmp_path}/part.parquet")
    rows = standins.raw_participants(spark, str(tmp_path))
    busy = rows.groupBy(F.spark_partition_id()).count().count()
    assert busy >= 2 * spark.sparkContext.defaultParallelism
    cleaned = standardise_participants(rows)
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count() == 2000 and "ArrowEvalPython" not in plan[plan.index("Repartition") :]
