"""Dialect, archives, landing audit, and the plans that must hold at scale."""

import io
import json
import zipfile
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fixtures_registry import quoted, write_landing, write_zip
from regidx.build import build_index
from regidx.operators.embedding import hashed_trigrams
from regidx.operators.keyed import best_per_group
from regidx.plans.index_table import IndexTable
from regidx.schemas import COMPANY_FILE
from regidx.session import shared_folder
from regidx.sources.archive import base_name, expand_archives, read_archive_rows, rows_of
from regidx.sources.delimited import read_companies
from regidx.sources.directory import read_participants
from regidx.sources.split_records import UnclosedQuote
from regidx.sources.landing import audit_files, latest_period, list_files, read_latest_period

ROWS = [
    '"1";"A;B ""C""";"x";"y";"1,0";"05";""',
    '"2";"too";"many";"y";"1,0";"05";"";"surplus"',
    '"3";"short";"NA"',
    "",
    '"4";"É NULL";"NULL";"";"2";"01";"z;"',
]
EXPECTED = {
    "1": ("A;B \"C\"", "x", None),
    "3": ("short", None, None),
    "4": ("É NULL", None, "z;"),
}


def shape(df):
    return {r.cnpj_basico: (r.razao_social, r.natureza_juridica, r.ente_federativo_responsavel) for r in df.collect()}


def test_dialect_in_files_and_archives(spark, tmp_path):
    (tmp_path / "plain.csv").write_bytes("\n".join(ROWS).encode("latin-1"))
    assert shape(read_companies(spark, str(tmp_path / "plain.csv"))) == EXPECTED
    write_zip(tmp_path / "a.zip", "X.emprecsv", ROWS)
    assert shape(read_archive_rows(spark, [str(tmp_path / "a.zip")], "EMPRE", COMPANY_FILE)) == EXPECTED


def test_reading_order_follows_the_file(spark, tmp_path):
    write_zip(tmp_path / "a.zip", "EMPRE", [quoted((i, f"n{i}", "", "", "", "", "")) for i in range(20000)])
    rows = read_archive_rows(spark, [str(tmp_path / "a.zip")], "EMPRE", COMPANY_FILE)
    first = [row.cnpj_basico for row in rows.orderBy("file_order").limit(3).collect()]
    assert first == ["0", "1", "2"] and rows.count() == 20000


def test_only_first_matching_member_is_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("readme.txt", "x")
        archive.writestr("one.EMPRECSV", quoted(("1", "A", "", "", "", "", "")))
        archive.writestr("two.EMPRECSV", quoted(("2", "B", "", "", "", "", "")))
    rows = read_archive_rows(spark, [str(tmp_path / "a.zip")], "empre", COMPANY_FILE)
    assert [row.cnpj_basico for row in rows.collect()] == ["1"]


def test_quoted_line_breaks_are_joined():
    assert list(rows_of(iter(['"a";"b', 'c";"d"', 'x"y;z', '"e"']))) == ['"a";"b\nc";"d"', 'x"y;z', '"e"']


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='";ab\n', max_size=60))
def test_rows_equal_a_character_by_character_reading(text):
    rows, row, inside, starts, at = [], "", False, True, 0
    while at < len(text):
        c = text[at]
        if inside and c == '"' and text[at : at + 2] == '""':
            row, at = row + '""', at + 2
            continue
        if inside:
            inside = c != '"'
        elif c == "\n":
            rows, row, starts, at = [*rows, row], "", True, at + 1
            continue
        else:
            inside, starts = starts and c == '"', c == ";"
        row, at = row + c, at + 1
    lines = io.StringIO(text)
    if inside:
        with pytest.raises(UnclosedQuote):
            list(rows_of(line.rstrip("\n") for line in lines))
    else:
        assert list(rows_of(line.rstrip("\n") for line in lines)) == rows + [row] * bool(row)


def test_an_unclosed_quote_in_an_archive_is_an_error(spark, tmp_path):
    with pytest.raises(UnclosedQuote):
        list(rows_of(iter(['"a', *["b"] * 1000]), most_chars=100))
    write_zip(tmp_path / "a.zip", "EMPRE", ['"1";"A"', '"2";"B', '3;C'])
    with pytest.raises(PySparkException, match="never closed"):
        read_archive_rows(spark, [str(tmp_path / "a.zip")], "EMPRE", COMPANY_FILE).collect()


def test_expansion_stays_inside_its_target(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("../../fora.txt", "dentro\n")
        archive.writestr("dir/ok.csv", "1\n2\n")
    assert base_name("../../fora.txt") == "fora.txt" and base_name("..\\x.csv") == "x.csv"
    target = str(tmp_path / "out")
    for _ in range(2):
        folders = expand_archives(spark, str(tmp_path / "*.zip"), target)
        assert sorted(base_name(f) for f in folders) == ["member=fora.txt", "member=ok.csv"]
        assert spark.read.text(target).count() == 3
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:  # a member of a name that a.zip has too
        archive.writestr("ok.csv", "3\n4\n5\n")
    for _ in range(2):
        assert len(expand_archives(spark, str(tmp_path / "*.zip"), target)) == 3
        assert spark.read.text(target).count() == 6
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:  # changed: unpacked anew
        archive.writestr("ok.csv", "3\n4\n5\n6\n77\n")
    expand_archives(spark, str(tmp_path / "*.zip"), target)
    assert spark.read.text(target).count() == 8
    assert not (tmp_path.parent / "fora.txt").exists()


def test_latest_period_passes_over_other_partitions(spark, tmp_path):
    folder = str(tmp_path / "periods")
    rows = spark.createDataFrame([(1, "2026-01"), (2, "2026-02"), (3, None), (4, "tmp")], "x int, period string")
    rows.write.partitionBy("period").parquet(folder)
    assert [r.x for r in read_latest_period(spark, folder).collect()] == [2]
    other = str(tmp_path / "other")
    rows.filter("x > 2").write.partitionBy("period").parquet(other)
    assert [r.x for r in read_latest_period(spark, other, fallback="tmp").collect()] == [4]
    with pytest.raises(ValueError):
        read_latest_period(spark, other)


def test_invalid_directory_is_an_error(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text("{nao e json")
    with pytest.raises(PySparkException):
        read_participants(spark, str(path)).collect()
    path.write_text('[{"OrganisationName": "A"}, 5]')
    assert read_participants(spark, str(path)).count() == 1


def test_landing_audit(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    write_zip(tmp_path / "good.zip", "a.csv", ["1"])
    (tmp_path / "bad.json").write_text("{nao e json")
    (tmp_path / "good.json").write_text(json.dumps([1]))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "full.csv").write_text("a;b")
    rows = {base_name(r.path): (r.kind, r.valid) for r in audit_files(list_files(spark, str(tmp_path))).collect()}
    assert rows == {"bad.zip": ("zip", False), "good.zip": ("zip", True), "bad.json": ("json", False),
                    "good.json": ("json", True), "empty.csv": ("csv", False), "full.csv": ("csv", True)}


def test_latest_period(spark):
    paths = spark.createDataFrame([("/x/2023-05/",), ("/x/2026-07/a",), ("/x/2026-08/ 2024-11",), ("/x/",)], "path string")
    assert latest_period(paths).first().period == "2026-08"
    assert latest_period(paths.filter("path = '/x/'"), fallback="2026-01").first().period == "2026-01"


def test_build_and_partial_rebuild(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    landing = write_landing(tmp_path / "raw", offices=True)
    table = IndexTable(spark, str(tmp_path / "index"), 2)
    report = build_index(spark, landing, table, encoder=hashed_trigrams(16))
    stats = report.stats.first()
    assert report.indexed == 5 and stats.by_source == {"receita_federal": 1, "cvm": 2, "bacen": 2}
    assert stats.embedding_dim == 16 and stats.total_companies == 3
    again = build_index(spark, landing, table, only=["bacen"], encoder=hashed_trigrams(16))
    assert again.indexed == 2 and again.stats.first().total_embeddings == 5


def test_ranking_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = best_per_group(df, ["g"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit") and "Partial" in plan


def test_filters_reach_the_index_scan(spark, tmp_path):
    table = IndexTable(spark, str(tmp_path / "index"), 4).create()
    (tmp_path / "raw").mkdir()
    build_index(spark, write_landing(tmp_path / "raw", offices=True), table, encoder=hashed_trigrams(16))
    key = table.read().first().cnpj
    plan = table.lookup(key)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and f"EqualTo(cnpj,{key})" in plan


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from regidx import session

    monkeypatch.setattr(session, "_setting", lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_folder(cluster)
