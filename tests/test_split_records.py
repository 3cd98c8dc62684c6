"""Quoted line breaks in files that are read in many splits, against one pass over the whole file."""

import random

import pytest

from regidx.schemas import COMPANY_FILE
from regidx.sources.delimited import read_companies, read_with_header
from regidx.sources.split_records import quoted_records

PIECES = ["abc", "é", '""', ";", "\n", "\n\n", "\r\n", " ", "x;y", "Ção", '"";""', "1234567890" * 3]


def field(rng):
    if rng.random() < 0.5:
        return '"' + "".join(rng.choices(PIECES, k=rng.randrange(0, 8))) + '"'
    return "".join(rng.choice(["abc", "é", "", 'a"b', 'x""', "12 3", "'"]) for _ in range(rng.randrange(3)))


def split_whole(text):
    """Records by reading the text from its start."""
    records, begin, at, fresh, inside = [], 0, 0, True, False
    while at < len(text):
        char = text[at]
        if inside:
            if char == '"':
                if text[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    inside = False
        elif char == '"' and fresh:
            inside, fresh = True, False
        elif char == "\n":
            records.append(text[begin:at])
            begin, fresh = at + 1, True
        else:
            fresh = char == ";"
        at += 1
    if begin < len(text):
        records.append(text[begin:])
    return [record.removesuffix("\r") for record in records]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    old = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_of_files_over_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    texts = []
    for number in range(3):
        end = "\r\n" if number == 1 else "\n"
        text = end.join(";".join(field(rng) for _ in range(rng.randint(1, 4))) for _ in range(60))
        text += '\n"' + "long\n" * 200 + '";z\n' if number == 2 else ""
        (tmp_path / f"f{number}.csv").write_bytes(text.encode("latin-1"))
        texts.append(text)
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = quoted_records(spark, str(tmp_path)).orderBy("file", "offset", "row").collect()
    assert len({(r.file, r.offset) for r in rows}) > 20
    got = [[r.record for r in rows if r.file.endswith(f"f{n}.csv")] for n in range(3)]
    assert got == [split_whole(text) for text in texts]


def test_an_unclosed_quote_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a;b\nc;"open\n' + "text of other rows;1\n" * 40)
    with pytest.raises(Exception, match="never closed"):
        quoted_records(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="more than 100 characters"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        quoted_records(spark, str(tmp_path), most_chars=100).collect()


def test_companies_with_line_breaks(spark, tmp_path, small_splits):
    rows = [[f"{i:08d}", f'Nome "{i}"\nlinha; dois', "2062", "49", "1,00", "01", "Ção"] for i in range(50)]
    lines = "\n".join(";".join('"' + v.replace('"', '""') + '"' for v in row) for row in rows)
    (tmp_path / "c.csv").write_bytes(lines.encode("latin-1"))
    got = read_companies(spark, str(tmp_path), multi_line=True).orderBy("file_order")
    assert [list(r)[:7] for r in got.collect()] == rows and got.columns[:7] == COMPANY_FILE.names


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('B; A \n"1\n1";é\n2;"x;y"\n'.encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"a;c\n3;4\n")
    for multi_line in (True, False):
        got = read_with_header(spark, str(tmp_path), multi_line)
        rows = {(r.b, r.a, r.c) for r in got.collect()}
        assert got.columns == ["b", "a", "c", "file_order"]
        assert rows >= {("2", "x;y", None), (None, "3", "4")} and (("1\n1", "é", None) in rows) == multi_line
