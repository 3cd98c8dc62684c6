"""JSON documents read item by item."""

import io
import json
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

import regidx
from regidx.sources import directory, json_items, landing
from regidx.sources.directory import PAYLOAD_KEYS, read_participants
from regidx.sources.json_items import items, parts

LEAF = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text()
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)
DOCUMENT = st.lists(VALUE) | st.dictionaries(st.sampled_from([*PAYLOAD_KEYS, "meta"]), VALUE) | LEAF


class Slow(io.BytesIO):
    """Gives a byte or a few at a time."""

    step = 3

    def read(self, size=-1):
        return super().read(min(self.step, size) if size >= 0 else self.step)


def expected(document):
    payload = document
    if isinstance(document, dict):
        payload = next((document[k] for k in PAYLOAD_KEYS if document.get(k)), None)
    return list(enumerate(payload)) if isinstance(payload, list) else []


@settings(max_examples=300, deadline=None)
@given(DOCUMENT, st.sampled_from([None, 1]), st.integers(1, 7), st.booleans())
def test_items_equal_the_whole_document_read_at_once(document, indent, step, ascii_only):
    raw = json.dumps(document, indent=indent, ensure_ascii=ascii_only).encode("utf-8", "surrogatepass")
    if b"\xed" in raw:
        raw = json.dumps(document, indent=indent).encode()

    def opened():
        stream = Slow(raw)
        stream.step = step
        return stream

    assert [(i, json.loads(t)) for i, t in items(opened, PAYLOAD_KEYS)] == expected(document)


@pytest.mark.parametrize(
    "raw", ["{nao", "[1,", "[1 2]", "[1]]", '{"a" 1}', '{"a": 1', "{1: 2}", "[NaN]", "tru", '["a', "[1],", '{"data": [1, }']
)
def test_what_is_no_document_is_an_error(raw):
    with pytest.raises(ValueError):
        list(parts(io.BytesIO(raw.encode())))


def test_blank_text_byte_mark_and_last_of_repeated_keys():
    assert list(parts(io.BytesIO(b" \n"))) == []
    assert [p.value for p in parts(io.BytesIO(b"\xef\xbb\xbf[1]"))] == [1]
    twice = b'{"data": [1], "participants": [2], "data": []}'
    assert list(items(lambda: io.BytesIO(twice), PAYLOAD_KEYS)) == [(0, "2")]
    with pytest.raises(ValueError):
        list(parts(io.BytesIO(b'["\xff"]'), errors="strict"))


class Endless:
    """A document of many items that is never whole in memory."""

    def __init__(self, n):
        self.left, self.item, self.head = n, b'{"OrganisationName": "%s"},' % (b"x" * 1000), b'{"meta": 0, "data": ['

    def read(self, size):
        if self.head:
            head, self.head = self.head, b""
            return head
        if self.left < 0:
            return b""
        some = min(self.left, max(1, size // len(self.item)))
        self.left -= some
        if some:
            return self.item * some
        self.left = -1
        return b"{}]}"


def test_memory_does_not_grow_with_the_file():
    tracemalloc.start()
    count = sum(1 for _ in parts(Endless(40_000)))  # 41 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 40_002 and peak < 8 << 20


def test_an_item_past_its_bound_is_an_error():
    with pytest.raises(ValueError, match="more than 1000"):
        list(parts(io.BytesIO(b'["' + b"x" * (2 * json_items.PIECE) + b'"]'), most_chars=1000))


def test_files_of_many_items_in_order(spark, tmp_path):
    folder = tmp_path / "in dir"
    folder.mkdir()
    (folder / "a b%.json").write_text(json.dumps([{"OrganisationName": f"Ação {i}"} for i in range(9000)] + [5, "x", None]))
    (folder / "b.json").write_text('{"participants": [[], {"OrganisationName": "sob \\"aspas\\""}], "data": []}')
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text('"texto"')
    rows = read_participants(spark, str(folder)).select("OrganisationName", "file_order.row", "file_order.file").collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.OrganisationName))
    assert sorted(by_file["a b%.json"]) == [(i, f"Ação {i}") for i in range(9000)]
    assert by_file["b.json"] == [(1, 'sob "aspas"')] and len(by_file) == 2


def test_readers_of_items_can_be_shipped_without_the_package(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"OrganisationName": "A"}, {"OrganisationName": "B"}]}')
    list(parts(io.BytesIO(b"[1]")))
    cloudpickle.register_pickle_by_value(regidx)
    try:
        assert cloudpickle.dumps([directory._items, landing._problem])
        assert read_participants(spark, str(tmp_path)).count() == 2
        audit = landing.audit_files(landing.list_files(spark, str(tmp_path))).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(regidx)
    assert [(row.kind, row.valid) for row in audit] == [("json", True)]
