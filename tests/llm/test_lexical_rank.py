import math
import random
import re
from collections import Counter, defaultdict

import pytest

from regidx.llm import lexical_rank
from regidx.llm.lexical_rank import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
LAST = 2**63 - 1


def terms(text):
    return Counter(TERM("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k=10):
    counted = [(i, c) for i, text in docs if (c := terms(text))]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = {}
    for item, asked in wanted.items():
        scores = []
        for doc, c in counted:
            m = 10 + (90 * c.total() * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in asked if t in c
            )
            if score > 0:
                scores.append((-score, LAST if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (None if doc == LAST else doc, -score)
    return out


def corpus():
    rng = random.Random(9)
    words = ["the", "The", "é", "É", "中", "x-y", "a_b"] + [f"w{i}" for i in range(150)]
    weights = [40, 20, 10, 5, 5, 5, 5] + [60 / (i + 1) for i in range(150)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [text(rng.randrange(1, 60)) for _ in range(400)]
    docs += [None, "", " .,", docs[3], docs[3], docs[7] + " w149", text(40_000), "solo", "w5 " * 3000]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)]
    items += [(40, None), (41, ""), (42, "unknown words only"), (43, docs[3]), (44, docs[3]), (2, "w149 solo"), (None, "solo w5"), (45, text(3000)), (46, "the")]
    return list(enumerate(docs)) + [(12, "w149 w148 w5"), (None, docs[3]), (None, "solo")], items


def check(spark, docs, items, **how):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, ITEM string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, slice int")
    got = rank_documents(table.repartition(3), asked, **how).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == brute(docs, items, how.get("k", 10))


def test_equals_brute_force(spark):
    check(spark, *corpus())


@pytest.mark.parametrize("k,owners,slices", [(1, 6, 16), (3, 1, 100)])
def test_many_bundles_slices_and_owners(spark, monkeypatch, k, owners, slices):
    monkeypatch.setattr(lexical_rank, "ITEMS", 8)
    check(spark, *corpus(), k=k, owners=owners, slice_rows=slices)


def test_vocabulary_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(lexical_rank, "VOCABULARY", 10)
    check(spark, *corpus())


def test_copies_tie_by_id(spark):
    docs = [(i * 7 % 1000, "same text of all copies") for i in range(1000)]
    check(spark, [*docs, (5000, "something else")], [(1, "same copies"), (2, "else")], slice_rows=64)


def test_empty_tables(spark):
    for docs, items in (([], []), ([(1, "a b")], []), ([], [(1, "a b")]), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "b")])):
        check(spark, docs, items)
