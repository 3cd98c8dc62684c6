import hashlib
import random
import re

from regidx.llm import decontaminate
from regidx.llm.decontaminate import contaminated_words, digest, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words(text):
    return WORD("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        v = words(body)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(1)
    fresh = lambda n: [f"{rng.choice('abcdÉéß中')}{rng.randrange(300)}" for _ in range(n)]
    long, other = fresh(40), fresh(13)
    texts = [None, "", " ,. ", "ok", "Ok, then", " ".join(long), " ".join(fresh(50) + long[5:18] + fresh(5)),
             " ".join(fresh(50) + long[5:17] + fresh(5)), "--".join(long[3:30]).upper(), " ".join(fresh(2000) + other),
             " ".join((other + long) * 30), " ".join(fresh(20) + other), " ".join(fresh(20) + other), " ".join(fresh(30_000))]
    items = [(0, " ".join(long)), (1, None), (2, "..."), (10, " ".join(other)), (11, " ".join(other)), (9, " ".join(long[:20]))]
    return texts, items


def check(spark, docs_of, items):
    texts, _ = cases()
    df = docs_of(texts).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "ITEMS")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in digest(contaminated_words(df.repartition(3), bench)).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not brute(t, items)[4]]


def test_long_items(spark, docs_of):
    check(spark, docs_of, cases()[1])


def test_short_items_are_one_window(spark, docs_of):
    check(spark, docs_of, cases()[1] + [(3, "ok then"), (4, "OK"), (5, cases()[0][6].split(" ", 7)[3])])


def test_items_of_every_length_below_a_window(spark, docs_of):
    rest = cases()[0][6].split(" ")
    check(spark, docs_of, cases()[1] + [(100 + n, " ".join(rest[n : 2 * n])) for n in range(1, 15)])


def test_a_short_item_leaves_the_winnowing_as_it_is(spark, docs_of):
    """A one-word item adds the places of that word to the tried ones, not a fingerprint of every word."""
    common = "the " * 300 + " ".join(f"w{i}" for i in range(300))
    bench = spark.createDataFrame([(1, "the"), (2, " ".join(f"v{i}" for i in range(40)))], "item_id long, text string")
    got = contaminated_words(docs_of([common, "then w1 v3 v4"]), bench).collect()
    assert sorted((r.n_hit, r.items) for r in got) == [(0, []), (300, ["1"])]
    assert [(s.start, s.end) for r in got for s in r.spans] == [(0, 300)]


def test_benchmark_of_long_words_is_not_broadcast(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100)
    check(spark, docs_of, cases()[1] + [(3, "ok then"), (4, "OK")])


def test_shuffled_benchmark(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    check(spark, docs_of, cases()[1])


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "A b")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in contaminated_words(docs, bench).collect())
    assert got == [(0, 2, True), (1, 0, False), (1, 2, True), (1, 2, True)]
    assert [r.n_hit for r in contaminated_words(docs, bench.limit(0)).collect()] == [0] * 4
    assert contaminated_words(docs.limit(0), bench).collect() == []
