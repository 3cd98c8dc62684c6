import hashlib
import math
import random
import re
import zlib
from collections import Counter

from regidx.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def features(text, grams=2, buckets=10_000):
    w = WORD("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, percent=25, least=20, **how):
    buckets = how.get("buckets", 10_000)
    each = {i: features(text, **how) for i, text in docs}
    s, t = Counter(b for f, _ in each.values() for b in f), Counter(b for text in target for b in features(text, **how)[0])
    big_s, big_t = s.total(), t.total()
    out, able = {}, []
    for i, (f, n) in each.items():
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= least:
            able.append(i)
    able.sort(key=lambda i: (-out[i][2], i is None, i))
    for place, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = place
    return out


def corpus():
    rng = random.Random(5)
    words = ["Ärger", "the", "THE", "x1", "naïve", "中文", "a_b", "don't", " "] + [f"w{i}" for i in range(80)]
    texts = [" -, \t".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(300)]
    return [None, "", " ,.", "one", "B b", *texts, *texts[:40], " ".join(rng.choices(words, k=60_000)), "z" * 50_000]


def test_equals_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(importance, "BYTES", 2000)
    texts, target = corpus(), ["the x1 naïve w3 w4 " * 5, None, "", "Ärger 中文"]
    docs = docs_of(texts).withColumnRenamed("lang", "_buckets").withColumnRenamed("source", "RANK")
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs.repartition(4), bench)
    assert got.columns == ["doc_id", "n_chars", "n_features", "weight", "score", "rank"]
    expected = brute(list(enumerate(texts)), target)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == expected
    picked = importance.drawn_texts(docs, got).collect()
    assert {(r.doc_id, r.text, r["rank"]) for r in picked} == {(i, texts[i], v[3]) for i, v in expected.items() if v[3]}


def test_other_lengths_and_shares(spark, docs_of):
    texts = corpus()[:120]
    bench = spark.createDataFrame([("w1 w2 w3 w4 the x1",)], "text string")
    got = importance.resample(docs_of(texts), bench, grams=3, buckets=97, percent=60, least_words=4)
    expected = brute(list(enumerate(texts)), ["w1 w2 w3 w4 the x1"], 60, 4, grams=3, buckets=97)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == expected


def test_repeated_and_null_ids(spark):
    text = "the same words again and again " * 6
    docs = spark.createDataFrame([(5, text)] * 30 + [(None, text)] * 10 + [(4, "other " * 25)], "doc_id long, text string")
    bench = spark.createDataFrame([(text,)], "text string")
    got = importance.resample(docs, bench).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 41 and ranks == list(range(1, 11))


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs_of([]), none).collect() == []
    texts = ["some words here " * 10, None]
    got = importance.resample(docs_of(texts), none).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == brute(list(enumerate(texts)), [])
