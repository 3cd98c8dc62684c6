import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from regidx.functions import trigrams
from regidx.functions.trigrams import batch_trigrams, best_stretch, best_stretch_long, similarity, trigram_set, word_similarity

NU, LONG, OTHER = "Nu Pagamentos", "Nu Pagamentos S.A. - Instituicao De Pagamento", "Pagamentos Limitados Ltda"


def all_stretches(query, target):
    best = 0.0
    for i in range(len(target)):
        for j in range(i + 1, len(target) + 1):
            part = set(target[i:j])
            best = max(best, len(query & part) / len(query | part)) if query else 0.0
    return best


def test_printed_numbers(spark):
    df = spark.createDataFrame([(NU, LONG), (NU, OTHER), (NU, ""), (None, LONG)], "q string, t string")
    rows = df.select(
        F.round(word_similarity("q", "t"), 3).alias("w"),
        F.round(similarity(trigram_set(F.col("q")), trigram_set(F.col("t"))), 3).alias("s")).collect()
    assert [row.w for row in rows] == [1.0, 0.786, 0.0, 0.0]
    assert [row.s for row in rows][:2] == [0.412, 0.407]


def test_trigrams_match_native_sets(spark):
    texts = ["Ação & Cia. 3D", "a", "", "x_y z", "São  Paulo\nSP", "!!!"]
    codes, at = batch_trigrams(texts)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.size(trigram_set(F.col("t"))).alias("n")).collect()
    assert [len(set(codes[at[i]:at[i + 1]].tolist())) for i in range(len(texts))] == [row.n for row in rows]


def test_best_stretch_equals_every_stretch():
    rng = random.Random(11)
    for _ in range(3000):
        alphabet = rng.randint(2, 12)
        query = {rng.randrange(alphabet) for _ in range(rng.randint(0, 6))}
        target = [rng.randrange(alphabet) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.3:
            target = target[:5] * 4
        assert abs(best_stretch(query, target) - all_stretches(query, target)) < 1e-12


def test_long_search_equals_every_stretch(monkeypatch):
    from regidx.functions import trigrams

    monkeypatch.setattr(trigrams, "_WINDOW", 5)
    monkeypatch.setattr(trigrams, "_STARTS", 3)
    rng = random.Random(12)
    for _ in range(2000):
        alphabet = rng.randint(2, 14)
        query = {rng.randrange(alphabet) for _ in range(rng.randint(0, 6))}
        target = [rng.randrange(alphabet) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.4:
            target = target[:7] * 4
        best = all_stretches(query, target)
        got = trigrams.best_stretch_long(np.array(sorted(query), dtype=np.int64), np.array(target, dtype=np.int64))
        assert abs(got - best) < 1e-12
        over = trigrams.best_stretch_long(np.array(sorted(query), dtype=np.int64), np.array(target, dtype=np.int64), 0.4)
        assert abs(over - (best if best > 0.4 else 0)) < 1e-12


def test_repeated_text_is_not_quadratic():
    codes, at = batch_trigrams(["the same line again and again " * 4000])
    query, _ = batch_trigrams(["another same thing"])
    short = best_stretch(set(query.tolist()), codes.tolist())
    assert 0 < short < 1
    assert best_stretch_long(np.unique(query), codes) == short


def test_the_column_function_prepares_bounded_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcde ", k=2000)) for _ in range(40)]
    target = pd.Series([texts[i % 40] for i in range(1500)] + [None, "", "xyz"])
    query = pd.Series(["zq"] * 1500 + ["a", None, "xyz"])
    tracemalloc.start()
    got = trigrams.word_similarity.func(query, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20, peak  # all texts at once: some 200 MB
    assert len(got) == 1503 and got.iloc[-1] == 1 and got.iloc[-2] == got.iloc[-3] == 0
    some = pd.Series([texts[0][i : i + 40] for i in range(30)]), pd.Series(texts[:30])
    whole = trigrams.word_similarity.func(*some).tolist()
    monkeypatch.setattr(trigrams, "_SLICE_CHARS", 1)
    assert trigrams.word_similarity.func(*some).tolist() == whole


def test_many_queries_at_a_time_equal_every_stretch(monkeypatch):
    rng = random.Random(13)
    for _ in range(600):
        levels = [((1, 1), (2, 2)), ((1, 2), (3, 3)), ((2, 3), (4, 2)), ((5, 50),), ((1, 2), (2, 3), (4, 3))]
        monkeypatch.setattr(trigrams, "_LEVELS", rng.choice(levels))
        monkeypatch.setattr(trigrams, "_CELLS", rng.choice([1, 20, 1 << 20]))
        monkeypatch.setattr(trigrams, "_TOGETHER", rng.choice([1, 7, 1000]))
        alphabet = rng.randint(2, 14)
        queries = [{rng.randrange(alphabet) for _ in range(rng.randint(0, 6))} for _ in range(rng.randint(1, 4))]
        target = [rng.randrange(alphabet) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.4:
            target = target[:7] * 4
        vocabulary = np.array(sorted(set().union(*queries)), dtype=np.int64)
        member = np.array([[code in query for query in queries] for code in vocabulary.tolist()] + [[False] * len(queries)], dtype=np.uint8)
        sizes = np.array([max(1, len(query)) for query in queries])
        best = np.array([all_stretches(query, target) for query in queries])
        for beat in (0.0, 0.4):
            got = trigrams.best_stretches(vocabulary, member, sizes, np.array(target, dtype=np.int64), np.full(len(queries), beat))
            assert got.tolist() == np.where(best > beat, best, 0).tolist()


def test_long_texts_are_compared_with_all_queries_at_once(monkeypatch):
    from regidx.operators import hybrid

    rng = random.Random(14)
    words = ["".join(rng.choices("aeiorstn", k=rng.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 150, 400]))) for _ in range(40)] + ["", None]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(12)] + [texts[0][:80]]
    columns = {"chunk_id": [f"{i:03d}" for i in range(len(texts))], "cnpj": [f"{i:03d}" for i in range(len(texts))],
               "name": [""] * len(texts), "text_chunk": texts}
    nulls = {name: pa.nulls(len(texts), pa.string()) for name in ("uf", "porte", "porte_cod", "source")}
    batch = pa.RecordBatch.from_pydict({name: pa.array(values, pa.string()) for name, values in columns.items()} | nulls)
    queries = [hybrid.Query(str(i), text, None) for i, text in enumerate(asked)]

    def single(query, query_set, target, beat=0.0):
        assert len(target) <= hybrid.LONG, "a long text was compared with one query"
        return trigrams.stretch_score(query, query_set, target, beat)

    codes, at = batch_trigrams(texts)
    grams = [set(batch_trigrams([text])[0].tolist()) for text in asked]
    scores = [[0.6 * best_stretch(g, codes[at[i] : at[i + 1]].tolist()) for i in range(len(texts))] for g in grams]
    monkeypatch.setattr(hybrid, "stretch_score", single)
    for size in (100, 5):
        parts = [batch.slice(i, size) for i in range(0, len(texts), size)]
        found = {}
        for part in hybrid.score_batches(iter(parts), lambda: iter([queries]), hybrid.Weights(), 4, ["cnpj"]):
            for row in part.to_pylist():
                found.setdefault(int(row["query_id"]), []).append((-row["score"], row["cnpj"]))
        for number, row in enumerate(scores):
            assert sorted(found[number])[:4] == sorted((-score, f"{i:03d}") for i, score in enumerate(row))[:4]
