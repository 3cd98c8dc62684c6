import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import FOLDER
from regidx.llm.toxicity import buckets_of, fit, score_documents, train


def labelled(spark, n=600):
    """Insults are toxic only beside a group word, which a sum of weights cannot say."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + ["neutralia"] * (i % 3)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["insultword"] * insult + ["groupword"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words).title()))
        labels.append((i, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pairs_are_learned_and_nulls_scored(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    odd = spark.createDataFrame([(9000, None), (9001, ""), (None, "insultword"), (9002, "x " * 100_000)], docs.schema)
    scored = score_documents(docs.unionByName(odd).selectExpr("*", "1 AS SCORE"), train(docs, labels)).collect()
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    assert {r.predicted for r in scored if r.doc_id in (9000, 9001)} == {0}


def test_weak_words_that_tell_only_beside_another_are_learned():
    """Twenty names of groups, toxic only beside one insult; none of them tells much by itself."""
    rng = random.Random(5)
    names = [f"{chr(97 + i)}{chr(98 + i)}q{chr(97 + i)}folk" for i in range(20)]

    def drawn(n):
        texts, toxic = [], []
        for _ in range(n):
            words = ["w" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(60)]
            insult, group = rng.random() < 0.08, rng.random() < 0.3
            words += ["insultword"] * insult + rng.sample(names, 1) * group
            texts.append(" ".join(words))
            toxic.append(int(insult and group))
        return texts, np.array(toxic, np.float32)

    known = {}
    learned, truth = drawn(8000)
    machine = fit([np.array(buckets_of(t, known), np.int64) for t in learned], truth)
    texts, truth = drawn(3000)
    scores = np.array([plain_score(machine, t) for t in texts])
    caught = (scores >= 0.5) & (truth == 1)
    assert caught.sum() >= 0.9 * truth.sum() > 50
    assert ((scores >= 0.5) & (truth == 0)).sum() <= 0.01 * len(truth)


def plain_score(machine, text):
    """The machine's formula, pair by pair."""
    words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
    buckets = {zlib.crc32(t.encode()) % (1 << 20) for w in words for t in ([w] + ["^" + w[:5]] * (len(w) > 5))}
    features = sorted(machine.feature_of[b] for b in buckets if b in machine.feature_of)
    raw = machine.bias + sum(machine.weights[f] for f in features)
    for i, one in enumerate(features):
        raw += sum(float(np.dot(machine.factors[one], machine.factors[other])) for other in features[i + 1 :])
    return 1 / (1 + math.exp(-raw))


def test_scores_equal_the_formula_pair_by_pair(spark):
    docs, labels = labelled(spark, 400)
    machine = train(docs, labels)
    odd = spark.createDataFrame([(9000, None), (9001, ""), (9001, ""), (None, "insultword Groupword_x 1groupword")], docs.schema)
    rows = score_documents(docs.unionByName(odd).repartition(3), machine).collect()
    assert len(rows) == 404
    assert all(abs(r.score - plain_score(machine, r.text)) < 1e-9 for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = train(docs, labels), train(docs, turned)
    assert first.bias == second.bias and (first.weights == second.weights).all()
    assert score_documents(docs.limit(0), first).count() == 0
    assert train(docs, labels.limit(0)).weights.size == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        after = {r.doc_id for r in out.collect()}
        assert after <= before and len(after) == out.count() > 0.5 * len(before)
        if name in ("line_dedup", "byte_bpe"):
            assert after == before
        if name != "byte_bpe":
            assert out.columns == columns
        docs, before = out, after
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == before


def test_documents_stay_where_nothing_could_be_learned(spark, docs_of, tmp_path):
    docs = docs_of([f"text number {i} of some" for i in range(40)])
    for name, rows in {"none": [], "null": [(i, None) for i in range(40)], "others": [(i + 900, i % 2) for i in range(40)], "toxic": [(i, 1) for i in range(40)]}.items():
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").count() == 40, name
