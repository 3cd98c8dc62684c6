"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.llm.arrow_rows import append_columns
from regidx.llm.common import replaced

#: Terms are hashed into so many buckets; of those, the machine uses so many at most.
BUCKETS, FEATURES = 1 << 20, 2048
#: Labelled documents that it learns from at most: a documented bound, no document to be scored is left out.
SAMPLE = 8_000
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 40, 128, 0.1, 1e-4
#: Buckets in fewer sample documents than RARE, or less telling than TELLING deviations, are no features.
RARE, TELLING = 4, 4.0
#: Terms are also features if they are so telling among the documents that hold one of the most telling terms:
#: what is told by two terms together need not show in one of them.
LEADS, BESIDE = 64, 3.0
PREFIX = 5
WORD = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of features of the dot product of their factors)."""

    feature_of: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, features: np.ndarray) -> float:
        w, v = self.weights[features], self.factors[features]
        raw = self.bias + w.sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def terms_of(word: str) -> tuple[int, ...]:
    """A word's buckets: itself, and its beginning, which inflected and disguised forms share."""
    return (bucket(word), bucket("^" + word[:PREFIX])) if len(word) > PREFIX else (bucket(word),)


def buckets_of(text: str | None, known: dict[str, tuple[int, ...]]) -> list[int]:
    words = set(WORD((text or "").lower()))
    if len(known) > 500_000:
        known.clear()
    known.update((w, terms_of(w)) for w in words if w not in known)
    return sorted({b for w in words for b in known[w]})


def deviations(seen: np.ndarray, hits: np.ndarray, n: int, rate: float) -> np.ndarray:
    """By how many standard deviations the toxic documents of a bucket are above ``rate``; 0 for rare buckets."""
    spread = np.sqrt(np.maximum(seen * rate * (1 - rate) * (1 - seen / max(n, 1)), 1e-9))
    return np.where(seen >= RARE, (hits - seen * rate) / spread, 0)


def choose(flat: np.ndarray, row: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """The buckets that tell by themselves, then those that tell beside one of the LEADS first of them."""
    n = len(toxic)

    def telling_in(places: np.ndarray, among: int, rate: float) -> np.ndarray:
        seen = np.bincount(flat[places], minlength=BUCKETS)
        return deviations(seen, np.bincount(flat[places], weights=toxic[row[places]], minlength=BUCKETS), among, rate)

    alone = np.abs(telling_in(np.arange(len(flat)), n, rate))
    chosen = np.argsort(-alone, kind="stable")[:FEATURES]
    chosen = chosen[alone[chosen] >= TELLING]
    beside = np.zeros(BUCKETS)
    for lead in chosen[:LEADS]:
        holds = np.zeros(n, bool)
        holds[row[flat == lead]] = True
        share = float(toxic[holds].mean())
        if 0 < share < 1:
            beside = np.maximum(beside, telling_in(np.flatnonzero(holds[row]), int(holds.sum()), share))
    beside[chosen] = 0
    more = np.argsort(-beside, kind="stable")[: FEATURES - len(chosen)]
    return np.concatenate([chosen, more[beside[more] >= BESIDE]])


def fit(documents: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """Learn from the documents' buckets and labels 0 or 1 by AdaGrad on the logistic loss."""
    n = len(documents)
    rate = (toxic.sum() + 0.5) / (n + 1) if n else 0.5
    prior = float(np.log(rate / (1 - rate)))
    flat = np.concatenate(documents) if n else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), [len(d) for d in documents]) if n else flat
    chosen = choose(flat, row, toxic, rate)
    feature_of = {int(b): i for i, b in enumerate(chosen)}
    m = len(chosen)
    if not m or toxic.min() == toxic.max():
        return Machine({}, prior, np.zeros(0), np.zeros((0, FACTORS)))
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(m)
    x = np.zeros((n, m), np.float32)
    inside = place[flat] >= 0
    x[row[inside], place[flat[inside]]] = 1
    rng = np.random.default_rng(seed)
    bias, w, v = prior, np.zeros(m, np.float32), rng.normal(0, 0.01, (m, FACTORS)).astype(np.float32)
    gw, gv, gb = np.full(m, 1e-6, np.float32), np.full((m, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            at = order[start : start + BATCH]
            xb, y = x[at], toxic[at]
            xv = xb @ v
            raw = bias + xb @ w + 0.5 * ((xv**2).sum(1) - (xb @ v**2).sum(1))
            slip = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y).astype(np.float32) / len(at)
            dw = xb.T @ slip + DECAY * w
            dv = xb.T @ (slip[:, None] * xv) - (xb.T @ slip)[:, None] * v + DECAY * v
            db = float(slip.sum())
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv) * 0.5
            bias -= RATE * db / np.sqrt(gb)
    return Machine(feature_of, float(bias), w.astype(np.float64), v.astype(np.float64))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fit on a bounded sample of the labelled documents that are not held out; only the text is an input.

    Null labels and labels of no document are passed over; without labels every score is 0.5.
    """
    usable = labels.select(F.col(doc_id).alias("_key"), F.col(label).cast("int").alias("_toxic")).where(
        F.col("_toxic").isin(0, 1) & ~held_out("_key") & F.col("_key").isNotNull()
    )
    picked = usable.orderBy(F.xxhash64("_key", F.lit(11)), "_key", "_toxic").limit(SAMPLE)
    texts = docs.select(F.col(doc_id).alias("_key"), F.col(text).cast("string").alias("_text"))
    sample = texts.join(F.broadcast(picked), "_key").select("_text", "_toxic")  # at most SAMPLE rows

    def make():
        known: dict[str, tuple[int, ...]] = {}
        return lambda given: [pa.array([buckets_of(t, known) for t in given], pa.list_(pa.int32()))]

    found = append_columns(sample, "_text", [T.StructField("_buckets", T.ArrayType(T.IntegerType()))], make)
    rows = found.select("_buckets", "_toxic").orderBy(F.xxhash64("_buckets"), "_toxic").limit(SAMPLE).toArrow()
    return fit([np.asarray(b, np.int64) for b in rows.column(0).to_pylist()], np.asarray(rows.column(1).to_pylist(), np.float32))


def score_documents(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Whole texts are scored; null and empty ones have no terms and get the bias's score. Every row
    keeps its other columns, repeated rows are scored each; columns named like the new ones are replaced.
    """
    docs = replaced(docs, "held_out", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most FEATURES weights and factors

    def make():
        model = shared.value
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            return tuple(model.feature_of[b] for b in terms_of(word) if b in model.feature_of)

        def one(text: str | None) -> float:
            words = set(WORD((text or "").lower()))
            if len(known) > 500_000:
                known.clear()
            known.update((w, of(w)) for w in words if w not in known)
            return model.score(np.array(sorted({f for w in words for f in known[w]}), np.int64))

        return lambda given: [pa.array([one(t) for t in given], pa.float64())]

    scored = append_columns(docs, text, [T.StructField("score", T.DoubleType())], make)
    return scored.withColumns({"held_out": held_out(doc_id), "predicted": (F.col("score") >= 0.5).cast("int")})
