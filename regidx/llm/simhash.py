"""SimHash near-duplicates found through the anchor points of a covering code."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.llm.arrow_rows import append_columns
from regidx.llm.blocks import by_group, merge, split_groups
from regidx.llm.components import components
from regidx.session import through_storage

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: The binary Golay code: 23 bits, 12 of them free, every word within 3 bits of exactly one code word.
CODE_BITS, CODE_RADIUS, GENERATOR = 23, 3, 0b110001110101
#: The fingerprint's bits in three blocks of at most 23: (first bit, bits).
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' XXH64, as a signed long; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    if len(words) > shingle:
        ends = (starts + sizes)[shingle - 1 :].tolist()
        pairs = zip(starts[: len(ends)].tolist(), ends, strict=True)
    else:
        pairs = iter([(0, len(joined))])
    n, counts, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while chunk := list(itertools.islice(pairs, 1 << 15)):
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in chunk), np.uint64, len(chunk))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(chunk)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _remainder(word: int) -> int:
    for bit in range(CODE_BITS - 1, CODE_BITS - 13, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def error_table(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts) by remainder: the patterns of up to ``radius`` bits, lightest first, padded."""
    basis = [_remainder(1 << bit) for bit in range(CODE_BITS)]
    lists: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(radius + 1):
        for bits in itertools.combinations(range(CODE_BITS), weight):
            rest = 0
            for bit in bits:
                rest ^= basis[bit]
            lists[rest].append(sum(1 << bit for bit in bits))
    width = max(map(len, lists))
    table = np.array([row + [-1] * (width - len(row)) for row in lists], np.int32)
    return table, np.array(list(map(len, lists)), np.int32)


def remainders(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int32)
    for bit in range(CODE_BITS):
        out ^= np.where(words >> bit & 1, _remainder(1 << bit), 0).astype(np.int32)
    return out


def anchors(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, anchor): for each block the code words within the covering radius plus its share of ``distance``.

    If two fingerprints differ in ``distance`` bits at most, some block differs in a third of that at
    most; there, the one's nearest code word (at most 3 bits away) is an anchor of the other.
    """
    share = distance // len(BLOCKS)
    table, counts = error_table(CODE_RADIUS + share)
    rows, blocks, found = [], [], []
    for block, (first, bits) in enumerate(BLOCKS):
        words = (prints.view(np.uint64) >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int32)
        rest = remainders(words)
        row = np.repeat(np.arange(len(words)), counts[rest])
        patterns = table[rest]
        rows.append(row)
        blocks.append(np.full(len(row), block, np.int32))
        found.append(np.repeat(words, counts[rest]) ^ patterns[patterns >= 0])
    return np.concatenate(rows), np.concatenate(blocks), np.concatenate(found)


def _to_anchors(distance: int):
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(prints):
                row, block, anchor = anchors(prints, distance)
                yield pa.RecordBatch.from_arrays([pa.array(prints[row]), pa.array(block), pa.array(anchor)], names=["print", "block", "anchor"])

    return run


def _linked(distance: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["print"].to_numpy(np.int64).view(np.uint64)
        homes = np.flatnonzero(group["_home"].to_numpy(bool))
        label = np.arange(len(prints))
        step = max(1, 4_000_000 // max(1, len(prints)))
        for start in range(0, len(homes), step):
            part = homes[start : start + step]
            near = np.bitwise_count(prints[part][:, None] ^ prints[None, :]) <= distance
            a, b = np.nonzero(near)
            label = merge(label, part[a], b)
        other = np.flatnonzero(label != np.arange(len(prints)))
        signed = prints.view(np.int64)
        return pd.DataFrame({"u": signed[other], "v": signed[label[other]]})

    return run


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "print", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each text."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())]

    return append_columns(docs, text, [T.StructField(name, T.LongType())], make)


def _grouped(classes: DataFrame, distance: int) -> DataFrame:
    """``classes``, one row per ``print``, with the component of each."""
    if not 0 <= distance <= 5:
        raise ValueError("three blocks and a radius of 3 + 1 find at most 5 differing bits")
    sent = classes.select("print").mapInArrow(_to_anchors(distance), "print long, block int, anchor int")
    split = split_groups(sent, ["block", "anchor"], "print")
    links = by_group(split, ["block", "anchor", "_chunk"], _linked(distance), "u long, v long")
    reached = components(links, "simhash").withColumnRenamed("node", "print")
    return classes.join(reached, "print", "left").withColumn("component", F.coalesce("component", "print"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most ``distance`` (3 to 5) bits are linked; component_id is the least
    doc_id that links reach. Null and empty texts, and texts of white space, have fingerprint
    zero and are linked like any other. Repeated rows are in one component; null ids never
    are the least. Other columns are dropped.

    Only distinct fingerprints are compared, each sent to about five anchors per block; a large group of one
    anchor is compared in blocks, and each task sends on a spanning set of its links.
    """
    printed = through_storage(
        add_fingerprint(docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text")), "_text", shingle=shingle).drop("_text"),
        "fingerprints",
    )
    classes = through_storage(printed.groupBy("print").agg(F.min(doc_id).alias("least")), "fingerprint-classes")
    known = _grouped(classes, distance)
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = through_storage(known.join(least, "component").select("print", "component_id"), "simhash-classes")
    return printed.join(by_print, "print").select(
        doc_id, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE
) -> DataFrame:
    """One row of ``docs`` of each component: of the least id, which a null one is only among null ids.

    Of rows with that id the one with the least hash of its text stays; of rows with equal id and text any one.
    """
    given = (F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))
    keys = [F.xxhash64(*given).alias("_key"), F.xxhash64(F.lit(1), *given).alias("_key2")]
    printed = through_storage(
        add_fingerprint(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), *keys), "_text", shingle=shingle).drop("_text"),
        "fingerprints",
    )
    least = F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_key", "_key2")).alias("row")
    classes = through_storage(printed.groupBy("print").agg(least), "fingerprint-classes")
    kept = _grouped(classes, distance).groupBy("component").agg(F.min("row").alias("row")).select("row._key", "row._key2")
    rows = docs.select(F.struct("*").alias("_doc"), *keys).join(kept.distinct(), ["_key", "_key2"])
    return rows.dropDuplicates(["_key", "_key2"]).select("_doc.*")
