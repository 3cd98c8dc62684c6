"""Importance resampling towards a target distribution of hashed n-grams.

A text's separators are collapsed to single spaces; overlapped regex scans between boundary
lookarounds then give the span of every run of words, whose bytes are counted by CRC. A
bucket's gain is the log ratio of its smoothed shares in the target and in the documents, a
document's weight the mean gain of its features, and a Gumbel number by document makes
drawing the highest scores a sample without replacement.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.llm.common import replaced
from regidx.session import through_storage

#: Longest run of words, hash buckets, per cent of the eligible documents drawn, least words of an eligible document.
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Texts whose features are held at a time, and bytes of texts (a longer text is held alone).
ROWS, BYTES = 256, 4 << 20
_NEW = ("n_features", "weight", "score", "rank")


def _word_bytes() -> bytes:
    """For each byte: digits, letters (A-Z in lower case) and all beyond ASCII as they are, other bytes a space."""
    kept = {b: b for b in range(256) if chr(b).isalnum() or b >= 128}
    return bytes(kept.get(b, 32) + (32 if 65 <= b <= 90 else 0) for b in range(256))


def scanner(grams: int = GRAMS, buckets: int = BUCKETS):
    """A function from a text's bytes to the bucket of each of its features (all runs of 1 to ``grams`` words).

    Runs of one length begin at every word, so their matches overlap.
    """
    table, gaps = _word_bytes(), regex.compile(rb" +")
    runs = [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % more) for more in range(grams)]
    crc = zlib.crc32

    def features(text: bytes | None) -> np.ndarray:
        line = gaps.sub(b" ", (text or b"").translate(table)).strip(b" ")
        codes = [crc(m[0]) for run in runs for m in run.finditer(line, overlapped=True)]
        return (np.array(codes, dtype=np.int64) % buckets).astype(np.int32)

    return features


def _pieces(batch: pa.RecordBatch, place: int):
    """The batch in slices of bounded numbers of texts and bytes."""
    start = held = 0
    for row, text in enumerate(batch.column(place)):
        size = len(text.as_buffer()) if text.is_valid else 0
        if row > start and (row - start >= ROWS or held + size > BYTES):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def bucket_lists(docs: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the text replaced by ``_buckets``, the bucket of each of its features; a null text has none."""
    source = replaced(docs, "_buckets").withColumn(text, F.col(text).cast("binary"))
    place = source.columns.index(text)
    kept = [field for field in source.schema.fields if field.name != text]
    schema = T.StructType([*kept, T.StructField("_buckets", T.ArrayType(T.IntegerType(), False), False)])
    names = schema.fieldNames()

    def run(batches):
        features = scanner(grams, buckets)
        for batch in batches:
            for part in _pieces(batch, place):
                lists = [features(value) for value in part.column(place).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                columns = [c for i, c in enumerate(part.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, column], names=names)

    return source.mapInArrow(run, schema)


def bucket_counts(lists: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) over all lists: every task adds up its own, at most ``buckets`` rows each are shuffled."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    tallied = lists.select("_buckets").mapInArrow(run, "bucket int, n bigint")
    return tallied.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain) of all buckets: floor(1000 * ln of the ratio of add-one shares)."""
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(documents.select("bucket", F.col("n").alias("s")), "bucket", "left")
    both = both.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # one row per bucket
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    all_s, all_t = F.sum("s").over(whole).cast("double"), F.sum("t").over(whole).cast("double")
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weigh(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """``lists`` with ``n_features`` and ``weight``, the floored mean gain of the features (none: 0), for the list."""
    place = lists.columns.index("_buckets")
    kept = [field for field in lists.schema.fields if field.name != "_buckets"]
    schema = T.StructType([*kept, T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            lengths = np.array(column.value_lengths(), dtype=np.int64)
            running = np.concatenate(([0], np.cumsum(gain[column.flatten().to_numpy()])))
            ends = np.cumsum(lengths)
            weight = (running[ends] - running[ends - lengths]) // np.maximum(lengths, 1)
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths), pa.array(weight)], names=names)

    return lists.mapInArrow(run, schema)


def ranked(scored: DataFrame, id_column: str, eligible, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, ... of the highest scores, ties to smaller ids; others null.

    Eligible rows are dealt to tasks by ranges of that order and sorted there; a rank is the row's place in its
    range plus the rows of the ranges before, so no task sees more than a range.
    """
    order = [F.col("score").desc(), F.col(id_column).asc_nulls_last()]
    able = through_storage(
        scored.where(eligible)
        .repartitionByRange(*order, F.col("n_features"))
        .sortWithinPartitions(*order, "n_features")
        .withColumn("_place", F.monotonically_increasing_id()),
        "importance-ranges",
    )
    # The id's upper bits number the range, the lower 33 the rows in it.
    able = able.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranges = able.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per range
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(whole) * percent / 100).alias("_drawn"),
    )
    rank = F.col("_before") + F.col("_place") + 1
    drawn = able.join(ranges, "_range").withColumn("rank", F.when(rank <= F.col("_drawn"), rank).cast("long"))
    rest = scored.where(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.drop("_range", "_place", "_before", "_drawn").unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text",
    grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``docs`` without the text, with ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    Null and empty texts have no features, weight 0 and are never drawn; a null id counts as the empty string and
    comes last among ties; repeated rows are documents of their own; without documents there are no rows, without a
    target all shares of it are even. Other columns are kept, those named like new ones are replaced. The buckets of
    all documents are scanned once and stored in the shared folder; the driver sees ``buckets`` numbers.
    """
    lists = through_storage(bucket_lists(replaced(docs, *_NEW), text, grams, buckets), "importance-buckets")
    wanted = bucket_lists(target.select(F.col(target_text).alias("text")), "text", grams, buckets)
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(bucket_counts(lists, buckets), bucket_counts(wanted, buckets), buckets).toLocalIterator():
        gain[row["bucket"]] = row["gain"]
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    chance = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), F.lit(8)), 16, 10).cast("double")
    luck = F.floor(F.lit(-1000.0) * F.log(-F.log((chance + 0.5) / 4294967296.0))).cast("long")
    scored = through_storage(weigh(lists, gain).withColumn("score", F.col("weight") + luck), "importance-scores")
    # Features of w >= grams words: w + (w - 1) + ... for each length.
    least = sum(max(0, least_words - more) for more in range(grams))
    return ranked(scored, id_column, F.col("n_features") >= least, percent)


def drawn_texts(docs: DataFrame, resampled: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with score and rank."""
    picked = resampled.where(F.col("rank").isNotNull()).select(F.col(id_column).alias("_picked"), "score", "rank")
    return replaced(docs, "score", "rank").join(picked, F.col(id_column).eqNullSafe(F.col("_picked"))).drop("_picked")
