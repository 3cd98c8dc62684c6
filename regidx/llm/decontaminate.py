"""Benchmark decontamination by winnowing: shared fingerprints first, then exact extension of the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.llm.common import let, lower_ascii, row_key
from regidx.session import through_storage

#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 4
#: A place in a text takes the low bits of a fingerprint, its hash the others; no string has 2^30 words.
PLACE_BITS = 30
#: Benchmark rows (fingerprints or windows) and bytes of windows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
SALTS = 16


def words_of(text: Column) -> Column:
    """Words in order; null and texts without a word give an empty array."""
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1)

    def trimmed(w: Column) -> Column:
        # Only a separator at either end of the text leaves an empty piece.
        first = F.when(F.get(w, F.lit(0)) == "", 2).otherwise(1)
        last = F.size(w) - F.when(F.get(w, F.size(w) - 1) == "", 1).otherwise(0)
        return F.slice(w, first, F.greatest(last - first + 1, F.lit(0)))

    return let(split, trimmed)


def window_length(words: Column, window: int) -> Column:
    return F.least(F.size(words), F.lit(window))


def _slide(values: Column, width: int, combine) -> Column:
    """``combine`` over each run of ``width`` values, built from runs of half the width; as many results as runs.

    Both halves may overlap, so ``combine`` of a run is fixed by the run alone.
    """

    def paired(runs: Column, step: int) -> Column:
        def halves(r: Column) -> Column:
            left = F.greatest(F.size(r) - step, F.lit(0))
            return F.zip_with(F.slice(r, F.lit(1), left), F.slice(r, F.lit(step + 1), left), combine)

        return let(runs, halves)

    runs, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        runs, reach = paired(runs, step), reach + step
    return runs


def gram_hashes(words: Column, gram: int) -> Column:
    """Hash and place of every run of ``gram`` words, packed into a long; none for fewer words."""
    mask = F.lit(-1 << PLACE_BITS).cast("long")
    grams = words if gram > 1 else F.transform(words, lambda w: F.xxhash64(w))
    hashes = _slide(grams, gram, lambda a, b: F.xxhash64(a, b))
    return F.transform(hashes, lambda h, i: h.bitwiseAND(mask).bitwiseOR(i.cast("long")))


def winnow(words: Column, gram: int, over: int) -> Column:
    """The least packed hash of each ``over`` consecutive grams: array<long>, repeats removed.

    Two texts that share gram + over - 1 consecutive words share the hash of one of these.
    """
    picked = F.array_distinct(_slide(gram_hashes(words, gram), over, lambda a, b: F.least(a, b)))
    return F.when(F.size(words) >= gram + over - 1, picked).otherwise(F.array().cast("array<long>"))


def _short_hashes(words: Column, length: int) -> Column:
    """Hash and place of every run of ``length`` words, told apart from those of other lengths and of winnowing."""
    sign = length * 0x9E3779B1 % (1 << (64 - PLACE_BITS - 1)) << PLACE_BITS
    return F.transform(gram_hashes(words, length), lambda h: h.bitwiseXOR(F.lit(sign).cast("long")))


def _hash_part(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _place_part(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int")


def _with_benchmark(left: DataFrame, right: DataFrame, on: str, rows: int, size: int, how: str) -> DataFrame:
    """Join with the benchmark's side: broadcast while small, else by a shuffle with split keys."""
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def contaminated_words(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted array), spans, contaminated.

    ``items`` holds the ids whose windows occur in the text, as strings; ``spans`` the
    merged hit ranges as array<struct<start, end>> in words, end exclusive. ``contaminated``:
    some word is hit and share * n_hit >= n_words. An item of fewer words than ``window`` is
    one window, looked up by the hash of all its words, so short items change nothing for the winnowing of the
    others; an item without words, null or empty, has none. Texts may have any length.

    A null text has no words. Rows that repeat an id and text get the same result each; repeated
    items and items of the same text all count. Null item ids are windows without an id.
    Other columns are dropped. Only fingerprints (a fifth of the words), hits, and for the
    last join the texts move; the benchmark's size decides whether its side is broadcast.
    ``options``: text, item_id, item_text, window, share.
    """
    return _judged(docs, items, doc_id, **options).drop("_id", "_row")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = _judged(docs, items, doc_id, text=text, **options).where("contaminated").select("_id", "_row").distinct()
    keyed = docs.select(F.struct("*").alias("_doc"), *row_key(doc_id, text))
    return keyed.join(bad, ["_id", "_row"], "left_anti").select("_doc.*")


def _judged(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
) -> DataFrame:
    bench = through_storage(
        items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("n", window_length(F.col("w"), window))
        .select(
            "item",
            "n",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("w") - F.col("n") + 1),
                    lambda i: F.slice(F.col("w"), i, F.col("n")),
                )
            ).alias("w"),
        )
        .distinct(),
        "bench-windows",
    )
    size = F.aggregate("w", F.lit(0).cast("long"), lambda total, w: total + F.octet_length(w) + 16)
    found = bench.groupBy("n").agg(F.count("*").alias("windows"), F.sum(size).alias("size")).collect()  # ``window`` rows at most
    windows, held = sum(r.windows for r in found), sum(r["size"] for r in found)
    short = sorted(r.n for r in found if r.n < window)
    base = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text"), *row_key(doc_id, text))
    schema = "array<struct<start:int,end:int>>"
    gram = min(GRAM, window)
    over = window - gram + 1

    def of_window(words: Column) -> Column:
        cases = F.when(F.size(words) == window, gram_hashes(words, gram))
        for length in short:
            cases = cases.when(F.size(words) == length, _short_hashes(words, length))
        return cases

    def of_text(words: Column) -> Column:
        return F.concat(
            F.array(F.size(words).cast("long")), winnow(words, gram, over), *(_short_hashes(words, length) for length in short)
        )

    prints = bench.select("n", F.explode(F.transform(of_window(F.col("w")), _hash_part)).alias("print")).distinct()
    # One pass over the texts: each row's number of words comes first, its fingerprints follow.
    seen = base.select(
        doc_id,
        "_id",
        "_row",
        F.posexplode(let(words_of(F.col("_text")), of_text)).alias("_at", "_packed"),
    ).select(
        doc_id,
        "_id",
        "_row",
        F.when(F.col("_at") == 0, F.col("_packed")).alias("n_words"),
        F.when(F.col("_at") > 0, _hash_part(F.col("_packed"))).alias("print"),
        _place_part(F.col("_packed")).alias("place"),
    )
    met = _with_benchmark(seen, prints, "print", windows * window, held, "left")
    rows = through_storage(
        met.where(F.col("n").isNotNull() | F.col("n_words").isNotNull())
        .groupBy(doc_id, "_id", "_row")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count("n_words").alias("copies"),
            F.collect_set(F.when(F.col("n").isNotNull(), F.struct("n", "place"))).alias("hits"),
        ),
        "contamination",
    )

    def windows_at(words: Column, hits: Column) -> Column:
        # Every start at which a window of n words could hold the gram that was met; a short item's is its own start.
        def first(h: Column) -> Column:
            return F.when(h["n"] < window, h["place"]).otherwise(F.greatest(h["place"] - window + gram, F.lit(0)))

        around = F.transform(
            hits,
            lambda h: F.transform(
                F.sequence(first(h), h["place"]),
                lambda s: F.struct(s.alias("start"), h["n"].alias("n")),
            ),
        )
        inside = F.filter(F.array_distinct(F.flatten(around)), lambda c: c["start"] + c["n"] <= F.size(words))
        return F.transform(
            inside, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.slice(words, c["start"] + 1, c["n"]).alias("w"))
        )

    met_rows = rows.where(F.size("hits") > 0).dropDuplicates(["_id", "_row"]).select("_id", "_row", "hits")
    texts = base.select("_id", "_row", "_text").join(met_rows, ["_id", "_row"])
    tried = texts.select(
        "_id", "_row", F.explode(let(words_of(F.col("_text")), lambda w: windows_at(w, F.col("hits")))).alias("c")
    ).select("_id", "_row", "c.start", "c.n", "c.w")
    sure = _with_benchmark(tried, bench.select("item", "w"), "w", windows, held, "inner")
    ends = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    per_doc = sure.groupBy("_id", "_row").agg(
        F.array_sort(F.collect_set(ends)).alias("ranges"), F.array_sort(F.collect_set("item")).alias("items")
    )
    merged = F.aggregate(
        "ranges",
        F.array().cast(schema),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= r["start"]),
            F.array_append(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.named_struct(
                    F.lit("start"), F.get(acc, F.size(acc) - 1)["start"],
                    F.lit("end"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], r["end"]),
                ),
            ),
        ).otherwise(F.array_append(acc, r)),
    )
    judged = rows.join(per_doc, ["_id", "_row"], "left").select(
        doc_id,
        "_id",
        "_row",
        "n_words",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.when(F.col("ranges").isNotNull(), merged), F.array().cast(schema)).alias("spans"),
    )
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return judged.withColumn("n_hit", total).select(
        doc_id,
        "_id",
        "_row",
        "n_words",
        "n_hit",
        "items",
        "spans",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(
        doc_id,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
