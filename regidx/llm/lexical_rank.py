"""Ranked lexical search: item bundles pass through the owners of the terms, stage by stage.

Terms are dealt to owners by how many documents hold them, rare ones to the first owner. A
bundle is up to some hundred items over one slice of the documents, with sparse accumulators
(item, document, score). At each stage a cogroup brings a bundle together with the owner's
postings of its slice and adds their integer contributions. Between stages the k-th best score
that an item has reached anywhere is a floor: an accumulator that cannot reach it with all
terms still to come is dropped, which never changes the result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.operators.keyed import spread_best_per_group
from regidx.session import through_storage

#: Length normalisation: m = BASE - SHARE + (SHARE * n * N) div L; a tf weighs (SCALE * tf) div (1000 * tf + 8 * m).
BASE, SHARE, SCALE = 100, 90, 1_000_000_000
KEPT = 10
#: Items and item terms of a bundle, documents of a slice (by expectation), owners, and how much rarer an owner's terms
#: are than the next one's.
ITEMS, ITEM_TERMS, SLICE, OWNERS, BAND = 256, 1 << 16, 4096, 4, 8
#: Terms, and their bytes, up to which the items' vocabulary is sent to the tasks that read the documents.
VOCABULARY, VOCABULARY_BYTES = 1 << 20, 32 << 20
SPREAD = 32


def term_counter():
    """A function from a text's bytes to a Counter of its terms: digits, letters (A-Z in lower case), all beyond ASCII."""
    kept = {b: b for b in range(256) if chr(b).isalnum() or b >= 128}
    table = bytes(kept.get(b, 32) + (32 if 65 <= b <= 90 else 0) for b in range(256))
    return lambda text: Counter((text or b"").translate(table).split())


def _text_rows(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))


def item_terms(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, term), each term of an item once; rows of the same item id are one item."""

    def run(batches):
        count = term_counter()
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = list(count(value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())],
                    names=["item_id", "term"],
                )

    return _text_rows(items, id_column, text).mapInArrow(run, "item_id bigint, term string").distinct()


def numbered_items(terms: DataFrame) -> DataFrame:
    """Items in bundles: rows (_item, bundle, item) where ``item`` counts from 0 inside its bundle.

    Items are dealt to bundles by hash, so many that a bundle has some 128 items and 32,000 terms; two
    items of a bundle never share a number.
    """
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    count, most = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(1, math.ceil(2 * count / ITEMS), math.ceil(2 * most / ITEM_TERMS)) if count > ITEMS or most > ITEM_TERMS else 1
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int")
    placed = sizes.select("item_id", bundle.alias("bundle"))
    position = F.row_number().over(Window.partitionBy("bundle").orderBy(F.col("item_id").asc_nulls_first()))
    return placed.select(F.col("item_id").alias("_item"), "bundle", (position - 1).cast("int").alias("item"))


def _vocabulary(terms: DataFrame) -> frozenset[bytes] | None:
    """The items' terms, or None where they are too many to be sent around."""
    each = terms.select("term").distinct()
    count, size = each.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if count > VOCABULARY or size > VOCABULARY_BYTES:
        return None
    return frozenset(row["term"].encode() for row in each.toLocalIterator())


def document_terms(docs: DataFrame, vocabulary: frozenset[bytes] | None, id_column: str, text: str) -> DataFrame:
    """Rows (row, doc_id, n, terms, tfs) of the documents with a term; of their terms those in the vocabulary, if given.

    ``row`` numbers the rows of the table, so repeated ids stay separate documents.
    """
    schema = "row bigint, doc_id bigint, n bigint, terms array<string>, tfs array<bigint>"
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches):
        count, wanted = term_counter(), shared.value if shared else None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kept, lengths, terms, tfs = [], [], [], []
                for place, value in enumerate(part.column("text").to_pylist()):
                    counts = count(value)
                    total = counts.total()
                    if not total:
                        continue
                    if wanted is not None:
                        counts = {term: counts[term] for term in counts.keys() & wanted}
                    kept.append((place, total))
                    lengths.append(len(counts))
                    terms.extend(counts)
                    tfs.extend(counts.values())
                places = pa.array([place for place, _ in kept], pa.int64())
                ends = pa.array(np.cumsum([0, *lengths], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(places),
                        part.column("id").take(places),
                        pa.array([total for _, total in kept], pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                    ],
                    names=["row", "doc_id", "n", "terms", "tfs"],
                )

    rows = _text_rows(docs, id_column, text).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return rows.mapInArrow(run, schema)


def postings(stored: DataFrame, documents: int, length: int, slices: int) -> DataFrame:
    """Rows (slice, row, id, term, part): ``part`` is what the term adds to a score for each unit of its weight.

    ``id`` orders ties: the document's id, the largest long for a null one.
    """
    wide = "decimal(38,0)"  # 90 * n * N can pass 64 bits before the division
    m = F.expr(f"cast({BASE - SHARE} + (cast({SHARE} as {wide}) * n * {documents}) div {max(1, length)} as bigint)")
    rows = stored.select(
        F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"),
        "row",
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"),
        m.alias("m"),
        F.explode(F.arrays_zip("terms", "tfs")).alias("p"),
    )
    part = F.expr(f"({SCALE} * p.tfs) div (1000 * p.tfs + 8 * m)")
    return rows.select("slice", "row", "id", F.col("p.terms").alias("term"), part.alias("part"))


def weighted_terms(parts: DataFrame, documents: int, owners: int = OWNERS) -> DataFrame:
    """Rows (term, weight, most, owner): ``most`` is the largest contribution of the term to any score."""
    df = parts.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    ratio = F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    rarity = F.floor(F.log(F.lit(float(max(1, documents))) / F.col("df")) / math.log(BAND))
    owner = F.greatest(F.lit(0), F.lit(owners - 1) - rarity).cast("int")
    return df.select("term", weight.alias("weight"), (F.col("most") * weight).alias("most"), owner.alias("owner"))


def bundle_terms(asked: DataFrame, weighted: DataFrame) -> DataFrame:
    """Rows (bundle, term, number, weight, most, owner): the terms of a bundle that some document holds, numbered."""
    each = asked.select("bundle", "term").distinct().join(weighted, "term")
    number = F.row_number().over(Window.partitionBy("bundle").orderBy("term"))
    return each.select("bundle", "term", number.alias("number"), "weight", "most", "owner")


def empty_bundles(asked: DataFrame, known: DataFrame, slices: int) -> DataFrame:
    """Every bundle of items over every slice, with its items' terms and without accumulators."""
    uses = asked.join(known, ["bundle", "term"]).select("bundle", F.struct("item", "number", "owner", "most").alias("use"))
    counts = asked.groupBy("bundle").agg((F.max("item") + 1).alias("count"))
    whole = uses.groupBy("bundle").agg(F.sort_array(F.collect_list("use")).alias("uses")).join(counts, "bundle")
    schema = T.StructType.fromDDL(_BUNDLE)
    given = {
        "slice": F.col("slice"),
        "bundle": F.col("bundle"),
        "items": F.col("uses.item"),
        "terms": F.col("uses.number"),
        "owners": F.col("uses.owner"),
        "mosts": F.col("uses.most"),
        "floors": F.array_repeat(F.lit(0), F.col("count")),
    }
    whole = whole.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return whole.select(*[given.get(f.name, F.array()).cast(f.dataType).alias(f.name) for f in schema.fields])


def _best(bundles: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item over all slices of ``bundles``, ranked."""
    entry = F.explode(F.arrays_zip(*_BEST)).alias("b")
    rows = bundles.select("bundle", entry).select("bundle", *[F.col(f"b.{name}") for name in _BEST])
    order = [F.col("best_score").desc(), F.col("best_id").asc(), F.col("best_row").asc()]
    return spread_best_per_group(rows, ["bundle", "best_item"], order, k, "rank", SPREAD)


def with_floors(bundles: DataFrame, k: int) -> DataFrame:
    """``bundles`` with each item's k-th best score so far over all slices; 0 where fewer documents have any."""
    kth = _best(bundles, k).where(F.col("rank") == k).select("bundle", F.struct("best_item", "best_score").alias("floor"))
    known = kth.groupBy("bundle").agg(F.map_from_entries(F.collect_list("floor")).alias("known"))
    floors = F.transform(
        F.sequence(F.lit(0), F.size("floors") - 1),
        lambda item: F.coalesce(F.try_element_at("known", item), F.lit(0).cast("long")),
    )
    return bundles.join(known, "bundle", "left").select(
        *[floors.alias(c) if c == "floors" else F.col(c) for c in bundles.columns]
    )


_QUERY = ("items", "terms", "owners", "mosts")
_BEST = ("best_item", "best_score", "best_id", "best_row")
_BUNDLE = (
    "slice int, bundle int, items array<int>, terms array<int>, owners array<int>, mosts array<bigint>, floors array<bigint>, "
    "rows array<bigint>, ids array<bigint>, acc_item array<int>, acc_doc array<int>, acc_score array<bigint>, "
    "best_item array<int>, best_score array<bigint>, best_id array<bigint>, best_row array<bigint>"
)


def _add_stage(stage: int, last: bool, k: int):
    """The cogroup function of one owner: a bundle over one slice and the owner's postings there."""

    def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    def run(bundles: pa.Table, found: pa.Table) -> pa.Table:
        kinds = {
            field.name: pa.list_(field.type.value_type) if pa.types.is_list(field.type) else field.type
            for field in bundles.schema
        }
        if not bundles.num_rows:
            return pa.schema(list(kinds.items())).empty_table()

        def values(name: str) -> np.ndarray:
            return bundles.column(name)[0].values.to_numpy(zero_copy_only=False)

        items, terms, owners, mosts = (values(name) for name in _QUERY)
        floors = values("floors")
        row, ident, term, gain = (found.column(c).to_numpy() for c in ("row", "id", "number", "gain"))
        # Documents of this slice that some accumulator or posting names.
        rows, first = np.unique(np.concatenate([values("rows"), row]), return_index=True)
        ids = np.concatenate([values("ids"), ident])[first]
        score = np.zeros((len(floors), len(rows)), dtype=np.int64)
        score[values("acc_item"), np.searchsorted(rows, values("rows"))[values("acc_doc")]] = values("acc_score")
        order = np.argsort(term, kind="stable")
        term, gain, doc = term[order], gain[order], np.searchsorted(rows, row[order])
        mine = owners == stage
        starts, ends = np.searchsorted(term, terms[mine]), np.searchsorted(term, terms[mine], side="right")
        for item, start, end in zip(items[mine], starts, ends, strict=True):
            score[item, doc[start:end]] += gain[start:end]  # one posting a document and term
        later = np.zeros(len(floors), dtype=np.int64)
        np.add.at(later, items[owners > stage], mosts[owners > stage])
        if len(rows) >= k:  # the k-th best of this slice is a floor as well
            floors = np.maximum(floors, np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k])
        item, doc = np.nonzero((score > 0) & (score >= (floors - later)[:, None]))
        reached = score[item, doc]
        best = np.lexsort((rows[doc], ids[doc], -reached, item))
        best = best[np.arange(len(best)) - np.searchsorted(item, item)[best] < k]
        out = {
            "floors": floors, "best_item": item[best], "best_score": reached[best], "best_id": ids[doc[best]],
            "best_row": rows[doc[best]],
        }
        if not last:
            used, doc = np.unique(doc, return_inverse=True)
            out |= {"rows": rows[used], "ids": ids[used], "acc_item": item, "acc_doc": doc, "acc_score": reached}
        columns = []
        for name, kind in kinds.items():
            if name in out:
                columns.append(listed(out[name], kind.value_type))
            elif name in ("slice", "bundle", *_QUERY):
                columns.append(bundles.column(name).cast(kind))
            else:
                columns.append(listed(np.empty(0, np.int64), kind.value_type))
        return pa.table(columns, names=list(kinds))

    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = KEPT, id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text", owners: int = OWNERS, slice_rows: int = SLICE,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` documents that score highest for each item, above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document scores for each term of the item, once,
    weight * (tf * 10^9 div (1000 tf + 8 m)). Null and empty texts hold no term and count nowhere; items without
    results give no rows; rows of one item id, also null, are one item with the terms of all. Repeated document rows
    are documents of their own, with ties among them in the order of the table; a null document id comes last among
    ties. Other columns are not read. The documents' postings, the accumulators of each stage and nothing else are
    stored in the shared folder.
    """
    terms = through_storage(item_terms(items, item_column, item_text), "rank-item-terms")
    asked = through_storage(terms.join(numbered_items(terms), terms["item_id"].eqNullSafe(F.col("_item"))).drop("_item"), "rank-asked")
    stored = through_storage(document_terms(docs, _vocabulary(terms), id_column, text), "rank-documents")
    documents, length = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, math.ceil(documents / slice_rows))
    parts = postings(stored, documents, length, slices).join(asked.select("term").distinct(), "term", "left_semi")
    known = through_storage(bundle_terms(asked, weighted_terms(parts, documents, owners)), "rank-terms")
    named = parts.join(known.select("bundle", "term", "number", "weight", "owner"), "term").select(
        "slice", "bundle", "row", "id", "number", (F.col("part") * F.col("weight")).alias("gain"), "owner"
    )
    named = through_storage(named, "rank-postings", ("owner",))
    bundles = empty_bundles(asked, known, slices)
    for stage in range(owners):
        owned = named.where(F.col("owner") == stage).select("slice", "bundle", "row", "id", "number", "gain")
        staged = bundles.groupBy("slice", "bundle").cogroup(owned.groupBy("slice", "bundle"))
        bundles = through_storage(staged.applyInArrow(_add_stage(stage, stage == owners - 1, k), _BUNDLE), f"rank-stage-{stage}")
        if stage < owners - 1:
            bundles = with_floors(bundles, k)
    best = _best(bundles, k).select("bundle", F.col("best_item").alias("item"), "rank", F.col("best_row").alias("row"), F.col("best_score").alias("score"))
    numbered = asked.select("bundle", "item", "item_id").distinct()
    return (
        best.join(numbered, ["bundle", "item"])
        .join(stored.select("row", "doc_id"), "row")
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
