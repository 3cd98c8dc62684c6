"""Line dedup by a log-template tree: lines of templates that recur across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.llm.common import let, replaced, row_key
from regidx.session import discard, through_storage

#: Leading tokens that lead to a leaf of the tree, below the number of tokens.
DEPTH = 3
#: Documents in which a template recurs; tokens of a leaf in fewer documents are variable.
DOCUMENTS = 5
#: Share of a line's tokens after the leading ones that a generalised template must keep.
SIMILAR = 0.5
VARIABLE = "<*>"
BLANKS = r"[ \t\x0B\f\r]+"
#: A line with a constant token: one without digits that is not the variable mark itself.
CONSTANT = r"(?:^|[ \t\x0B\f\r])(?!<\*>(?:[ \t\x0B\f\r]|\z))[^0-9 \t\x0B\f\r]+(?:[ \t\x0B\f\r]|\z)"


def masked(line: Column) -> Column:
    """The line's tokens joined by one space, those with a digit replaced by the variable mark.

    Without a constant token the mask says nothing of the line, which then keeps its own tokens.
    """
    tokens = F.filter(F.split(line, BLANKS), lambda t: t != "")
    marked = F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.lit(VARIABLE)).otherwise(t))
    return F.when(
        F.rlike(line, F.lit(r"[0-9\t\x0B\f\r]|  ")),
        F.array_join(F.when(F.rlike(line, F.lit(CONSTANT)), marked).otherwise(tokens), " "),
    ).otherwise(line)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def distinct_masked(text: Column) -> Column:
    """The text's distinct masked lines that hold a token."""
    return F.filter(F.array_distinct(F.transform(lines_of(text), lambda l: masked(F.btrim(l)))), lambda m: m != "")


def leaf_of(line: Column) -> Column:
    """The tree's leaf: number of tokens, then the leading tokens, hashed."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(spaces, F.substring_index(line, " ", DEPTH))


def templates(lines: DataFrame, documents: int, similar: float) -> DataFrame:
    """(mark, template) for those distinct ``lines`` (mark, leaf, line, n_docs) of the leaves that are generalised.

    A token stays if it stands at its place in enough lines of its leaf, a line of several documents counted
    in each; the others are variable. The leading tokens are equal in a leaf, so say nothing: a line that would keep
    less than the share ``similar`` of the tokens after them, that has none, or that has no constant token, is
    its own template and not returned. Tokens are compared and shuffled as hashes of leaf, place and token; a template
    is the exclusive or of those that stay, so it is added up in each task and no line is put together again.
    """
    tokens = (
        lines.where(F.rlike("line", F.lit(CONSTANT)))
        .select("mark", "leaf", "n_docs", F.split("line", " ").alias("tokens"))
        .where(F.size("tokens") > DEPTH)
        .select("mark", "leaf", "n_docs", (F.size("tokens") - DEPTH).alias("later"), F.posexplode(F.slice("tokens", DEPTH + 1, F.size("tokens"))).alias("place", "token"))
        .where(F.col("token") != VARIABLE)
        .select("mark", "leaf", "later", "n_docs", F.xxhash64("leaf", "place", "token").alias("token"))
    )
    common = tokens.groupBy("token").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= documents).select("token")
    return (
        tokens.drop("n_docs").join(common, "token", "left_semi")
        .groupBy("mark", "leaf", "later").agg(F.count("*").alias("kept"), F.bit_xor("token").alias("tokens"))
        .where(F.col("kept") >= similar * F.col("later"))
        .select("mark", F.xxhash64("leaf", "kept", "tokens").alias("template"))
    )


def drop_recurring_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    documents: int = DOCUMENTS,
    similar: float = SIMILAR,
    n_chars: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with text without recurring lines, and n_lines, n_dropped (before and of the change).

    A template recurs if lines of at least ``documents`` distinct documents have it. Its lines stay in
    the document with the least id (there each line's first copy) and go everywhere else, whatever stands in
    their variable places. Lines without a constant token recur only as they are. Blank lines stay. Null text: no line, stays null; a text may become empty,
    its row stays. Rows of one id and text are one document; rows of a null id count as one
    document per text and are first of all. A column ``n_chars`` follows the new text.

    A common line is counted in each task before it is shuffled, and is a join key that Spark can split. Leaves with
    lines of too few documents go first; of the others, each distinct line is shuffled once, all else as hashes.
    Texts move once, for the last join.
    """
    docs = replaced(docs, "n_lines", "n_dropped")
    base = docs.select(F.struct("*").alias("_doc"), *row_key(doc_id, text))
    body = F.col(f"_doc.`{text}`")
    leaves = through_storage(
        base.select(F.explode(F.array_distinct(F.transform(distinct_masked(body), leaf_of))).alias("leaf"))
        .groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("leaf"),
        "line-leaves",
    )
    exploded = base.select("_id", "_row", F.explode(distinct_masked(body)).alias("line"))
    met = through_storage(
        exploded.withColumn("leaf", leaf_of(F.col("line"))).join(leaves, "leaf", "left_semi").withColumn("mark", F.xxhash64("line")),
        "line-candidates",
    )
    pairs = through_storage(met.select("_id", "_row", "mark").distinct(), "line-documents")
    counted = pairs.groupBy("mark").agg(F.count("*").alias("n_docs"))
    lines = met.groupBy("mark").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line")).join(counted, "mark")
    lines = through_storage(lines, "line-texts")
    discard(met)
    known = templates(lines, documents, similar)
    placed = through_storage(
        pairs.join(known, "mark", "left").select("_id", "_row", F.coalesce("template", "mark").alias("template"), "mark"),
        "line-templates",
    )
    for stored in (leaves, pairs, lines):
        discard(stored)
    recurring = (
        placed.groupBy("template", "_id", "_row").agg(F.lit(1).alias("one"))
        .groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_row")).alias("first"))
        .where(F.col("n") >= documents)
    )
    first = (F.col("first._id") == F.col("_id")) & (F.col("first._row") == F.col("_row"))
    marks = placed.join(recurring, "template").groupBy("_id", "_row").agg(
        F.collect_set(F.when(~first, F.col("mark"))).alias("_gone"), F.collect_set(F.when(first, F.col("mark"))).alias("_once")
    )
    none = F.array().cast("array<long>")

    def keep(lines: Column, gone: Column, once: Column) -> Column:
        hashed = F.transform(lines, lambda l: F.xxhash64(masked(F.btrim(l))))
        return let(
            hashed,
            lambda h: F.transform(
                F.filter(
                    F.arrays_zip(lines.alias("l"), F.transform(h, lambda x, i: ~F.array_contains(gone, x) & ~(F.array_contains(once, x) & (F.array_position(h, x) <= i))).alias("k")),
                    lambda z: z["k"],
                ),
                lambda z: z["l"],
            ),
        )

    joined = base.join(marks, ["_id", "_row"], "left")
    lines = lines_of(body)
    changed = F.when(
        F.col("_gone").isNotNull(), let(lines, lambda l: keep(l, F.coalesce("_gone", none), F.coalesce("_once", none)))
    ).otherwise(lines)
    cut = joined.select("_doc", F.when(body.isNotNull(), F.struct(F.size(lines).cast("long").alias("n"), changed.alias("kept"))).alias("_cut"))
    new_text = F.array_join("_cut.kept", "\n")
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(new_text.alias(name))
        elif name == n_chars:
            columns.append(F.when(F.col("_cut").isNotNull(), F.length(new_text)).otherwise(F.col(f"_doc.`{name}`")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"_doc.`{name}`"))
    return cut.select(
        *columns,
        F.coalesce("_cut.n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("_cut.n") - F.size("_cut.kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
