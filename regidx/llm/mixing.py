"""Mixing sources to target weights: exact block quotas, dealt to shards by a splitting tree.

Every source's documents are put in a random order (a digest of the id) and cut into blocks of
nearly equal numbers of words. A source's target says how many blocks are drawn, whole passes
first; the last pass draws blocks that hold the rest of the target to within half a document.
The drawn blocks of all sources are the leaves' quotas of a binary tree over the output shards:
at each node the quotas of one half follow the multivariate hypergeometric law, so each shard
is a random sample of all draws and the quotas add up exactly. A shard takes its blocks, no
block of a pass twice, and shuffles their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regidx.llm.common import let, replaced
from regidx.session import through_storage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
CAP = 3
#: Words of a block, blocks of a shard, and rows whose running sizes one window adds up (all by expectation).
BLOCK_WORDS, SHARD_BLOCKS, CELL_ROWS = 1 << 16, 64, 20_000
SEED = 7
#: A prime above the number of draws of any source; the product with a draw's number fits a long.
STRIDE, MOST_DRAWS = 2_654_435_761, 1 << 31
#: Tree level from which nodes are spread over tasks.
SPREAD_LEVEL = 6
_NEW = ("size", "source_size", "target", "copies", "taken")


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (words of the text; null: 0) and ``_draw``, the document's random number below 2^60."""
    name = F.coalesce(F.col(id_column).cast("string"), F.md5(F.col(text)), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), name))
    return replaced(docs, "size", "_draw").select(
        "*",
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long").alias("_draw"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size) with ``place`` in code-point order (null last) and ``target``.

    The weights, repeated in that order, share the sum of all sizes. A target stops at ``cap`` times its source's
    size and the excess goes to the others by weight: where t is the water level that uses up the sum,
    target = least(cap * size, t * weight). The table of sources (one short row each) passes through one task.
    """
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = placed.withColumn("weight", share.cast("long")).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy(F.lit(0))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The level if just the sources before this one stop at their caps; the first one it leaves below its cap settles it.
    left = F.sum("source_size").over(everything) - (F.sum("most").over(rising) - F.col("most"))
    level = left.cast("double") / (F.sum("weight").over(everything) - (F.sum("weight").over(rising) - F.col("weight")))
    rows = rows.withColumn("_level", level).withColumn(
        "_settles", F.when(F.col("_level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))
    )
    water = F.min(F.when(F.col("_settles").isNotNull(), F.struct("_settles", "place", "_level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.col("weight") * water["_level"])
    return rows.select("source", "source_size", "place", target.alias("target"))


def block_plan(wanted: DataFrame, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Targets with whole ``passes``, ``rest`` words of the last pass, its ``near`` blocks, all ``blocks``, all ``draws``."""
    size, target = F.col("source_size"), F.col("target")
    passes = F.least(F.lit(cap), F.coalesce(F.floor(F.try_divide(target, size)), F.lit(0))).cast("long")
    rest = F.when(F.col("passes") < cap, F.round(target - F.col("passes") * size)).otherwise(0).cast("long")

    def cut(words: Column) -> Column:
        return F.when(words > 0, F.greatest(F.lit(1), F.round(words / block_words))).otherwise(0).cast("long")

    return (
        wanted.withColumn("passes", passes)
        .withColumn("rest", rest)
        .withColumn("near", cut(F.col("rest")))
        .withColumn("blocks", F.col("near") + cut(size - F.col("rest")))
        .withColumn("draws", F.col("passes") * F.col("blocks") + F.col("near"))
    )


def hypergeometric(everyone: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` out of ``everyone`` are ``marked``, by inverting the distribution at ``uniform``.

    Weights follow from one another by their ratio, within 12 standard deviations and 20 of the mean; what lies
    beyond is less likely than a double can tell.
    """
    share = marked / F.greatest(everyone, F.lit(1))
    spread = F.sqrt(drawn * share * (1 - share) * (everyone - drawn) / F.greatest(everyone - 1, F.lit(1)))
    reach = F.ceil(spread * 12).cast("long") + 20
    middle = F.floor(drawn * share).cast("long")
    places = F.sequence(
        F.greatest(F.lit(0).cast("long"), drawn + marked - everyone, middle - reach),
        F.least(drawn, marked, middle + reach),
    )

    def ratio(k: Column) -> Column:
        return ((marked - k).cast("double") * (drawn - k)) / ((k + 1).cast("double") * (everyone - marked - drawn + k + 1))

    def inverse(places: Column) -> Column:
        total = F.aggregate(
            places,
            F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum")),
            lambda s, k: F.struct((s["weight"] * ratio(k)).alias("weight"), (s["sum"] + s["weight"]).alias("sum")),
            lambda s: s["sum"],
        )
        return let(
            total * uniform,
            lambda point: F.aggregate(
                places,
                F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), places[0].alias("pick")),
                lambda s, k: F.struct(
                    (s["weight"] * ratio(k)).alias("weight"),
                    (s["sum"] + s["weight"]).alias("sum"),
                    F.when(s["sum"] <= point, k).otherwise(s["pick"]).alias("pick"),
                ),
                lambda s: s["pick"],
            ),
        )

    return let(places, inverse)


def _left_quotas(parts: Column, capacity: Column, total: Column, low: Column, high: Column, seed: int) -> Column:
    """How many draws of each part go to the left half of a node: one hypergeometric draw after the other."""

    def step(state: Column, part: Column) -> Column:
        number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), low, high, part["place"]), 11) / float(1 << 53)
        taken = hypergeometric(state["all"], part["quota"], state["room"], number)
        return let(
            taken,
            lambda k: F.struct(
                (state["room"] - k).alias("room"),
                (state["all"] - part["quota"]).alias("all"),
                F.concat(state["taken"], F.array(k)).alias("taken"),
            ),
        )

    start = F.struct(capacity.alias("room"), total.alias("all"), F.array().cast("array<bigint>").alias("taken"))
    return F.aggregate(parts, start, step, lambda state: state["taken"])


def shard_quotas(plan: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (shard, place, first, quota): shard ``shard`` takes the draws first ... first + quota - 1 of a source."""
    parts = F.sort_array(
        F.collect_list(F.struct("place", F.lit(0).cast("long").alias("first"), F.col("draws").alias("quota")))
    )
    nodes = plan.where("draws > 0").agg(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.sum("draws").alias("all"), parts.alias("parts"))
    nodes = nodes.where(F.col("all") > 0)

    def cut(shard: Column) -> Column:  # draws of the shards before this one
        return F.floor(F.col("all") / F.lit(shards) * shard).cast("long")

    for level in range((shards - 1).bit_length()):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition("lo")
        lo, hi = F.col("lo"), F.col("hi")
        middle = F.floor((lo + hi) / 2).cast("long")
        quotas = _left_quotas(F.col("parts"), cut(middle) - cut(lo), cut(hi) - cut(lo), lo, hi, seed)
        halves = nodes.select("all", "lo", "hi", middle.alias("middle"), "parts", quotas.alias("taken"))

        def half(left: bool):
            def one(part: Column, k: Column) -> Column:
                first, quota = (part["first"], k) if left else (part["first"] + k, part["quota"] - k)
                return F.struct(part["place"].alias("place"), first.alias("first"), quota.alias("quota"))

            kept = F.filter(F.zip_with("parts", "taken", one), lambda part: part["quota"] > 0)
            ends = ("lo", "middle") if left else ("middle", "hi")
            return F.struct(F.col(ends[0]).alias("lo"), F.col(ends[1]).alias("hi"), kept.alias("parts"))

        halves = halves.select("all", F.explode(F.array(half(True), half(False))).alias("node"))
        nodes = halves.select("all", "node.*").where("hi > lo")
    return nodes.select(F.col("lo").alias("shard"), F.explode("parts").alias("part")).select("shard", "part.*")


def block_draws(plan: DataFrame, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (place, block, copies): every block drawn, with the pass and the shard of each of its draws.

    Position p of a source is its draw (STRIDE * p + offset) mod draws, a one-to-one map that mixes blocks and passes.
    """
    span = F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)
    dealt = quotas.select("shard", "place", F.explode(span).alias("position"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("place")), F.col("draws"))
    number = (F.col("position") * STRIDE % F.col("draws") + offset) % F.col("draws")
    drawn = dealt.join(plan.select("place", "blocks", "draws"), "place").withColumn("_number", number)
    copy = F.struct(F.expr("_number div blocks").cast("int").alias("pass"), F.col("shard"))
    return drawn.groupBy("place", (F.col("_number") % F.col("blocks")).alias("block")).agg(
        F.sort_array(F.collect_list(copy)).alias("copies")
    )


def mix(
    sized: DataFrame, id_column: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> DataFrame:
    """``sized`` (see ``measured``) with ``source_size``, ``target``, ``copies`` and ``taken``, one row per document.

    ``copies`` has the pass and the output shard of each time the mix takes the document (0 to ``cap`` times) and
    ``taken`` the words of all copies. A null source is a source of its own; texts without a word have size 0 and
    add nothing. Repeated rows are separate documents; an empty table gives no rows; other columns are kept, those
    named like new ones are replaced. All rows are stored once in the shared folder. A source may hold any share
    of the rows: running sizes are added up in cells of some 20,000 rows and then over cells, joins are by
    cell or by block. Draws of one source are limited to 2^31 blocks.
    """
    docs = through_storage(replaced(sized, *[n for n in _NEW if n != "size"]), "mixing")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    rows = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    plan = through_storage(block_plan(targets(sizes.drop("_rows"), weights, cap), cap, block_words), "mixing-plan")
    draws, most = plan.agg(F.coalesce(F.sum("draws"), F.lit(0)), F.coalesce(F.max("draws"), F.lit(0))).first()
    if most >= MOST_DRAWS:
        raise ValueError(f"a source of {most} block draws: raise block_words")
    shards = max(1, -(-draws // shard_blocks))
    drawn = block_draws(plan, shard_quotas(plan, shards, seed), seed)

    # Columns of this function start with _mix_, so those of the caller cannot clash.
    own = docs.withColumns({"_mix_cell": F.col("_draw") % max(1, -(-rows // CELL_ROWS)), "_mix_size": F.col("size")})
    cells = own.groupBy(F.col(source).alias("_mix_source"), F.col("_mix_cell").alias("_mix_in")).agg(
        F.sum("_mix_size").alias("_mix_words")
    )
    upto = Window.partitionBy("_mix_source").orderBy("_mix_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_mix_before", F.sum("_mix_words").over(upto) - F.col("_mix_words"))
    known = plan.select(*[F.col(c).alias(f"_mix_plan_{c}") for c in plan.columns])
    cells = cells.join(known, F.col("_mix_source").eqNullSafe(F.col("_mix_plan_source")))
    inside = Window.partitionBy(source, "_mix_cell").orderBy("_draw", id_column, "_mix_size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    located = own.withColumn("_mix_upto", F.sum("_mix_size").over(inside)).join(
        cells, F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_cell") == F.col("_mix_in"))
    )
    # Twice the middle of the document in its source's order; the near blocks hold the rest of the target.
    middle = 2 * (F.col("_mix_before") + F.col("_mix_upto")) - F.col("_mix_size")
    near, rest = F.col("_mix_plan_near"), F.col("_mix_plan_rest")
    far = F.col("_mix_plan_blocks") - near

    def part(place: Column, words: Column, blocks: Column) -> Column:
        return F.least(blocks - 1, F.floor(place / F.greatest(2 * words, F.lit(1)) * blocks).cast("long"))

    block = F.when(middle < 2 * rest, part(middle, rest, near)).otherwise(
        near + part(middle - 2 * rest, F.col("_mix_plan_source_size") - rest, far)
    )
    drawn = drawn.select(*[F.col(c).alias(f"_mix_drawn_{c}") for c in drawn.columns])
    taken = (F.col("_mix_plan_place") == F.col("_mix_drawn_place")) & (F.col("_mix_block") == F.col("_mix_drawn_block"))
    located = located.withColumn("_mix_block", block).join(drawn, taken, "left")
    copies = F.coalesce("_mix_drawn_copies", F.array().cast("array<struct<pass:int,shard:bigint>>"))
    return located.select(
        *[f"`{c}`" for c in docs.columns if c != "_draw"],
        F.col("_mix_plan_source_size").alias("source_size"),
        F.col("_mix_plan_target").alias("target"),
        copies.alias("copies"),
        (F.size(copies) * F.col("_mix_size")).cast("long").alias("taken"),
    )


def shuffled(mixed: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix itself: a row per copy of a document, with its ``shard`` and its ``position`` there in random order."""
    rows = replaced(mixed, "shard", "pass", "position").select("*", F.explode("copies").alias("_copy"))
    order = F.xxhash64(F.lit(seed), F.col("_copy.shard"), F.col("_copy.pass"), F.col(id_column))
    local = Window.partitionBy("_copy.shard").orderBy(order, id_column, "_copy.pass", "size")
    return rows.select(
        "*", F.col("_copy.shard").alias("shard"), F.col("_copy.pass").alias("pass"), F.row_number().over(local).alias("position")
    ).drop("_copy", "copies")
