"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.llm.blocks import by_group, merge, split_groups
from regidx.llm.components import components
from regidx.session import through_storage

COSINE, LEAF = 0.9, 400
#: Trees at least; more are grown until at most MISSED of PLANTED pairs just at the threshold meet in no tree.
TREES, PLANTED, MISSED = 7, 2_000, 0.001
#: Vectors within this many deviations of a linked pair's difference from a split go to both sides.
SPILL = 0.4
#: Distinct vectors that thresholds are learned from; nodes with fewer of them than LEARN split at the level's median.
SAMPLE, LEARN = 20_000, 64


def direction(tree: int, level: int, size: int) -> np.ndarray:
    ray = np.random.default_rng([tree, level, size, 20260]).normal(size=size)
    return ray / np.linalg.norm(ray)


def spill_of(size: int, cosine: float) -> float:
    return SPILL * np.sqrt((2 - 2 * cosine) / size)


def learn_tree(sample: np.ndarray, tree: int, depth: int) -> list[tuple[float, dict[int, float]]]:
    """Per level: the sample's median on that level's direction, and the median of each node with enough sample."""
    node = np.zeros(len(sample), np.int64)
    levels = []
    for level in range(depth):
        on = sample @ direction(tree, level, sample.shape[1])
        common = float(np.median(on)) if len(on) else 0.0
        names, where, n = np.unique(node, return_inverse=True, return_counts=True)
        cuts = {int(names[k]): float(np.median(on[where == k])) for k in np.flatnonzero(n >= LEARN)}
        levels.append((common, cuts))
        node = node * 2 + (on > np.array([cuts.get(int(x), common) for x in names])[where] if len(on) else 0)
    return levels


def route(units: np.ndarray, levels, tree: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a vector falls or spills into."""
    rows, node = np.arange(len(units)), np.zeros(len(units), np.int64)
    spill = spill_of(units.shape[1], cosine)
    for level, (common, cuts) in enumerate(levels):
        on = (units @ direction(tree, level, units.shape[1]))[rows]
        names, where = np.unique(node, return_inverse=True)
        off = on - np.array([cuts.get(int(x), common) for x in names])[where]
        left, right = off <= spill, off > -spill
        rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
    return rows, node


def planted(units: np.ndarray, cosine: float, n: int = PLANTED, seed: int = 20260) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``units`` with partners that have just the given cosine to them, in directions drawn from a seed."""
    rng = np.random.default_rng([seed, units.shape[1]])
    one = units[rng.integers(0, len(units), n)]
    aside = rng.normal(size=one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    long = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, long, out=np.zeros_like(aside), where=long > 1e-9)
    return one, units_of(cosine * one + np.sqrt(max(0.0, 1 - cosine**2)) * aside)


def meet(one: np.ndarray, other: np.ndarray, levels, tree: int, cosine: float) -> np.ndarray:
    """Which of the pairs (one[i], other[i]) share a leaf of the tree."""
    (row, leaf), (row2, leaf2) = (route(side, levels, tree, cosine) for side in (one, other))
    both = np.intersect1d((row << len(levels)) | leaf, (row2 << len(levels)) | leaf2)
    met = np.zeros(len(one), bool)
    met[both >> len(levels)] = True
    return met


def learn_forest(sample: np.ndarray, depth: int, cosine: float, trees: int = TREES) -> list:
    """Trees, ``trees`` at least, until pairs planted in the sample at the threshold meet but for the share MISSED.

    What a tree separates grows with its depth, and the closer the vectors lie at a split the more: planted pairs
    measure both, so the bound is the same for any input.
    """
    one, other = planted(sample, cosine)
    forest, apart = [], np.ones(len(one), bool)
    while len(forest) < trees or apart.mean() > MISSED:
        tree = len(forest)
        forest.append(learn_tree(sample, tree, depth))
        apart[apart] = ~meet(one[apart], other[apart], forest[-1], tree, cosine)
    return forest


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two first brings huge and tiny ones to where squares neither overflow nor vanish."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _linked(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        here = int(group["leaf"].iloc[0])
        units = units_of(np.stack(group["v"].to_numpy()).astype(np.float64))
        homes = np.flatnonzero(group["_home"].to_numpy(bool))
        copies = group["copies"].to_numpy(np.int64)
        label, counts = np.arange(len(units)), np.zeros(len(units), np.int64)
        # A pair is counted in the first leaf that it shares: earlier leaves are columns of ``met``.
        lists = [[x for x in leaves if x < here] for leaves in group["leaves"]]
        earlier = {x: i for i, x in enumerate(sorted({x for row in lists for x in row}))}
        step = max(1, 2_000_000 // len(units))
        for start in range(0, len(homes), step):
            part = homes[start : start + step]
            near = units[part] @ units.T >= cosine
            near[np.arange(len(part)), part] = False
            a, b = np.nonzero(near)
            if not len(a):
                continue
            label = merge(label, part[a], b)
            left, right = np.unique(a), np.unique(b)
            if earlier:
                met = [np.zeros((len(side), len(earlier)), np.float32) for side in (left, right)]
                for side, rows in zip(met, (part[left], right), strict=True):
                    for i, row in enumerate(rows):
                        side[i, [earlier[x] for x in lists[row]]] = 1
                near[np.ix_(left, right)] &= met[0] @ met[1].T == 0
            counts[part] += near @ copies
        moved = np.flatnonzero((label != np.arange(len(units))) | (counts > 0))
        name = group["name"].to_numpy(np.int64)
        return pd.DataFrame({"u": name[moved], "v": name[label[moved]], "n": counts[moved]})

    return run


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least ``cosine``. A vector that is null,
    empty, zero, or holds a null or a non-finite number links with nothing; vectors of
    different lengths do not link. Equal vectors are compared once and count as often as they
    occur. component_id is the least vec_id that links reach, kept tells whether it is the
    row's own. Other columns are dropped; repeated ids are rows of their own.

    The search is approximate, the links are exact: a pair is compared if any tree has it in
    one leaf. There are ``trees`` at least, and as many as ``learn_forest`` needs at this depth. Each vector is sent
    to every leaf it spills into (about trees * 1.14**depth, more if the vectors lie close).
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    usable = F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("_id"), F.when(usable, x).alias("v"))
    named = rows.withColumn("name", F.xxhash64("v"))
    classes = through_storage(
        named.where("v IS NOT NULL").groupBy("name", "v").agg(F.count("*").alias("copies"), F.min("_id").alias("least")),
        "vector-classes",
    )
    sizes = [(r.size, r.n) for r in classes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()]
    forest = {}
    for size, n in sizes:
        of_size = classes.where(F.size("v") == size)
        sample = of_size.select("name", "v").orderBy(F.xxhash64("name", F.lit(1)), "name").limit(SAMPLE).toPandas()
        units = units_of(np.stack(sample["v"].to_numpy()))
        # Spilled leaves hold n * 1.14**depth / 2**depth vectors.
        depth = max(0, ceil(log2(n / leaf) / (1 - log2(1.14)))) if n > leaf else 0
        forest[size] = learn_forest(units, depth, cosine, trees)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def to_leaves(batches):
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["v"].map(len)
            for size in sizes.unique():
                part = frame[sizes == size]
                units = units_of(np.stack(part["v"].to_numpy()).astype(np.float64))
                found = []
                of_size = shared.value[size]
                for tree, levels in enumerate(of_size):
                    row, node = route(units, levels, tree, cosine)
                    found.append((row, node * len(of_size) + tree))
                row = np.concatenate([r for r, _ in found])
                leaves = np.concatenate([n for _, n in found])
                order = np.lexsort((leaves, row))
                row, leaves = row[order], leaves[order]
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                lists = [leaves[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
                for start in range(0, len(row), 4096):
                    at = row[start : start + 4096]
                    yield pa.RecordBatch.from_pandas(
                        pd.DataFrame({
                            "name": part["name"].to_numpy()[at], "copies": part["copies"].to_numpy()[at],
                            "v": part["v"].to_numpy()[at], "size": np.full(len(at), size, np.int32),
                            "leaf": leaves[start : start + 4096], "leaves": [lists[i] for i in at],
                        }),
                        schema=SENT, preserve_index=False,
                    )

    sent = classes.select("name", "copies", F.col("v").cast("array<double>").alias("v")).mapInArrow(
        to_leaves, "name long, copies long, v array<double>, size int, leaf long, leaves array<long>"
    )
    split = split_groups(sent, ["size", "leaf"], "name")
    met = through_storage(by_group(split, ["size", "leaf", "_chunk"], _linked(cosine), "u long, v long, n long"), "vector-links")
    reached = components(met.where("u <> v").select("u", "v"), "vectors").withColumnRenamed("node", "name")
    counts = met.groupBy(F.col("u").alias("name")).agg(F.sum("n").alias("n"))
    known = (
        classes.drop("v").join(reached, "name", "left").join(counts, "name", "left")
        .withColumn("component", F.coalesce("component", "name"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_name = through_storage(
        known.join(least, "component").select(
            "name", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
        ),
        "vector-components",
    )
    lone = F.col("v").isNull()
    joined = named.withColumn("name", F.when(~lone, F.col("name"))).join(by_name, "name", "left")
    return joined.select(
        F.col("_id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(lone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(lone, True).otherwise(F.col("_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


SENT = pa.schema([
    ("name", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64())), ("size", pa.int32()),
    ("leaf", pa.int64()), ("leaves", pa.list_(pa.int64())),
])
