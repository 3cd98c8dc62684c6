"""Vector cells: an index copy clustered by nearest centroid, for approximate search.

The copy is an inverted table from cells to rows. Queries are exploded to the cells they probe
and joined with it by cell; large cells are salted into parts and many queries of a cell into
blocks, so a task holds a bounded part of both. Searching with every cell probed equals the exact
search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.fixed import VECTOR_CELLS
from regidx.functions.vectors import l2_norm, unit_vector


def train_centroids(index: DataFrame, cells: int = VECTOR_CELLS, seed: int = 17, fraction: float = 1.0) -> np.ndarray:
    """Cosine k-means centroids. ``fraction`` trains on a sample of a very large
    table; it affects only which rows share a cell, never which rows are stored."""
    source = index.filter(F.col("embedding").isNotNull() & (l2_norm(F.col("embedding")) > 0))
    if fraction < 1.0:
        source = source.sample(fraction, seed)
    unit = unit_vector(F.col("embedding"), l2_norm(F.col("embedding")))
    points = source.select(array_to_vector(unit.cast("array<double>")).alias("features"))
    means = KMeans(k=cells, seed=seed, distanceMeasure="cosine", initMode="k-means||", maxIter=10)
    centroids = np.array(means.fit(points).clusterCenters())
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids / np.where(norms > 0, norms, 1.0)


def _nearest(df: DataFrame, centroids: np.ndarray, count: int, out: str) -> DataFrame:
    """Add the ``count`` nearest cells of each vector, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    kind = T.ArrayType(T.IntegerType())

    @F.pandas_udf(kind)
    def nearest(vectors: pd.Series) -> pd.Series:
        table = shared.value
        matrix = np.zeros((len(vectors), table.shape[1]))
        given = vectors.notna().to_numpy()
        if given.any():
            # Raises for vectors of another length, which no cell can hold.
            matrix[given] = np.stack(vectors[given].to_numpy()).reshape(-1, table.shape[1])
        order = np.argsort(-(matrix @ table.T), axis=1, kind="stable")[:, :count]
        return pd.Series(order.astype(np.int32).tolist())

    return df.withColumn(out, nearest("embedding"))


def assign_cells(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    assigned = _nearest(index, centroids, 1, "_cell")
    return assigned.withColumn("cell", F.col("_cell")[0]).drop("_cell")


def probe_cells(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Queries with the cells they should read."""
    return _nearest(queries, centroids, min(probes, len(centroids)), "cells")


def write_cells(index: DataFrame, centroids: np.ndarray, path: str) -> str:
    """Store the clustered copy, one folder per cell; large cells span several files."""
    rows = assign_cells(index, centroids).hint("rebalance", F.col("cell"))
    rows.write.mode("overwrite").partitionBy("cell").parquet(path)
    return path


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cell_statistics(cells: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per cell: rows, mean and least cosine of its vectors to the centroid; null and zero vectors count as rows only."""
    spark = cells.sparkSession
    known = spark.createDataFrame(
        [(number, [float(x) for x in row]) for number, row in enumerate(np.asarray(centroids, dtype=np.float64))],
        "cell int, centroid array<double>",
    )  # as many rows as centroids
    dot = F.aggregate(
        F.zip_with("embedding", "centroid", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x
    )
    norm = l2_norm(F.col("embedding"))
    cosine = F.when(norm > 0, dot / norm / l2_norm(F.col("centroid")))
    found = cells.select(F.col("cell").cast("int").alias("cell"), "embedding").join(F.broadcast(known), "cell")
    return found.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(cosine).alias("mean_cosine"), F.min(cosine).alias("least_cosine")
    )


def refresh_statistics(spark: SparkSession, path: str, centroids: np.ndarray) -> DataFrame:
    """Statistics of the stored copy, kept beside it; to be called after each load."""
    beside = f"{path.rstrip('/')}-statistics"
    cell_statistics(read_cells(spark, path), centroids).coalesce(1).write.mode("overwrite").parquet(beside)
    return spark.read.parquet(beside)


def cell_work(statistics: DataFrame | None, probing: DataFrame, part_rows: int, block_queries: int) -> DataFrame:
    """Rows (cell, parts, blocks) of the probed cells: into how many parts its rows and how many blocks its queries go.

    A cell that the statistics do not know counts as one part, so old statistics cost speed, not results.
    """
    asked = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    if statistics is None:
        return asked.withColumn("parts", F.lit(1))
    sizes = statistics.select("cell", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts"))
    return asked.join(sizes, "cell", "left").withColumn("parts", F.greatest(F.lit(1), F.coalesce("parts", F.lit(1))))
