"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regidx.session import through_storage


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (two long columns ``u``, ``v``).

    The component is the smallest node that can be reached. Self links and repeated
    links are allowed; a null end is ignored. Nodes without a link do not appear.
    Each round shuffles the links twice and stores them in the shared folder; the hub of a
    large group is only ever a join key (which Spark splits) or a pre-aggregated minimum.
    """
    links = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u > v").distinct()
    links = through_storage(links, f"{label}-links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = (
            both.where("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Smaller ends stay links to the minimum, so nothing comes apart.
        small = large.join(_minima(large), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        links = through_storage(small.select("e.u", "e.v").where("u > v").distinct(), f"{label}-round")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
