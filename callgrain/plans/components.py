"""Connected components of an edge table (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.plans.skew import skew_join
from callgrain.session import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    Edges point from the larger to the smaller id. A round hangs every node under the smallest id
    it can see; the rounds needed grow with the logarithm of the size. Each round is written to the
    shared folder. In a star all edges share the root, hence the balanced join on it.
    """
    stars = materialize(
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    before = _signature(stars)
    while before[0]:
        lower = stars.groupBy("a").agg(F.min("b").alias("m"))
        above = skew_join(stars, lower.withColumnRenamed("a", "b"), ["b"], ["a"], "left", rows=before[0])
        large = above.select("a", F.coalesce("m", "b").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _signature(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
