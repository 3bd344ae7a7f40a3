"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
        edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").where("v <> low").select(F.col("v").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select(F.col("u").alias("src"), F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the least node.

    Self-loops and null ends are ignored, so a node without a partner has no row.
    Rounds needed grow with the logarithm of the longest path; each round writes
    its edges to the shared folder and the driver sees one row of counts.
    """
    now = (
        edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .distinct()
    )
    now = materialize(now, "edges")
    before = None
    while True:
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
