"""Connected components of a graph given as a table of edges, by alternating star steps.

Each step links every node to the smallest node it knows: a grouped minimum (combined before the
shuffle) and an equi-join back, so a node with very many neighbours is split like any skewed key.
Rounds grow with the logarithm of the longest chain.  Every round's edges are written to the
shared checkpoint folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """``edges`` (u, v) with u > v.  ``both``: link larger neighbours of every node to its minimum;
    else link a node's smaller neighbours, and itself, to its minimum."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge, and the smallest node that it reaches.

    ``edges`` has two columns of one ordered type; direction, repeats, loops and nulls don't matter.
    """
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    e = cut_lineage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seen = None
    while True:
        e = cut_lineage(_star(_star(e, True), False), "components")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    # at rest every edge leads to its component's smallest node
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
