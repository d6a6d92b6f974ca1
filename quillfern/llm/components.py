"""Connected components of a link table by randomised contraction.

In each round every node points to the neighbour (or itself) with the smallest hash under that
round's seed; links are rewritten to those nodes, made distinct and loops dropped. The number of
nodes with links shrinks by a constant factor on average, so rounds grow with the logarithm of
the largest component. Only minimum aggregates and equi joins are used: a hub's links are
pre-aggregated before each shuffle and its joins can be split, and no group is ever collected. What a round has used up is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfern.llm.common import drop_stash, stash


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long): every node that has a link, and one member of its component as the component's name."""
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    seed = 0
    while not edges.isEmpty():
        seed += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mixed = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: E731, B023
        points = both.groupBy("a").agg(F.min_by("b", mixed("b")).alias("m")).select(F.col("a").alias("node"), F.when(mixed("m") < mixed("node"), F.col("m")).otherwise(F.col("node")).alias("to"))
        points = stash(points, "points")
        known = labels
        if known is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            labels = known.join(points.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = stash(labels, "labels")
        if known is not None:
            drop_stash(known)
        left = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        before = edges
        edges = stash(left.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        drop_stash(before, points)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
