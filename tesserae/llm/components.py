"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the least node that can be reached.

    Each round hooks every node onto its least neighbour, follows two more steps
    up, and replaces the ends of the links by what they reached.  A node and its
    parent stay linked, so nothing is lost if a chain is not at its end yet.
    Every round's tables are written, nothing is collected.  Joins on a hot
    root have one row on the other side, so adaptive execution can split them.
    """
    e = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    labels = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        for _ in range(2):
            p = up.select(F.col("u").alias("w"), F.col("p").alias("q"))
            up = up.join(p, F.col("p") == F.col("w"), "left").select("u", F.coalesce("q", "p").alias("p"))
            up = materialize(up, "cc-up")
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
        left = up.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        e = e.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = materialize(e, "cc-links")
        if e.isEmpty():
            return materialize(labels, "cc-labels")
