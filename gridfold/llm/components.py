"""Connected components of a graph given by links, by contraction; no group of a component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose links go to smaller nodes: pointers are doubled until they stay."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        doubled = checkpoint(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
        parents = doubled.select("node", "root")
        if not doubled.filter("moved").limit(1).count():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node that has a link to another: root is the smallest node that it reaches.

    `links` has a and b (long, not null); direction, order and repeats don't matter, and links of a
    node to itself give no row. Each round hooks every node to its smallest neighbour, doubles
    pointers, and contracts the links to roots; links within a root go, so rounds are few.
    """
    left = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    known: DataFrame | None = None
    while left.limit(1).count():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("other")).union(left.select("a", "b"))
        hooked = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        roots = _jumped(checkpoint(hooked))
        if known is None:
            known = roots
        else:
            higher = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = checkpoint(known.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = left.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        left = checkpoint(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return known if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
