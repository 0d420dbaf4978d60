"""Connected components over an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep


def _roots(parent: DataFrame) -> DataFrame:
    """Follow (v, p) to the end of every chain by pointer jumping."""
    while True:
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
        jumped = keep(parent, "jump")
        parent = jumped.select("v", "p")
        if jumped.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges(a, b)``: the smallest vertex of its component.

    Each round every vertex points to its smallest neighbour if that is smaller, chains are followed to their
    end, and the edges between different roots form the next, smaller graph.  Aggregations combine map-side, so
    a vertex with very many neighbours is no hot group.
    """
    label = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        parent = keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "hook")
        if label is None and parent.isEmpty():
            return parent.select("v", F.col("p").alias("root"))
        roots = _roots(parent)
        known = roots.select(F.col("v").alias("root"), F.col("p").alias("next"))
        label = keep(roots.select("v", F.col("p").alias("root")) if label is None else
                     label.join(known, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "labels")
        ends = edges.join(roots.select(F.col("v").alias("a"), F.col("p").alias("ra")), "a").join(
            roots.select(F.col("v").alias("b"), F.col("p").alias("rb")), "b")
        edges = keep(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return label
