"""Connected components by hooking and contraction, all of it joins on narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.store import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each id that occurs in ``links`` (a, b); component is the smallest id reachable.

    Each round every node hooks onto its smallest neighbour, pointers are
    doubled to the roots, and the graph is contracted to roots.  Each
    component that is left at least halves, so rounds are logarithmic, on
    chains too.  Repeated links, loops and an empty table are allowed;
    null ends are ignored.
    """
    edges = scratch.keep(links.select("a", "b").where("a <> b").distinct())
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = scratch.keep(parent.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(parent)
            parent = jumped
            if not moved:
                break
        parent = parent.select("id", "root")
        if total is None:
            total = parent
        else:
            up = parent.select(F.col("id").alias("component"), F.col("root").alias("above"))
            total = total.withColumnRenamed("root", "component").join(up, "component", "left").select("id", F.coalesce("above", "component").alias("root"))
        left, right = (parent.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        smaller = scratch.keep(edges.join(left, "a").join(right, "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        scratch.drop(edges)
        edges = smaller
        if not edges.limit(1).count():
            return scratch.keep(total.withColumnRenamed("root", "component"))
