"""Connected components of an edge table, without holding it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; one label a component.

    Node keys must be evenly ordered, such as digests. Each round every node
    hooks onto its smallest neighbour if that is smaller, and the edges are
    redrawn between what the nodes hooked onto, without loops and repeats.
    With keys in random order a round removes a constant share of the nodes,
    so the rounds grow as the logarithm of the longest chain. Neighbourhoods
    are only ever aggregated to a minimum and a count, and the joins spread
    nodes of high degree; nothing is collected. A hook may lead to a node that
    itself hooked in that round; the redrawn edge between the two keeps them
    together until a later round. Loops make their node a component; a table
    without edges gives no rows; null keys are not allowed.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = scratch.keep(both(edges.filter("a <> b").select("a", "b")).distinct(), "edges")
    labels = scratch.keep(both(edges).select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while not live.isEmpty():
        hooks = scratch.keep(live.groupBy("a").agg(F.count("*").alias("degree"), F.min("b").alias("least")).select(
            "a", "degree", F.least("a", "least").alias("to")), "hooks")
        moved = attach(live, hooks, ["a"], "degree", F.col("b")).select(F.col("to").alias("x"), F.col("b"))
        moved = attach(moved.select("x", F.col("b").alias("a")), hooks, ["a"], "degree", F.col("x")).select(
            F.col("x").alias("a"), F.col("to").alias("b"))
        before = live
        live = scratch.keep(moved.filter("a <> b").distinct(), "edges")
        # A label that hooked moves on; many nodes may carry one label.
        sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
        facts = scratch.keep(sizes.join(hooks.select(F.col("a").alias("label"), "to"), "label"), "moves")
        old = labels
        labels = scratch.keep(attach(labels, facts, ["label"], "size", F.col("node"), "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        scratch.drop(before, hooks, facts, old)
    return labels
