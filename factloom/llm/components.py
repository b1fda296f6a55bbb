"""Connected components by randomised contraction.

Each round every node points at the neighbour (or itself) that comes first in a random order of the round, and
the edges are drawn anew between the nodes pointed at. In expectation a constant share of the nodes goes in each
round, also on chains and stars. Edges and pointers of a round are tables in the shared folder; the driver sees one
count per round. All groupings are by node with combinable aggregates, so the edges of a hub never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every end of a link: ``component`` is the smallest node that links reach.

    Links are undirected; nulls, self links and repeated links say nothing. Nodes without a link have no row.
    """
    edges = (
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges = stored(edges, "edges")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        order = F.xxhash64("b", F.lit(len(pointers)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = (
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(order).alias("least"), F.min_by("b", order).alias("best"))
            .select("node", F.expr(f"IF(xxhash64(node, {len(pointers)}) <= least, node, best)").alias("head"))
        )
        step = stored(step, "pointers")
        pointers.append(step)
        edges = (
            edges.join(step.select(F.col("node").alias("a"), F.col("head").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("head").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = stored(edges, "edges")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    heads = pointers[0]
    for step in pointers[1:]:
        after = step.select(F.col("node").alias("head"), F.col("head").alias("next"))
        heads = heads.join(after, "head", "left").select("node", F.coalesce("next", "head").alias("head"))
    heads = stored(heads, "heads") if len(pointers) > 1 else heads
    smallest = heads.groupBy("head").agg(F.min("node").alias("component"))
    return heads.join(smallest, "head").select("node", "component")
