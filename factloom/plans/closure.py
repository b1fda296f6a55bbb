"""Reachability over an edge table, one frontier round at a time.

Pairs of starts and nodes are found by walks inside of tasks, see ``plans.walks``. Where which start reaches a node is not asked, rounds
join the newly reached nodes with the edges and drop those already known; a round never rewrites older results, and the driver sees one
flag per round. Nodes named by text are numbered first.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from factloom.plans.lineage import cut_lineage, ensure_checkpoint_dir
from factloom.plans.walks import walk_all


def reach(
    edges: DataFrame,
    seeds: DataFrame | None = None,
    direction: str = "out",
    max_rounds: int | None = None,
) -> DataFrame:
    """``(start, node, hops)``: the nodes reached from each start over ``edges(src, dst)``.

    A start is never in its own result, also not on a cycle. ``seeds`` holds one column of start
    nodes; without it every edge source is a start, which is quadratic on dense graphs. ``hops`` is
    the length of the shortest path.
    """
    if direction not in ("out", "in"):
        raise ValueError("direction is 'out' or 'in'")
    frm, to = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.select(F.col(frm).alias("node"), F.col(to).alias("next")).filter(
        "node IS NOT NULL AND next IS NOT NULL AND node <> next"
    )
    if seeds is None:
        starts = step.select(F.col("node").alias("start")).distinct()
    else:
        starts = seeds.select(F.col(seeds.columns[0]).alias("start")).distinct()
    kinds = {df.schema[c].dataType for df, c in ((step, "node"), (step, "next"), (starts, "start"))}
    if len(kinds) == 1 and isinstance(next(iter(kinds)), StringType | ByteType | ShortType | IntegerType | LongType):
        return walk_all(cut_lineage(step.distinct()), starts, max_rounds)
    return _reach_by_rounds(cut_lineage(step.distinct()), starts, max_rounds)


def _reach_by_rounds(step: DataFrame, starts: DataFrame, max_rounds: int | None) -> DataFrame:
    """``reach`` of starts and nodes that the types of the two tables do not make alike, with Spark's rules for comparing them."""
    frontier = starts.withColumn("node", F.col("start"))
    levels: list[DataFrame] = []
    hops = 0
    while max_rounds is None or hops < max_rounds:
        hops += 1
        found = (
            frontier.join(step, "node")
            .select("start", F.col("next").alias("node"))
            .filter("start <> node")
            .distinct()
        )
        # a node reached earlier is known; shortest paths make older rounds the only place to look
        if levels:
            known = reduce(DataFrame.unionByName, levels).select("start", "node")
            found = found.join(known, ["start", "node"], "left_anti")
        found = cut_lineage(found.withColumn("hops", F.lit(hops)))
        if found.isEmpty():
            break
        levels.append(found)
        if len(levels) > 12:  # keep the number of tables bounded
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
        frontier = found.select("start", "node")
    if not levels:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).limit(0)
    return reduce(DataFrame.unionByName, levels)


def reach_any(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """``(node)``: the seeds and the nodes reached from any of them, each once; which seed reaches a node is not kept."""
    if direction not in ("out", "in"):
        raise ValueError("direction is 'out' or 'in'")
    frm, to = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.select(F.col(frm).alias("node"), F.col(to).alias("next")).filter("node IS NOT NULL AND next IS NOT NULL")
    step = cut_lineage(step.distinct())
    levels = [cut_lineage(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct())]
    frontier = levels[0]
    while not frontier.isEmpty():
        found = frontier.join(step, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut_lineage(found.join(reduce(DataFrame.unionByName, levels), "node", "left_anti"))
        levels.append(frontier)
        if len(levels) > 12:  # keep the number of tables bounded
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def reach_others(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """``(node)``: the nodes that ``reach`` finds from any of the seeds, each once; a seed is one of them if another seed reaches it.

    A node remembers two seeds that reach it, at most: that is enough to tell whether one of them is another node, also further on,
    and keeps the rounds as small as the nodes, where the pairs of all seeds and nodes may be far more.
    """
    if direction not in ("out", "in"):
        raise ValueError("direction is 'out' or 'in'")
    frm, to = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.select(F.col(frm).alias("node"), F.col(to).alias("next")).filter(
        "node IS NOT NULL AND next IS NOT NULL AND node <> next"
    )
    step = cut_lineage(step.distinct())
    names = step.select("node").unionByName(step.select(F.col("next").alias("node"))).distinct()
    ids = cut_lineage(names.withColumn("_id", F.monotonically_increasing_id()))
    of = lambda c: ids.select(F.col("node").alias(c), F.col("_id").alias(f"_{c}"))
    step = cut_lineage(step.join(of("node"), "node").join(of("next"), "next").select(F.col("_node").alias("node"), F.col("_next").alias("next")))
    starts = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().join(of("node"), "node")
    held = cut_lineage(starts.select(F.col("_node").alias("node"), F.col("_node").alias("start")))
    levels, frontier = [held], held
    while not frontier.isEmpty():
        found = frontier.join(step, "node").select(F.col("next").alias("node"), "start", F.lit(None).cast("long").alias("had"))
        had = reduce(DataFrame.unionByName, levels).select("node", F.lit(None).cast("long").alias("start"), F.col("start").alias("had"))
        ends = [f(c).alias(f"{c}_{n}") for c in ("start", "had") for n, f in (("lo", F.min), ("hi", F.max))]
        seen = found.unionByName(had).groupBy("node").agg(*ends).filter("start_lo IS NOT NULL AND (had_lo IS NULL OR had_lo = had_hi)")
        # two seeds of a node that had none, one other than its own of a node that had one
        new = F.when(F.col("had_lo").isNull(), F.array_distinct(F.array("start_lo", "start_hi"))).otherwise(
            F.slice(F.array_except(F.array("start_lo", "start_hi"), F.array("had_lo")), 1, 1)
        )
        frontier = cut_lineage(seen.select("node", F.explode(new).alias("start")))
        levels.append(frontier)
        if len(levels) > 12:  # keep the number of tables bounded
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
    met = reduce(DataFrame.unionByName, levels).filter("node <> start").select(F.col("node").alias("_node")).distinct()
    return met.join(of("node"), "_node").select("node")


def _levels(step: DataFrame, folder: str) -> int:
    """Writes the edges as ``inner=0`` of ``at``, the length of the longest path to their ``node``; the number of levels, 0 on a cycle."""
    spark = step.sparkSession
    live, at, size = step, 0, None
    while size is None or size:
        inner = live.select(F.col("next").alias("node")).distinct().withColumn("inner", F.lit(1))
        marked = live.join(inner, "node", "left").select("node", "next", F.coalesce("inner", F.lit(0)).alias("inner"))
        marked.write.partitionBy("inner").parquet(f"{folder}/at={at}")
        live = spark.read.schema("node long, next long, inner int").parquet(f"{folder}/at={at}").filter("inner = 1").select("node", "next")
        left = live.count()
        if left == size or (size is None and left and left == step.count()):
            return 0
        size, at = left, at + 1
    return at


def reach_least(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """``(start, node, least)``: the nodes that the ``seeds(start, node, rank)`` reach over ``edges(node, next)``, themselves included,
    with the least rank of the seeds of that start that reach them. All columns are long; None if the edges have a cycle.

    Nodes are taken in topological order, so that a pair of start and node is complete when it is its turn: it is
    stored and passed on once, and no round looks at the pairs of earlier ones. A loop of a node to itself says nothing.
    """
    spark = edges.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/least-{uuid.uuid4().hex}"
    step = edges.filter("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct()
    step.write.parquet(f"{folder}/step")
    levels = _levels(spark.read.schema("node long, next long").parquet(f"{folder}/step"), f"{folder}/levels")
    if not levels:
        return None
    step = spark.read.schema("node long, next long, at int, inner int").parquet(f"{folder}/levels").filter("inner = 0")
    turn = step.select("node", F.col("at").alias("to")).distinct()

    def passed(rows: DataFrame) -> None:  # a node without edges comes last
        rows.withColumn("to", F.coalesce("to", F.lit(levels))).write.mode("append").partitionBy("to").parquet(f"{folder}/passed")

    passed(seeds.select("start", "node", "rank").join(turn, "node", "left"))
    step.select("node", "next", "at").join(turn.withColumnRenamed("node", "next"), "next", "left").write.partitionBy("at").parquet(f"{folder}/edges")
    step = spark.read.schema("next long, node long, to int, at int").parquet(f"{folder}/edges")
    for at in range(levels + 1):
        due = spark.read.schema("node long, start long, rank long, to int").parquet(f"{folder}/passed").filter(F.col("to") == at)
        due.groupBy("start", "node").agg(F.min("rank").alias("least")).write.parquet(f"{folder}/pairs/at={at}")
        if at < levels:
            done = spark.read.schema("start long, node long, least long").parquet(f"{folder}/pairs/at={at}")
            out = done.join(step.filter(F.col("at") == at), "node")
            passed(out.select("start", F.col("next").alias("node"), F.col("least").alias("rank"), "to"))
    return spark.read.schema("start long, node long, least long, at int").parquet(f"{folder}/pairs").select("start", "node", "least")
