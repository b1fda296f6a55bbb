"""Exact top-k inner products by Fagin's threshold algorithm.

Components are turned into integers ``floor(scale * x)``. Candidates are dealt into shards of bounded size by a hash; in a shard
every dimension has a list of its rows sorted by that component. A query walks the lists of its non-zero components
side by side, from the large end where its own component is positive and from the small end where it is negative.
Rows met for the first time are scored in full; after each step the frontier of the lists bounds the score of every row not met yet,
and the walk ends once that bound is below the k-th best score (below, not equal: ties go to the smaller id).

The first shard runs first. The k-th score that a query has there is a floor for the other shards, where the walk ends
as soon as the bound is below the floor. Queries meet shards in blocks, and the k best of all shards are ranked at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.embedding_dups import matrix
from factloom.llm.storage import stored

SHARD_ROWS, QUERY_ROWS, FIRST_STEP = 8192, 1024, 16
_SCHEMA = "query_id long, vec_id long, score long"


class SortedLists:
    """The rows of a shard with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.rows, self.order, axis=0)

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most ``k`` rows: all of the overall k best that this shard holds are among them."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == query_id  # a query's own row is no candidate
        best_ids, best = self.ids[:0], np.zeros(0, dtype=np.int64)
        at, step = 0, FIRST_STEP
        while at < n:
            to = min(n, at + step)
            if len(up) + len(down):
                hit = np.zeros(n, dtype=bool)
                hit[self.order[n - to : n - at, up]] = True
                hit[self.order[at:to, down]] = True
                new = np.flatnonzero(hit & ~met)
                bound = int(self.values[n - to, up] @ query[up] + self.values[to - 1, down] @ query[down])
            else:  # every score is 0
                new, bound, to = np.flatnonzero(~met), 0, n
            met[new] = True
            best_ids = np.concatenate((best_ids, self.ids[new]))
            best = np.concatenate((best, (self.rows[new] @ query).astype(np.int64)))
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            if (len(best) == k and best[-1] > bound) or (floor is not None and bound < floor):
                break
            at, step = to, 2 * step
        return best_ids, best


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            x, q = matrix(rows.column("v")), matrix(queries.column("v"))
            width = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
            if width * np.abs(x).max(initial=1) * np.abs(q).max(initial=1) >= 2**53:  # doubles wouldn't be exact
                x, q = x.astype(np.int64), q.astype(np.int64)
            lists = SortedLists(rows.column("vec_id").to_numpy(), x)
            for qid, query, floor in zip(
                queries.column("vec_id").to_pylist(), q, queries.column("floor").to_pylist(), strict=True
            ):
                ids, scores = lists.best(qid, query, k, floor)
                found.append((np.full(len(ids), qid, dtype=np.int64), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _each(first: int, stop: int) -> F.Column:
    """A row for each whole number from ``first`` on, before ``stop``."""
    return F.explode(F.sequence(F.lit(first).cast("long"), F.lit(stop - 1).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors`` with the highest inner product for each query.

    Both frames hold ``vec_id, embedding``. Rows with the query's own id are no candidates; ties go to the smaller id, and
    a query without candidates has no row. Null ids, null vectors and vectors with null or non-finite components take
    no part; a shorter vector ends in zeros. Integers must stay within 2**53. Other columns are not read.
    """
    clean = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))

    def integers(df: DataFrame) -> DataFrame:
        return df.filter("vec_id IS NOT NULL").filter(F.coalesce(clean, F.lit(False))).select(F.col("vec_id").cast("long"), whole.alias("v"))

    rows, asked = integers(vectors), stored(integers(queries).dropDuplicates(["vec_id"]), "queries")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    rows = rows.withColumn("block", _each(0, blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def search(rows: DataFrame, asked: DataFrame) -> DataFrame:
        keys = ["shard", "block"]
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k), _SCHEMA)

    one = asked.withColumn("shard", F.lit(0).cast("long")).withColumn("floor", F.lit(None).cast("long"))
    found = stored(search(rows.filter("shard = 0"), one), "first_shard")
    if shards > 1:
        floor = found.groupBy(F.col("query_id").alias("vec_id")).agg(
            F.when(F.count("*") == k, F.min("score")).alias("floor")
        )
        rest = asked.join(floor, "vec_id", "left").withColumn("shard", _each(1, shards))
        found = found.unionByName(search(rows.filter("shard > 0"), rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
