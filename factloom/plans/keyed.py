"""Per-key choices and ordered scans that stay cheap when one key holds much of the data.

* ``pick_first`` / ``pick_last`` are aggregates, so Spark combines them before the shuffle; a window
  with ``row_number() = 1`` would move every row of a hot key into one task first.
* ``top_per_key`` relies on the rank limit that Spark pushes below the shuffle (window group limit).
* ``fill_forward`` and ``running_total`` cut a long key into chunks: each chunk is scanned by its own
  task, one summary row per chunk is scanned per key, and the summary is joined back. ``fill_forward``
  looks first whether any key has rows outside its first chunk, and scans each key whole if none has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a single task scans in order.
CHUNK = 1 << 16


def _order(cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(agg(F.struct(*rest), _order(order)).alias("_picked"))
    return picked.select(*keys, *[F.col("_picked")[c].alias(c) for c in rest]).select(*df.columns)


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the smallest by ``order``."""
    return _pick(df, keys, order, F.min_by)


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    return _pick(df, keys, order, F.max_by)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every key, with their 1-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    chunk: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add, for every row, the last non-null value of each expression at or before it.

    ``order`` must be a total order within ``keys``; its first column is numeric unless ``chunk`` (a
    column that never decreases along the order) is given. With ``inclusive=False`` the row itself
    does not count. Keys are not null.
    """
    keys, order = list(keys), list(order)
    end = Window.currentRow if inclusive else -1
    raw = {f"_v_{n}": e for n, e in values.items()}
    if chunk is None:
        # rows outside the first chunk; file statistics skip the others, so that short keys are told without a scan
        far = df.filter((F.col(order[0]) >= CHUNK) | (F.col(order[0]) < 0)).select(*keys)
        if far.isEmpty():
            whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
            return df.withColumns(raw).withColumns({f"_l_{n}": F.last(f"_v_{n}", True).over(whole) for n in values}).select(
                *df.columns, *[F.col(f"_l_{n}").alias(n) for n in values]
            )
        chunk = F.floor(F.col(order[0]) / F.lit(CHUNK))
        long = df.join(far.distinct(), keys, "left_semi")
    else:
        long = df
    base = df.withColumn("_chunk", chunk).withColumns(raw)
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = base.withColumns({f"_l_{n}": F.last(f"_v_{n}", True).over(inside) for n in values})
    tails = long.withColumn("_chunk", chunk).withColumns(raw).groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), _order(order))).alias(f"_t_{n}")
            for n in values
        ]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[F.last(f"_t_{n}", True).over(before).alias(f"_c_{n}") for n in values],
    )
    carried = carried.filter(" OR ".join(f"_c_{n} IS NOT NULL" for n in values))
    # plain equality, so that the join reuses the shuffle of the window
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = local.join(carried, [*same, F.col("_chunk") == F.col("_k_chunk")], "left")
    return joined.select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values]
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    chunk: Column | None = None,
) -> DataFrame:
    """Add running sums (the row included) of each expression along ``order`` within non-null ``keys``."""
    keys, order = list(keys), list(order)
    chunk = chunk if chunk is not None else F.floor(F.col(order[0]) / F.lit(CHUNK))
    base = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": e for n, e in values.items()})
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    totals = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values],
    )
    # plain equality, so that the join reuses the shuffle of the window
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = local.join(carried, [*same, F.col("_chunk") == F.col("_k_chunk")], "left")
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n)
            for n in values
        ],
    )
