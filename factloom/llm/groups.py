"""Groups of bounded size: dealing a large group over pairs of blocks, and walking sorted Arrow batches by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_block_pairs(members: DataFrame, node: str, size: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks that holds it, so that any two rows of a group meet in one of them.

    A group of ``size`` rows is dealt into ``ceil(size / block)`` blocks by a hash of ``node``; ``lo <= hi`` name the
    pair, ``block`` the row's own block. A small group is one pair (0, 0). Two rows of the same block meet in
    several pairs; ``lo = hi`` is the one that counts.
    """
    members = members.withColumn("_n", F.ceil(F.col(size) / block)).withColumn("block", F.pmod(F.xxhash64(node), "_n"))
    members = members.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return (
        members.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_n", "_other")
    )


def group_cuts(columns: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of equal values in sorted columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(columns[0])]))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of the groups, from batches sorted by ``columns``.

    Only the last group of a batch is held back until the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, table]) if rest is not None else table
        cuts = group_cuts([rest.column(c).to_numpy() for c in columns])
        if len(cuts) > 2:
            yield rest.slice(0, cuts[-2]), cuts[:-1]
            rest = rest.slice(cuts[-2])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])
