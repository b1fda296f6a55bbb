"""Packing into length buckets that waste the least padding.

The global histogram of lengths (one row for each different length) comes to the driver, where dynamic programming chooses the
boundaries of ``buckets`` buckets with the least total padding. Texts of a bucket are padded to its boundary and grouped into
batches of at most ``budget`` tokens, padding included; a text longer than the budget is a batch by itself.

Places in a bucket are given out by counting: rows are dealt into small parts by a hash, parts get the running sum of the
counts before them, and a row's place is its part's start and its rank in the part. No bucket is ever one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding, for sorted distinct lengths.

    With w(i, j) the padding of lengths i .. j - 1 raised to the last of them, best[k][j] = min over i of best[k - 1][i] + w(i, j).
    The best i never falls as j grows, so each half of a range of j needs only its part of the i.
    """
    m = len(lengths)
    if not m:
        return []
    number = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    total = np.concatenate(([0], np.cumsum(counts * lengths.astype(np.float64))))
    best = np.concatenate(([0.0], np.full(m, np.inf)))
    choices = []
    for _ in range(min(buckets, m)):
        new, choice = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, m, 0, m - 1)]
        while todo:
            first, last, low, high = todo.pop()
            if first > last:
                continue
            j = (first + last) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (number[j] - number[i]) - (total[j] - total[i])
            k = int(np.argmin(cost))
            new[j], choice[j] = cost[k], i[k]
            todo += [(first, j - 1, low, int(i[k])), (j + 1, last, int(i[k]), high)]
        choices.append(choice)
        best = new
    out, j = [], m
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(choice[j])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding)`` for every row of ``docs(doc_id, text)``.

    ``n_tokens`` counts words; a null or blank text has none. ``batch`` counts from 0 in each bucket and ``slot`` from 0 in each batch.
    Rows that repeat an id, or have none, get a place each. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    lengths, counts = (np.array([r[i] for r in histogram], dtype=np.int64) for i in (0, 1))
    bounds = boundaries(lengths, counts, buckets) or [0]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    parts = max(1, -(-int(counts.sum()) // PART_ROWS))
    rows = rows.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(parts)))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id"))
    placed = rows.withColumn("rank", rank).join(starts.select("bucket", "part", "start"), ["bucket", "part"])
    width = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(width, F.lit(1))))
    place = F.col("start") + F.col("rank") - 1
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        width.alias("bucket_tokens"),
        F.floor(place / room).alias("batch"),
        F.pmod(place, room).alias("slot"),
        (width - F.col("n_tokens")).alias("padding"),
    )
