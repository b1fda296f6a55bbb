"""Keyed state over streams whose rows come out of order.

Rows of a key wait in state until the watermark has passed them and are then handed on in event-time order, so a stream
gives the rows that a batch query over the whole history gives, however the rows were dealt over batches. State is
bounded by the rows of one watermark delay and one remembered row for each key that is not forgotten.

State calls of Python workers, and rows that cross them one by one, cost far more than the work on a row. So keys share
``BUCKETS`` buckets, whose rows are kept as packed runs of ``RUN`` rows: a batch takes a few calls a bucket, however many keys there are. A timer of event time wakes a bucket when its
earliest waiting row is due, or when what is remembered of a key that has been quiet for long can be dropped.

The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, TimestampType

#: Gets the remembered row of a key (or None) and the next due row; gives the columns to add, or None for no output.
Step = Callable[[Row | None, Row], tuple | None]
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
#: Groups of keys that share their state; a running checkpoint depends on it.
BUCKETS = 512
RUN = 10_000
_RUNS = StructType([StructField("run", BinaryType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(at: int) -> int:
    """The first whole millisecond at or after ``at`` microseconds, less one: a timer fires when the watermark is beyond it."""
    return -(-at // 1000) - 1


def _packed(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[i : i + RUN], pickle.HIGHEST_PROTOCOL),) for i in range(0, len(rows), RUN)]


def _unpacked(state) -> Iterator[tuple]:
    for (run,) in state.get():
        yield from pickle.loads(run)


class InOrder(StatefulProcessor):
    def __init__(self, columns: StructType, result: StructType, keys: list[str], order: list[str], step: Step, forget: int | None):
        self.columns, self.result, self.keys, self.order, self.step, self.forget = columns, result, keys, order, step, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _RUNS)
        self.last = handle.getListState("last", _RUNS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = self.columns.names
        new = [tuple(r[c] for c in names) for r in rows]
        self.waiting.appendList(_packed(new))
        first, timers = _millis(min(r[0] for r in new)), self._timers()
        if not any(t <= first for t in timers):  # else the bucket wakes early enough
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        n, names = len(self.keys), self.columns.names
        made, result = Row(*names), Row(*self.result.names)
        places = [names.index(c) for c in self.order]
        due, rest = [], []
        for r in _unpacked(self.waiting):
            (due if r[0] <= mark else rest).append(r)
        last = {r[1 : n + 1]: made(*r) for r in _unpacked(self.last)}
        out = []
        # null values come first, as in Spark's own order
        for values in sorted(due, key=lambda r: (r[0], *((r[c] is not None, r[c]) for c in places))):
            row, key = made(*values), values[1 : n + 1]
            before = last.get(key)
            if before is not None and self.forget is not None and row[0] - before[0] > self.forget:
                before = None
            added = self.step(before, row)
            if added is not None:
                out.append(result(*key, _EPOCH + datetime.timedelta(microseconds=row[0]), *row[n + 1 :], *added))
            last[key] = row
        # no row that is still to come is near enough to the others
        kept = [tuple(r) for r in last.values() if self.forget is None or mark - r[0] < self.forget]
        if due:
            self._put(self.waiting, rest)
        if due or len(kept) < len(last):
            self._put(self.last, kept)
        wake = [_millis(min(r[0] for r in rest))] if rest else []
        if kept and self.forget is not None:
            wake.append(_millis(min(r[0] for r in kept) + self.forget) + 1)
        if wake:
            self.handle.registerTimer(min(wake))
        return iter(out)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(_packed(rows))
        else:
            state.clear()

    def _timers(self) -> list[int]:
        return [int(t[0]) if isinstance(t, tuple | list) else int(t) for t in self.handle.listTimers()]

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame, keys: list[str], order: list[str], added: StructType, step: Step, delay: str, forget: datetime.timedelta | None = None
) -> DataFrame:
    """``stream`` with the columns ``added``: ``step`` sees every row of a key in the order of ``ts`` and ``order``.

    A row comes out once the watermark, ``delay`` behind the newest row, has passed it; rows that come later than that are dropped. The
    step gets the row before, unless that is more than ``forget`` older: then its key starts anew. Rows without a ``ts`` or a key are left out.
    """
    rest = [c for c in stream.columns if c not in keys and c != "ts"]
    rows = stream.dropna(subset=["ts", *keys]).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("ts", F.unix_micros("ts").alias("_at"), *keys, *rest, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    columns = StructType([StructField("_at", LongType()), *[rows.schema[c] for c in [*keys, *rest]]])
    result = StructType([*[rows.schema[k] for k in keys], StructField("ts", TimestampType()), *[rows.schema[c] for c in rest], *added.fields])
    micros = None if forget is None else int(forget / datetime.timedelta(microseconds=1))
    return rows.groupBy("_bucket").transformWithState(
        statefulProcessor=InOrder(columns, result, keys, order, step, micros), outputStructType=result, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts",
    )
