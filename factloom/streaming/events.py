"""Event streams: windows, sessions, duplicates, phase changes.

Every function has a batch twin with the same rows, so that a replayed day equals the live result. What a stream gives for
rows in order (phases, repeats) does not depend on how its rows were dealt over batches.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from factloom.plans.keyed import fill_forward, top_per_key
from factloom.streaming.ordered import in_order

#: A query that takes what there is and ends, unless the caller gives a trigger of its own.
ALL_NOW = {"availableNow": True}

# Event types a workflow journal accepts.
JOURNAL_EVENTS = [
    "session_start",
    "session_end",
    "decision",
    "phase_transition",
    "progress",
    "error",
    "context_switch",
    "gate_dispatched",
    "gate_verdict",
    "plan_approved",
    "workflow_resumed",
    "knowledge_captured",
    "pending_dispatch",
]


def _window_stats(grouped) -> DataFrame:
    return grouped.agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("duration_ms").alias("total_ms"),
    )


def stream_event_windows(
    stream: DataFrame, window: str, slide: str | None = None, watermark: str = "10 minutes"
) -> DataFrame:
    """Calls, errors and durations per tool in tumbling or sliding windows of ``ts``."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = _window_stats(stream.withWatermark("ts", watermark).groupBy(w, "name"))
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "name", "calls", "errors", "total_ms"
    )


def event_windows(events: DataFrame, window: str, slide: str | None = None, closed_by: str | None = None) -> DataFrame:
    """Batch twin; ``closed_by`` (a delay) keeps only windows that the watermark has closed."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = _window_stats(events.groupBy(w, "name")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "name", "calls", "errors", "total_ms"
    )
    if closed_by is None:
        return out
    mark = events.agg((F.max("ts") - F.expr(f"interval {closed_by}")).alias("_mark")).first()["_mark"]
    return out.filter(F.col("window_end") <= F.lit(mark))


def stream_sessions(stream: DataFrame, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """Activity sessions: events of one ``session_id`` less than ``gap`` apart."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap), "session_id")
        .agg(F.count("*").alias("events"))
        .select(
            "session_id", F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"), "events",
        )
    )


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Batch twin of ``stream_sessions``."""
    return (
        events.groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("events"))
        .select(
            "session_id", F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"), "events",
        )
    )


def _again(last: Row | None, row: Row) -> tuple:
    return (last is not None,)


def stream_repeats(
    stream: DataFrame, keys: list[str], within: datetime.timedelta, order: list[str] | None = None, delay: str = "60 seconds"
) -> DataFrame:
    """Every row with ``repeat``: whether a row of its key came at most ``within`` before it.

    Rows are judged by ``ts`` and then ``order``, once the watermark has passed them. A key that has been quiet for ``within`` is dropped from the state.
    """
    added = StructType([StructField("repeat", BooleanType())])
    return in_order(stream, keys, order or [], added, _again, delay, within)


def repeats(events: DataFrame, keys: list[str], within: datetime.timedelta, order: list[str] | None = None) -> DataFrame:
    """Batch twin of ``stream_repeats``; a busy key is scanned in chunks of time."""
    rows = events.dropna(subset=["ts", *keys])
    rows = fill_forward(
        rows, keys, ["ts", *(order or [])], {"_was": F.unix_micros("ts")}, chunk=F.date_trunc("DAY", F.col("ts")), inclusive=False
    )
    near = F.unix_micros("ts") - F.col("_was") <= int(within / datetime.timedelta(microseconds=1))
    return rows.withColumn("repeat", F.coalesce(near, F.lit(False))).drop("_was")


def stream_dedup(
    stream: DataFrame, keys: list[str], within: datetime.timedelta, order: list[str] | None = None, delay: str = "60 seconds"
) -> DataFrame:
    """The rows that are no repeat, see ``stream_repeats``."""
    return stream_repeats(stream, keys, within, order, delay).filter("NOT repeat").drop("repeat")


def _suppressed(rows: DataFrame, keys: list[str], every: str) -> DataFrame:
    n = rows.filter("repeat").groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("suppressed"))
    return n.select(F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), *keys, "suppressed")


def _most_suppressed(n: DataFrame, keys: list[str], k: int) -> DataFrame:
    total = n.groupBy("interval_start").agg(F.sum("suppressed").alias("total"))
    order = [F.col("suppressed").desc(), *[F.col(c) for c in keys]]
    return top_per_key(n, ["interval_start"], order, k).join(total, "interval_start").drop("interval_end")


def repeat_summary(
    events: DataFrame, keys: list[str], within: datetime.timedelta, order: list[str] | None = None, every: str = "60 seconds", k: int = 3,
    closed_by: str | None = None,
) -> DataFrame:
    """Batch twin of ``write_repeat_summary``; ``closed_by`` (a delay) keeps only intervals that the watermark has closed."""
    n = _suppressed(repeats(events, keys, within, order), keys, every)
    if closed_by is not None:
        mark = events.agg((F.date_trunc("MILLISECOND", F.max("ts")) - F.expr(f"interval {closed_by}")).alias("_mark")).first()["_mark"]
        n = n.filter(F.col("interval_end") <= F.lit(mark))
    return _most_suppressed(n, keys, k)


def write_repeat_summary(
    stream: DataFrame, dir_: str, checkpoint: str, keys: list[str], within: datetime.timedelta, order: list[str] | None = None,
    every: str = "60 seconds", k: int = 3, delay: str = "60 seconds", trigger: dict | None = None,
):
    """Per interval: repeats suppressed in all, and the ``k`` keys with most of them, to ``dir/batch=N``.

    Two chained stateful steps: one judges the rows of a key, the next counts what was suppressed in windows. The windows of an
    interval close together, so the batch that closes them has the whole interval, and ranks its keys.
    """
    n = _suppressed(stream_repeats(stream.select("ts", *keys, *(order or [])), keys, within, order, delay), keys, every)

    def step(batch: DataFrame, batch_id: int) -> None:
        _most_suppressed(batch, keys, k).write.mode("overwrite").parquet(f"{dir_}/batch={batch_id}")

    return n.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_NOW)).foreachBatch(step).start()


def dedup(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the earliest: what the stream gives for a single batch."""
    return events.groupBy(*keys).agg(F.min("ts").alias("ts"), (F.count("*") - 1).alias("suppressed"))


def dedup_summary(events: DataFrame, keys: list[str], every: str = "60 seconds", k: int = 3) -> DataFrame:
    """Per interval: repeats suppressed in all, and the ``k`` keys with most of them."""
    n = (
        events.groupBy(F.window("ts", every).alias("w"), *keys).agg((F.count("*") - 1).alias("suppressed"))
        .filter("suppressed > 0").withColumn("interval_start", F.col("w.start")).drop("w")
    )
    total = n.groupBy("interval_start").agg(F.sum("suppressed").alias("total"))
    best = top_per_key(n, ["interval_start"], [F.col("suppressed").desc(), *[F.col(c) for c in keys]], k)
    return best.join(total, "interval_start")


def valid_journal_events(journal: DataFrame) -> DataFrame:
    return journal.filter(F.col("event_type").isin(JOURNAL_EVENTS))


def phase_transitions(
    journal: DataFrame, before: DataFrame | None = None, chunk: Column | None = None, forget: datetime.timedelta | None = None
) -> DataFrame:
    """Rows ``(workflow, ts, seq, from_phase, to_phase)`` where the phase of a workflow changes.

    ``journal(workflow, ts, seq, phase)``; ``before(workflow, phase)`` is what was known earlier. A workflow that was quiet for more than ``forget``
    starts anew. Long workflows are scanned in chunks of time.
    """
    chunk = chunk if chunk is not None else F.date_trunc("DAY", F.col("ts"))
    rows = fill_forward(
        journal.select("workflow", "ts", "seq", "phase"), ["workflow"], ["ts", "seq"],
        {"_from": F.struct(F.col("phase").alias("phase"), F.unix_micros("ts").alias("at"))}, chunk=chunk, inclusive=False,
    )
    quiet = F.lit(False) if forget is None else F.unix_micros("ts") - F.col("_from.at") > int(forget / datetime.timedelta(microseconds=1))
    rows = rows.withColumn("from_phase", F.when(~quiet, F.col("_from.phase")))
    if before is not None:
        rows = rows.join(before.select("workflow", F.col("phase").alias("_was")), "workflow", "left")
        rows = rows.withColumn("from_phase", F.when(F.col("_from").isNull(), F.col("_was")).otherwise(F.col("from_phase")))
    return rows.filter("from_phase IS NOT NULL AND from_phase <> phase").select(
        "workflow", "ts", "seq", "from_phase", F.col("phase").alias("to_phase")
    )


def _changed(last: Row | None, row: Row) -> tuple | None:
    known = last is not None and last["phase"] is not None and row["phase"] is not None
    return (last["phase"],) if known and last["phase"] != row["phase"] else None


def stream_phase_transitions(stream: DataFrame, delay: str = "10 minutes", forget: datetime.timedelta | None = None) -> DataFrame:
    """The rows of ``phase_transitions`` over a stream, also if rows come out of order.

    A row is judged once the watermark, ``delay`` behind the newest row, has passed it; rows that come later are dropped. State holds the rows
    that wait and one row for each workflow; ``forget`` also drops the latter for a workflow that has been quiet that long.
    """
    added = StructType([StructField("from_phase", StringType())])
    rows = in_order(stream.select("workflow", "ts", "seq", "phase"), ["workflow"], ["seq"], added, _changed, delay, forget)
    return rows.select("workflow", "ts", "seq", "from_phase", F.col("phase").alias("to_phase"))
