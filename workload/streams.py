"""Streaming queries over the event table, each drained with ``availableNow`` into files and read back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from factloom.plans.lineage import cut_lineage
from factloom.streaming import changes, events, ordered
from workload.derived import cte, scratch, table
from workload.questions import _ALL, ON_LINES
from workload.registry import register

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf):
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.concat(F.lit("s"), "user_id").alias("session_id"),
        F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 90, "timeout").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"), "props",
    )


def _drain(spark, stream, name):
    out = scratch(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


_TIME = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
_WIN = """, mk AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM ev), w AS (SELECT {start} AS window_start, name, status, duration_ms FROM ev{more})
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, name, count(*) AS calls, count(*) FILTER (status = 'error') AS errors FROM w, mk WHERE window_start + INTERVAL {size} <= mark GROUP BY ALL"""


@register("stream_event_windows", cte("ev", _WIN.format(start="time_bucket(INTERVAL 1 HOUR, ts)", more="", size="1 HOUR")))
def _(spark, sf):
    out = _drain(spark, events.stream_event_windows(_stream(spark, sf), "1 hour"), "windows")
    return out.select(_TIME("window_start").alias("window_start"), "name", "calls", "errors")


@register(
    "stream_event_windows_sliding",
    cte("ev", _WIN.format(start="time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE", more=", range(0, 4) AS r(i)", size="2 HOUR")),
)
def _(spark, sf):
    out = _drain(spark, events.stream_event_windows(_stream(spark, sf), "2 hours", "30 minutes"), "sliding")
    return out.select(_TIME("window_start").alias("window_start"), "name", "calls", "errors")


@register("event_windows", cte("ev", _WIN.format(start="time_bucket(INTERVAL 1 HOUR, ts)", more="", size="1 HOUR")))
def _(spark, sf):
    out = events.event_windows(table(spark, sf, "ev"), "1 hour", closed_by="10 minutes")
    return out.select(_TIME("window_start").alias("window_start"), "name", "calls", "errors")


_SESS = """, g AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
, n AS (SELECT session_id, ts, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
, s AS (SELECT session_id, min(ts) AS a, max(ts) + INTERVAL 5 HOUR AS b, count(*) AS events FROM n GROUP BY session_id, no)
SELECT session_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, events FROM s"""


@register("stream_sessions", cte("ev", _SESS + " WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev)"))
def _(spark, sf):
    out = _drain(spark, events.stream_sessions(_stream(spark, sf), "5 hours"), "sessions")
    return out.select("session_id", _TIME("session_start").alias("session_start"), "events")


@register("sessions", cte("ev", _SESS))
def _(spark, sf):
    out = events.sessions(table(spark, sf, "ev"), "5 hours")
    return out.select("session_id", _TIME("session_start").alias("session_start"), "events")


BATCHES, LATE = 6, 20


def _journal(df):
    return df.select(F.col("session_id").alias("workflow"), "ts", F.col("event_id").alias("seq"), F.col("name").alias("phase"))


def _late_stream(spark, sf):
    """The events as ``BATCHES`` files by time, of which every batch takes one; one event in ``LATE`` comes a batch later than its time."""
    spark = spark.newSession()  # with state in RocksDB, whatever the caller's session has
    for name, value in (("sql.streaming.stateStore.providerClass", ordered.STORE), ("sql.shuffle.partitions", str(max(4, spark.sparkContext.defaultParallelism))), ("sql.session.timeZone", "UTC")):
        spark.conf.set(f"spark.{name}", value)
    ev = table(spark, sf, "ev")
    lo, hi = ev.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - lo) * BATCHES / (hi - lo + 1)).cast("int")
    part = F.when((F.col("event_id") % LATE == 0) & (part < BATCHES - 1), part + 1).otherwise(part)
    out = scratch(spark, "late")
    for i in range(BATCHES):
        ev.filter(part == i).select("ts", "event_id", "session_id", "name", "status").coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema("ts timestamp, event_id bigint, session_id string, name string, status string").option("maxFilesPerTrigger", 1).parquet(out)


_KEYS, _WITHIN, _DELAY = ["session_id", "name"], datetime.timedelta(days=2), "12 days"
_MARK = ", mk AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 12 DAY AS mark FROM ev)"
_AGAIN = ", rp AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session_id, name ORDER BY ts, event_id) <= INTERVAL 2 DAY, false) AS again FROM ev)"


@register("stream_dedup", cte("ev", f"{_MARK} {_AGAIN} SELECT event_id, session_id, name FROM rp, mk WHERE NOT again AND ts <= mark"))
def _(spark, sf):
    stream = _late_stream(spark, sf)
    out = events.stream_dedup(stream.drop("status"), _KEYS, _WITHIN, ["event_id"], _DELAY)
    return _drain(spark, out, "dedup").select("event_id", "session_id", "name")


@register("repeats", cte("ev", f"{_AGAIN} SELECT event_id, session_id, name, again AS repeat FROM rp"))
def _(spark, sf):
    return events.repeats(table(spark, sf, "ev").select("ts", "event_id", *_KEYS), _KEYS, _WITHIN, ["event_id"]).drop("ts")


_SUPPRESSED = _AGAIN + """, n AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, session_id, name, count(*) AS suppressed FROM rp WHERE again GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY suppressed DESC, session_id, name) AS rank, CAST(sum(suppressed) OVER (PARTITION BY d) AS BIGINT) AS total FROM n{closed})
SELECT strftime(d, '%Y-%m-%d') AS interval_start, session_id, name, suppressed, rank, total FROM r WHERE rank <= 3"""


@register("repeat_summary", cte("ev", _SUPPRESSED.format(closed="")))
def _(spark, sf):
    out = events.repeat_summary(table(spark, sf, "ev"), _KEYS, _WITHIN, ["event_id"], "1 day")
    return out.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd"))


@register("stream_repeat_summary", cte("ev", _MARK + _SUPPRESSED.format(closed=", mk WHERE d + INTERVAL 1 DAY <= mark")))
def _(spark, sf):
    stream, out = _late_stream(spark, sf), scratch(spark, "summary")
    events.write_repeat_summary(stream, f"{out}/data", f"{out}/checkpoint", _KEYS, _WITHIN, ["event_id"], "1 day", delay=_DELAY).awaitTermination()
    found = spark.read.schema("interval_start timestamp, session_id string, name string, suppressed bigint, rank int, total bigint").parquet(f"{out}/data")
    return found.select(F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "session_id", "name", "suppressed", "rank", "total")


@register(
    "dedup_summary",
    cte(
        "ev",
        """, n AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, name, status, count(*) - 1 AS suppressed FROM ev GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY suppressed DESC, name, status) AS rank, CAST(sum(suppressed) OVER (PARTITION BY d) AS BIGINT) AS total FROM n)
SELECT strftime(d, '%Y-%m-%d') AS interval_start, name, status, suppressed, rank, total FROM r WHERE rank <= 3""",
    ),
)
def _(spark, sf):
    out = events.dedup_summary(table(spark, sf, "ev"), ["name", "status"], "1 day")
    return out.withColumn("interval_start", F.date_format("interval_start", "yyyy-MM-dd"))


_PHASE = """, p AS (SELECT session_id AS workflow, event_id AS seq, lag(name) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS from_phase, name AS to_phase FROM ev) SELECT * FROM p WHERE from_phase <> to_phase"""


@register("phase_transitions", cte("ev", _PHASE))
def _(spark, sf):
    return events.phase_transitions(_journal(table(spark, sf, "ev"))).drop("ts")


_PHASE_CLOSED = """, p AS (SELECT session_id AS workflow, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, ts <= mark AS due, event_id AS seq, lag(name) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS from_phase, name AS to_phase,
  coalesce(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) > INTERVAL 9 DAY, false) AS quiet FROM ev, mk) SELECT workflow, ts, seq, from_phase, to_phase FROM p WHERE from_phase <> to_phase AND due AND NOT quiet"""


@register("stream_phase_transitions", cte("ev", _MARK + _PHASE_CLOSED))
def _(spark, sf):
    out = events.stream_phase_transitions(_journal(_late_stream(spark, sf)), _DELAY, datetime.timedelta(days=9))
    return _drain(spark, out, "phases").withColumn("ts", _TIME("ts"))


@register("valid_journal_events", cte("ev", "SELECT event_id, name FROM ev WHERE name = 'error'"))
def _(spark, sf):
    return events.valid_journal_events(table(spark, sf, "ev").withColumn("event_type", F.col("name"))).select("event_id", "name")


# ---- file changes -----------------------------------------------------------------------------------


def _change_stream(spark, sf):
    s = _stream(spark, sf)
    return s.select(
        F.col("event_id").alias("seq"), "ts", F.concat_ws("/", "session_id", "name").alias("path"),
        F.when(F.col("status") == "timeout", "delete").otherwise("change").alias("op"), F.col("props").alias("content"),
    )


@register(
    "stream_changes",
    cte(
        "ev",
        """, c AS (SELECT event_id AS seq, ts, session_id || '/' || name AS path, CASE WHEN status = 'timeout' THEN 'delete' ELSE 'change' END AS op, props AS content FROM ev)
, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY path ORDER BY ts, seq)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT path, max(seq) AS seq, max_by(op, seq) AS op, max_by(content, seq) AS content, count(*) AS changes FROM n GROUP BY path, no HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM c)""",
    ),
)
def _(spark, sf):
    out = _drain(spark, changes.stream_changes(_change_stream(spark, sf), "6 hours"), "changes")
    return out.drop("ts")


_CHANGED = """, now AS (SELECT path, CASE WHEN k % 80 = 1 AND k > 50 THEN 'include nowhere' || chr(10) || 'import act_1' WHEN k % 40 = 1 AND k > 50 THEN content || chr(10) || 'export fresh_name' || chr(10) ELSE content END AS content FROM src WHERE NOT (k % 60 = 7 AND k > 50)
UNION ALL SELECT 'corpus0/mising_1.spec' AS path, 'export made' AS content)
, ln AS (SELECT path, CAST(i - 1 AS INT) AS line, l[i] AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM now) AS s, unnest(range(1, len(l) + 1)) AS t(i))
, ex AS (SELECT path, line, regexp_extract(text, '(export|import)\\s+[\\w.]+', 1) AS direction, regexp_extract(text, '(export|import)\\s+([\\w.]+)', 2) AS name FROM ln WHERE regexp_matches(text, '^\\s*(export|import)\\s+[\\w.]+'))
, st AS (SELECT regexp_extract(path, '([^/]+)\\.spec$', 1) AS include_name, min(path) AS to_path FROM now GROUP BY 1)
, ic AS (SELECT path, line, regexp_extract(text, '^include (\\w+)', 1) AS include_name FROM ln WHERE regexp_matches(text, '^include \\w+'))
, inc AS (SELECT ic.*, to_path FROM ic LEFT JOIN st USING (include_name))
, rc AS (SELECT DISTINCT path AS start, path AS node FROM ex WHERE direction = 'import' UNION SELECT rc.start, inc.to_path FROM rc JOIN inc ON inc.path = rc.node WHERE inc.to_path IS NOT NULL)
, ln2 AS (SELECT i.path, i.name, min(e.path) AS exported_by FROM ex i JOIN rc ON rc.start = i.path AND rc.node <> i.path JOIN ex e ON e.path = rc.node AND e.direction = 'export' AND e.name = i.name WHERE i.direction = 'import' GROUP BY 1, 2)
SELECT 'export' AS what, path, name, line, direction AS target FROM ex UNION ALL SELECT 'include', path, include_name, line, to_path FROM inc
UNION ALL SELECT 'import', i.path, i.name, i.line, l.exported_by FROM ex i LEFT JOIN ln2 l USING (path, name) WHERE i.direction = 'import'"""


@register("stream_reindex", cte("src", "RECURSIVE" + _CHANGED))
def _(spark, sf):
    """Two batches, of changed and of deleted and new files, over an index of all files; the tables that depend on them afterwards."""
    src = table(spark, sf, "src").select("path", "content", "k")
    out = scratch(spark, "reindex")
    changes.build_index(src, f"{out}/index", buckets=max(8, spark.sparkContext.defaultParallelism))
    fresh = F.when(F.col("k") % 80 == 1, "include nowhere\nimport act_1").otherwise(F.concat("content", F.lit("\nexport fresh_name\n")))
    common = [F.col("k").alias("seq"), F.current_timestamp().alias("ts"), "path"]
    changed = src.filter("k % 40 = 1 AND k > 50").select(*common, F.lit("change").alias("op"), fresh.alias("content"))
    gone = src.filter("k % 60 = 7 AND k > 50").select(*common, F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content"))
    made = spark.range(1).select(
        F.lit(0).cast("long").alias("seq"), F.current_timestamp().alias("ts"), F.lit("corpus0/mising_1.spec").alias("path"), F.lit("change").alias("op"), F.lit("export made").alias("content")
    )
    changed.coalesce(1).write.parquet(f"{out}/changes")
    gone.unionByName(made).coalesce(1).write.mode("append").parquet(f"{out}/changes")
    stream = spark.readStream.schema(changes.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/changes")
    changes.stream_reindex(stream, f"{out}/index", f"{out}/checkpoint", budget=1.0).awaitTermination()
    from factloom.sources.buckets import load_buckets

    index = load_buckets(spark, f"{out}/index")
    rows = [("export", "exports", "name", "direction"), ("include", "includes", "include_name", "to_path"), ("import", "imports", "name", "exported_by")]
    parts = [index.table(t).select(F.lit(w).alias("what"), "path", F.col(n).alias("name"), "line", F.col(c).alias("target")) for w, t, n, c in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("stream_lint", ON_LINES(_ALL + "SELECT * FROM all_d"))
def _(spark, sf):
    """All files in a first batch, every fifth of them as an empty text; these come with their real text in a second one."""
    out = scratch(spark, "lint")
    src = table(spark, sf, "src")
    rows = lambda df, content: df.select(
        F.lit(0).cast("long").alias("seq"), F.current_timestamp().alias("ts"), "path", F.lit("change").alias("op"), content.alias("content")
    )
    # a batch of as many files as there are tasks: the stream takes all there are, and goes on where it was when there are more
    for part in (rows(src, F.when(F.col("k") % 5 == 0, "").otherwise(F.col("content"))), rows(src.filter("k % 5 = 0"), F.col("content"))):
        part.write.mode("append").parquet(f"{out}/changes")
        stream = spark.readStream.schema(changes.CHANGE_SCHEMA).parquet(f"{out}/changes")
        changes.write_lint(stream, out, f"{out}/checkpoint").awaitTermination()
    return changes.current_lint(spark, out)


_TAGGED = """WITH RECURSIVE b AS (SELECT unnest(range(0, 3)) AS b), ch AS (SELECT b, p_partkey AS p, CASE WHEN (p_partkey + b) % 7 <> 0 AND (p_partkey + b) % 3 <> 0 THEN [(p_partkey + b) % 900, (p_partkey * (b + 2)) % 1100] ELSE [] END AS tags FROM part, b WHERE (p_partkey + b) % 2 = 0)
, st AS (SELECT b.b, p, max_by(tags, ch.b) AS tags FROM b JOIN ch ON ch.b <= b.b GROUP BY 1, 2), cov AS (SELECT DISTINCT b, 'r:' || unnest(tags) AS req_id FROM st)
, ids AS (SELECT DISTINCT 'r:' || (p_partkey % 1000) AS req_id FROM part), m AS (SELECT b.b, req_id, cov.req_id IS NOT NULL AS covered FROM b CROSS JOIN ids LEFT JOIN cov USING (b, req_id))
, d AS (SELECT b, req_id, covered, coalesce(lag(covered) OVER (PARTITION BY req_id ORDER BY b), false) AS was FROM m)
SELECT b AS batch, req_id, CASE WHEN covered THEN 'recovered' ELSE 'new_gap' END AS change FROM d WHERE covered <> was"""


@register("stream_coverage_diff", _TAGGED)
def _(spark, sf):
    """Three batches: every other file changes in a batch; a third has no tags then and a seventh is deleted."""
    out, p = scratch(spark, "coverage"), F.col("p_partkey")
    for b in range(3):
        tags = F.concat(F.lit("x # [r:"), (p + b) % 900, F.lit(", r:"), (p * (b + 2)) % 1100, F.lit("]"))
        gone = (p + b) % 7 == 0
        table(spark, sf, "part").filter((p + b) % 2 == 0).select(
            p.alias("seq"), F.current_timestamp().alias("ts"), F.concat(F.lit("f"), p).alias("path"), F.when(gone, "delete").otherwise("change").alias("op"),
            F.when(~gone, F.when((p + b) % 3 == 0, "x").otherwise(tags)).alias("content"),
        ).coalesce(1).write.mode("append").parquet(f"{out}/changes")
    manifest = cut_lineage(table(spark, sf, "part").select(F.concat(F.lit("r:"), p % 1000).alias("req_id")).distinct())
    stream = spark.readStream.schema(changes.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{out}/changes")
    changes.stream_coverage_diff(stream, manifest, out, f"{out}/checkpoint", buckets=8).awaitTermination()
    return spark.read.parquet(f"{out}/diffs").select(F.col("batch").cast("long").alias("batch"), "req_id", "change")


@register(
    "latest_changes",
    "SELECT 'k' || (user_id % 100) AS path, max(event_id) AS seq, max_by(event_type, event_id) AS op FROM events GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("k"), (F.col("user_id") % 100).cast("string")).alias("path"), F.col("event_type").alias("op"),
        F.col("props").alias("content"), F.col("event_id").alias("seq"),
    )
    return changes.latest_changes(e).select("path", "seq", "op")


