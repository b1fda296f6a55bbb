import datetime as dt

from conftest import rows
from pyspark.sql import Row
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from factloom.operators import lint
from factloom.sources.buckets import load_buckets
from factloom.streaming import changes, events, ordered

CHANGES = changes.CHANGE_SCHEMA
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _files(spark, path, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce_keeps_newest(spark, tmp_path):
    rows_in = [
        (1, _at(0), "a", "change", "1"), (2, _at(0.1), "a", "change", "2"), (3, _at(5), "a", "change", "3"),
        (4, _at(0), "b", "change", "b"), (9, _at(60), "z", "change", "z"),
    ]
    stream = _files(spark, str(tmp_path / "in"), [rows_in], CHANGES)
    out = changes.stream_changes(stream)
    q = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    assert rows(got, "path", "content", "changes") == [("a", "2", 2), ("a", "3", 1), ("b", "b", 1)]


CORPUS = [
    ("a.x", "export f\nrequire x;"), ("b.x", "include a\nimport f"), ("c.x", "include b\nimport f\nimport k"), ("d.x", "type t"), ("e.x", "type u\ninclude late"),
    ("g.x", "type v\nimport f"), ("z/a.x", "export f"), ("h.x", "include late\nimport k\n# [r:1]"), *[(f"o{i}.x", f"type t{i}") for i in range(8)],
]
REINDEX = [
    [(1, _at(0), "a.x", "change", "export f\ntype k")],  # what it exports stays
    [(2, _at(1), "a.x", "change", "export g")],
    [(3, _at(2), "d.x", "delete", None), (4, _at(3), "late.x", "change", "export k\ninclude c")],  # a name that two files ask for
    [  # the other file of the name takes the place of the deleted one
        (5, _at(4), "a.x", "delete", None), (6, _at(5), "h.x", "change", "x"), (7, _at(6), "h.x", "change", "include b\nimport f"),
        (8, _at(6), "none.x", "delete", None), (9, _at(7), "z/a.x", "change", "export f\nexport k"),
    ],
]


def _index(tables):
    return {k: rows(v.select(sorted(v.columns))) for k, v in tables.items()}


def test_reindex_equals_a_full_rebuild(spark, files, tmp_path):
    d = str(tmp_path / "idx")
    changes.build_index(files(*CORPUS), d, buckets=4)
    stream = _files(spark, str(tmp_path / "in"), REINDEX, CHANGES)
    changes.stream_reindex(stream, d, str(tmp_path / "cp")).awaitTermination()
    now = dict(CORPUS)
    for n, batch in enumerate(REINDEX):
        for _, _, path, op, content in batch:
            now.pop(path, None)
            if op != "delete":
                now[path] = content
        got = load_buckets(spark, d, before=n + 2)
        assert got.seq == n + 1
        if n in (1, 3):
            assert _index(got.tables()) == _index(changes.index_tables(files(*now.items()))), n
    dirty = [dict(rows(spark.read.parquet(f"{d}/dirty/at={n}"), "path", "reason")) for n in range(1, 5)]
    assert dirty[0] == {"a.x": "changed"}
    assert dirty[1] == {"a.x": "changed", "b.x": "includes_changed", "c.x": "includes_changed"}
    assert dirty[2] == {"d.x": "changed", "late.x": "changed", "e.x": "name_changed", "h.x": "name_changed"}
    assert dirty[3] == {
        **{p: "changed" for p in ("a.x", "h.x", "none.x", "z/a.x")}, "b.x": "name_changed", **{p: "includes_changed" for p in ("c.x", "late.x", "e.x")},
    }
    imports = rows(load_buckets(spark, d).table("imports"), "path", "name", "exported_by")
    assert imports == [("b.x", "f", "z/a.x"), ("c.x", "f", "z/a.x"), ("c.x", "k", "z/a.x"), ("g.x", "f", None), ("h.x", "f", "z/a.x")]


def test_untouched_buckets_keep_their_files(spark, files, tmp_path):
    d = str(tmp_path / "idx")
    was = changes.build_index(files(*CORPUS), d, buckets=8)
    before = {k: set(was.table(k).inputFiles()) for k in was.types}
    ch = spark.createDataFrame([(1, _at(0), "a.x", "change", "export g")], CHANGES)
    now, _ = changes.reindex(was, ch, 1)
    touched = was.buckets_of(spark.createDataFrame([("a.x",)], "path string"))
    assert len(touched) == 1
    for name in ("files", "symbols", "exports", "requirements", "includes"):
        kept = {f for f in before[name] if f"/bucket={next(iter(touched))}/" not in f}
        assert kept <= set(now.table(name).inputFiles()) and len(set(now.table(name).inputFiles()) - kept) <= 1
    # a retry of the batch, from the same state, gives the same rows
    again, _ = changes.reindex(load_buckets(spark, d, before=1), ch, 1)
    assert all(rows(again.table(t)) == rows(now.table(t)) for t in ("exports", "imports"))


def test_reindex_over_budget_is_full(spark, files, tmp_path):
    corpus = [("a.x", "export f"), ("b.x", "include a\nimport f"), ("c.x", "include a"), ("q.x", "type t")]
    was = changes.build_index(files(*corpus), str(tmp_path / "idx"), buckets=4)
    ch = spark.createDataFrame([(1, _at(0), "a.x", "change", "export h"), (2, _at(0), "q.x", "delete", None)], CHANGES)
    now, seen = changes.reindex(was, ch, 1)
    assert rows(seen) == [("a.x", "full"), ("b.x", "full"), ("c.x", "full")]
    assert _index(now.tables()) == _index(changes.index_tables(files(("a.x", "export h"), *corpus[1:3])))


def _append(out, tmp_path):
    q = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q, out.sparkSession.read.schema(out.schema).parquet(str(tmp_path / "out"))


JOURNAL = "workflow string, ts timestamp, seq bigint, phase string"
LATE_BATCHES = [
    [("w", _at(0), 1, "p"), ("w", _at(1), 2, "p"), ("w", _at(4), 5, "q"), ("v", _at(2), 3, None), (None, _at(2), 4, "p"), ("w", None, 9, "x")],
    [("w", _at(2), 4, "r"), ("w", _at(2), 3, "s"), ("w", _at(40.0005), 6, "q"), ("v", _at(41), 7, "p"), ("u", _at(39), 8, "a")],
    [("w", _at(39), 7, "t"), ("v", _at(70), 8, "q"), ("u", _at(75), 9, "b"), ("w", _at(75), 10, "z")],
    [("z", _at(200), 1, "end")],
]


def test_phases_of_late_rows_equal_the_batch_query(spark, tmp_path):
    stream = _files(spark, str(tmp_path / "in"), LATE_BATCHES, JOURNAL)
    whole = spark.createDataFrame([r for b in LATE_BATCHES for r in b], JOURNAL).dropna(subset=["workflow", "ts"])
    q, got = _append(events.stream_phase_transitions(stream, "45 seconds"), tmp_path)
    assert rows(got) == rows(events.phase_transitions(whole)) and got.count() == 8
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert states[-1] < max(states)  # rows that the watermark has passed are gone


def test_quiet_workflows_are_forgotten(spark, tmp_path):
    stream = _files(spark, str(tmp_path / "in"), LATE_BATCHES, JOURNAL)
    whole = spark.createDataFrame([r for b in LATE_BATCHES for r in b], JOURNAL).dropna(subset=["workflow", "ts"])
    forget = dt.timedelta(seconds=35)
    q, got = _append(events.stream_phase_transitions(stream, "45 seconds", forget), tmp_path)
    want = rows(events.phase_transitions(whole, forget=forget))
    assert rows(got) == want and len(want) == 7
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # the workflow that waits, and its timer


def test_a_row_behind_the_watermark_is_dropped(spark, tmp_path):
    batches = [[("w", _at(100), 2, "b")], [("w", _at(200), 3, "c")], [("w", _at(150), 4, "x"), ("w", _at(10), 1, "a")], [("w", _at(300), 5, "c")]]
    _, got = _append(events.stream_phase_transitions(_files(spark, str(tmp_path / "in"), batches, JOURNAL), "60 seconds"), tmp_path)
    assert rows(got, "seq", "from_phase", "to_phase") == [(3, "x", "c"), (4, "b", "x")]


EVENTS = "ts timestamp, seq bigint, file string, message string"


def _messages():
    times = [0, 5, 9, 30, 31, 50, 50, 95, 96, 200]
    return [(_at(s), i, f"f{i % 2}", "m" if s != 31 else None) for i, s in enumerate(times)] + [(_at(s), 50 + i, "f0", "n") for i, s in enumerate([1, 2, 3, 70, 71])]


def test_repeats_and_their_summary_over_batches(spark, tmp_path):
    keys, within = ["file", "message"], dt.timedelta(seconds=20)
    all_rows = _messages()
    batches = [all_rows[:2] + all_rows[4:6], all_rows[2:4] + all_rows[10:13], all_rows[6:9] + all_rows[13:], all_rows[9:10], [(_at(400), 99, "f0", "end")]]
    whole = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    marked = events.repeats(whole, keys, within, ["seq"])
    expected = {r.seq: r.repeat for r in marked.collect()}
    assert {k for k, v in expected.items() if v} == {2, 5, 51, 52, 54} | {i for i in (3, 6, 7, 8) if expected[i]}
    stream = _files(spark, str(tmp_path / "in"), batches, EVENTS)
    q, got = _append(events.stream_dedup(stream, keys, within, ["seq"], "60 seconds"), tmp_path)
    assert rows(got, "seq", "file", "message") == rows(marked.filter("NOT repeat AND seq < 99"), "seq", "file", "message")
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < q.recentProgress[2]["stateOperators"][0]["numRowsTotal"]
    d = str(tmp_path / "summary")
    events.write_repeat_summary(stream, d, str(tmp_path / "cp2"), keys, within, ["seq"], delay="60 seconds").awaitTermination()
    want = events.repeat_summary(whole, keys, within, ["seq"])
    cols = ["interval_start", "file", "message", "suppressed", "rank", "total"]
    assert rows(spark.read.parquet(d), *cols) == rows(want, *cols) and want.count() > 2


def test_coverage_diff_over_batches(spark, tmp_path):
    manifest = spark.createDataFrame([("r:1",), ("r:2",)], "req_id string")
    schema = "path string, line int, tags array<string>"
    stream = _files(spark, str(tmp_path / "in"), [[("f", 1, ["r:1"])], [("f", 1, ["r:2"])]], schema)
    d = str(tmp_path / "out")
    changes.stream_coverage_diff(stream, manifest, d, str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(f"{d}/diffs"), "batch", "req_id", "change")
    assert got == [(0, "r:1", "recovered"), (1, "r:1", "new_gap"), (1, "r:2", "recovered")]


def test_dedup_summary(spark):
    e = spark.createDataFrame([(_at(i), "k" if i % 3 else "j") for i in range(30)], "ts timestamp, m string")
    got = rows(events.dedup_summary(e, ["m"]), "m", "suppressed", "rank", "total")
    assert got == [("j", 9, 2, 28), ("k", 19, 1, 28)]
    assert rows(events.dedup(e, ["m"]), "m", "suppressed") == [("j", 9), ("k", 19)]


def test_lint_over_batches_is_that_of_the_files_as_they_are(spark, files, tmp_path):
    batches = [
        [(1, _at(0), "a", "change", "x {\n}}\n"), (2, _at(0), "b", "change", "relation r(x:t)\nrelation r(x:t)"), (3, _at(0), "c", "change", "}")],
        [(4, _at(1), "a", "change", "}"), (5, _at(2), "a", "change", "#lang s\naction q = {\n v := 1;\n}"), (6, _at(2), "c", "delete", None)],
    ]
    stream = _files(spark, str(tmp_path / "in"), batches, CHANGES)
    d = str(tmp_path / "out")
    changes.write_lint(stream, d, str(tmp_path / "cp")).awaitTermination()
    now = files(("a", batches[1][1][4]), ("b", batches[0][1][4]))
    cols = ["code", "severity", "path", "line", "subject", "detail"]
    want = rows(lint.text_diagnostics(now), *cols)
    assert rows(changes.current_lint(spark, d), *cols) == want
    assert {r[0] for r in want} >= {"unguarded_action", "duplicate_decl", "missing_header"}


def test_keys_of_a_bucket_share_their_state_calls():
    calls = []

    class State:
        def __init__(self):
            self.values = []

        def appendList(self, values):
            calls.append("append")
            self.values += values

        def put(self, values):
            calls.append("put")
            self.values = list(values)

        def get(self):
            calls.append("get")
            return iter(self.values)

        def clear(self):
            calls.append("clear")
            self.values = []

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, name, schema):
            return State()

        def listTimers(self):
            return [(t,) for t in self.timers]

        def registerTimer(self, t):
            self.timers.append(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Mark:
        def getCurrentWatermarkInMs(self):
            return 1_000

    columns = StructType([StructField("_at", LongType()), StructField("k", StringType()), StructField("seq", LongType())])
    result = StructType([StructField("k", StringType()), StructField("ts", TimestampType()), StructField("seq", LongType()), StructField("again", BooleanType())])
    step = ordered.InOrder(columns, result, ["k"], ["seq"], lambda last, row: (last is not None,), 500_000)
    step.init(Handle())
    keys = [f"k{i}" for i in range(25_000)]
    given = [Row("_at", "k", "seq")(at, k, 0) for at in (900_000, 100_000, 700_000, 1_500_000) for k in keys]
    assert list(step.handleInputRows((1,), iter(given), None)) == []
    assert step.handle.timers == [99]
    step.handle.timers = []
    out = list(step.handleExpiredTimer((1,), Mark(), None))
    # 600 ms apart is too far, 200 ms is not
    assert [sum(r["again"] for r in out[i :: len(keys)]) for i in (0, 24_999)] == [1, 1]
    assert len(out) == 75_000 and {r["k"] for r in out if r["again"]} == set(keys)
    assert sum(len(x) for x in map(list, [ordered._unpacked(step.waiting)])) == 25_000
    assert step.handle.timers == [1_400]
    assert len(calls) <= 8


def test_lint_shuffles_texts_only_where_a_path_comes_twice(spark, files, tmp_path, monkeypatch):
    calls = []
    latest = changes.latest_changes
    monkeypatch.setattr(changes, "latest_changes", lambda batch: calls.append(1) or latest(batch))
    batches = [[(1, _at(0), "a", "change", "}"), (2, _at(0), "b", "change", "}")], [(3, _at(1), "a", "change", "x"), (4, _at(2), "a", "change", "}}")]]
    d = str(tmp_path / "out")
    changes.write_lint(_files(spark, str(tmp_path / "in"), batches, CHANGES), d, str(tmp_path / "cp")).awaitTermination()
    assert calls == [1]
    want = rows(lint.text_diagnostics(files(("a", "}}"), ("b", "}"))), "code", "path", "line")
    assert rows(changes.current_lint(spark, d), "code", "path", "line") == want
