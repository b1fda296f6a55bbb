import json
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factloom.operators import maintain, reports
from factloom.sources import corpus, index


def test_scan_corpus(spark, tmp_path):
    (tmp_path / "a" / "build").mkdir(parents=True)
    (tmp_path / "a" / "x.spec").write_text("one\ntwo")
    (tmp_path / "a" / "bad.spec").write_bytes(b"caf\xe9")
    (tmp_path / "a" / "build" / "y.spec").write_text("no")
    (tmp_path / "a" / "z.txt").write_text("no")
    got = corpus.scan_corpus(spark, str(tmp_path), ".spec", corpus="c", max_bytes=6)
    bad, big = ("a/bad.spec", "bad", "caf�", 4, "ok"), ("a/x.spec", "x", None, 7, "oversized")
    assert rows(got, "path", "stem", "content", "size", "status") == [bad, big]
    # a wrong checksum beside a file makes it unreadable
    (tmp_path / "a" / "torn.spec").write_text("t")
    (tmp_path / "a" / ".torn.spec.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + bytes(4))
    got = corpus.scan_corpus(spark, str(tmp_path), ".spec", corpus="c", max_bytes=6, report_unreadable=True)
    torn = ("a/torn.spec", "torn", None, 1, "unreadable")
    assert rows(got, "path", "stem", "content", "size", "status") == [bad, torn, big]
    with pytest.raises(Exception, match="(?i)checksum"):
        corpus.scan_corpus(spark, str(tmp_path), ".spec").collect()


def test_manifests(spark, tmp_path):
    (tmp_path / "p" / "q").mkdir(parents=True)
    (tmp_path / "p" / "q" / "d_requirements.yaml").write_text(
        "rfc: RFC1\nrequirements:\n  r:1:\n    text: t\n    level: MAY\n  r:2: {}\n  r:3: no\n"
    )
    (tmp_path / "bad_requirements.yaml").write_text("- a")
    got = corpus.scan_manifest(spark, str(tmp_path))
    assert rows(got, "req_id", "rfc", "level", "testable") == [("r:1", "RFC1", "MAY", True), ("r:2", "RFC1", "MUST", True)]
    assert corpus.scan_manifest(spark, str(tmp_path), corpus="zz").count() == 0
    torn = spark.createDataFrame([("x", "a: [1"), ("y", None), ("z", "requirements: {q: {}}")], "path string, content string")
    assert rows(corpus.manifest_errors(torn), "path") == [("x",), ("y",)]
    assert rows(corpus.parse_manifests(torn), "path", "req_id") == [("z", "q")]
    doc = json.dumps({"rfc": "RFC1", "requirements": {"r:1": {"text": "t"}}})
    js = corpus.manifest_from_json(spark.createDataFrame([("m", doc)], "path string, content string"))
    assert rows(js, "req_id", "level", "section", "testable") == [("r:1", "MUST", "", True)]


def test_layers_fall_back_to_all(spark):
    files = spark.createDataFrame([("a/b/c",), ("a/bb/c",)], "path string")
    layers = spark.createDataFrame([("L", "a/b"), ("M", "a")], "layer string, include_root string")
    assert rows(corpus.scan_filter_layers(files, layers, ["L"])) == [("a/b/c", "L")]
    assert rows(corpus.scan_filter_layers(files, layers)) == [("a/b/c", "L"), ("a/bb/c", "M")]
    none = spark.createDataFrame([("N", "zz")], "layer string, include_root string")
    assert corpus.scan_filter_layers(files, none).count() == 2


def test_logs_and_events(spark, tmp_path):
    (tmp_path / "one.log").write_text("a\r\nb\n")
    got = corpus.scan_check_log(spark, str(tmp_path / "one.log"))
    assert rows(got, "line_no", "text") == [(0, "a"), (1, "b"), (2, "")]
    (tmp_path / "e.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","session_id":"s","name":"t","duration_ms":1.5}\n')
    e = corpus.scan_session_events(spark, str(tmp_path / "e.jsonl"))
    assert rows(e, "session_id", "name", "duration_ms") == [("s", "t", 1.5)]


def test_infer_corpus(spark):
    df = spark.createDataFrame([("/w/pt/quick/a",), ("known/a",), ("other/a",), ("w/pt",)], "p string")
    got = df.select("p", corpus.infer_corpus(F.col("p"), "pt", ["known"]).alias("c"))
    assert dict(rows(got)) == {"/w/pt/quick/a": "quick", "known/a": "known", "other/a": None, "w/pt": None}


def test_index_snapshots_and_merge(spark, tmp_path):
    nodes = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    edges = spark.createDataFrame([("a", "T", "b")], "src string, etype string, dst string")
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    index.write_index({"nodes": nodes(("a", 1), ("b", 1)), "edges": edges}, one)
    index.write_index({"nodes": nodes(("a", 2)), "edges": edges}, one, seq=1)
    assert rows(index.load_index(spark, one)["nodes"]) == [("a", 2)]
    assert rows(index.load_index(spark, one, before=1)["nodes"]) == [("a", 1), ("b", 1)]
    index.write_index({"nodes": nodes(("a", 9), ("c", 9)), "edges": edges}, two)
    merged = index.merge_indexes(spark, [one, two])
    assert rows(merged["nodes"]) == [("a", 9), ("c", 9)] and merged["edges"].count() == 1
    assert Path(one, "v0").exists()


def test_upsert_keeps_higher_tiers(spark):
    nodes = spark.createDataFrame(
        [("a", "f", 1, 1), ("b", "f", 1, 3), ("c", "f", 1, 1), ("d", "g", 1, 1)], "id string, path string, line int, tier int"
    )
    edges = spark.createDataFrame([("c", "X", "d"), ("b", "X", "a"), ("d", "X", "c")], "src string, etype string, dst string")
    new = spark.createDataFrame([("a", "f", 2, 2), ("b", "f", 2, 2)], "id string, path string, line int, tier int")
    extra = spark.createDataFrame([("a", "Y", "d")], "src string, etype string, dst string")
    out = maintain.upsert_file(nodes, edges, new, extra, "f", 2)
    assert rows(out["nodes"], "id", "line", "tier") == [("a", 2, 2), ("b", 1, 3), ("d", 1, 1)]
    assert rows(out["edges"]) == [("a", "Y", "d"), ("b", "X", "a")]


def test_overlay_and_remap(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content string")
    ch = spark.createDataFrame(
        [("a", "delete", None, 1), ("a", "change", "2", 2), ("b", "delete", None, 3), ("n", "create", None, 4)],
        "path string, op string, content string, seq int",
    )
    assert rows(maintain.overlay_merge(base, ch)) == [("a", "2", "overlay"), ("c", "1", "base"), ("n", "", "overlay")]
    df = spark.createDataFrame([("x/y/f",), ("x/yy/f",), ("x/y:3:n",)], "p string")
    assert rows(maintain.remap_paths(df, "x/y", "z", ["p"])) == [("x/yy/f",), ("z/f",), ("z:3:n",)]


def test_index_staleness_limits(spark):
    meta = spark.createDataFrame([("c", f"f{i}", 0.0) for i in range(10)], "corpus string, path string, mtime double")
    def status(changed):
        cur = spark.createDataFrame(
            [("c", f"f{i}", 5.0 if i < changed else 1.0) for i in range(10)], "corpus string, path string, mtime double"
        )
        return reports.index_staleness(meta, cur).first()["status"]
    assert [status(0), status(1)] == ["fresh", "stale_major"]
    wide = spark.createDataFrame([("c", f"f{i}", 0.0) for i in range(20)], "corpus string, path string, mtime double")
    one = spark.createDataFrame([("c", f"f{i}", 9.0 if i == 0 else 0.0) for i in range(20)], "corpus string, path string, mtime double")
    assert reports.index_staleness(wide, one).first()["status"] == "stale_minor"


def test_quality_gate_levels(spark, files):
    from factloom.operators.symbols import extract_includes

    f = files(("a_test.x", "#lang s\ninclude b\nexport go\n# [r:1]"), ("b.x", "#lang s\nbefore go {\n}"), ("c.x", "no"))
    inc = extract_includes(f)
    assert rows(reports.quality_gate(f, inc), "check", "passed") == [
        ("includes_resolve", True), ("lang_header", False), ("minimum_files", True),
    ]
    manifest = spark.createDataFrame([("r:1",)], "req_id string")
    full = reports.quality_gate(f, inc, manifest, "comprehensive")
    assert full.count() == 8
    assert rows(reports.gate_result(full)) == [(False, 7, 8)]
