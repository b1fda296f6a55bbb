"""Extraction rules on small texts with literal expected rows."""

import random

from conftest import rows
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import blocks, documents, lint, logs, patterns, symbols
from factloom.operators.graph import change_impact
from factloom.operators.navigate import find_references, rename_plan, word_index

SPEC = """#lang spec
include a
 include indented
type color = {red,
  green}
object outer = {
  type this = struct { a : t }
  object inner = {
    relation open(X:a)
    action go(x:t) returns (ok:bool) = {
      call outer.step(x);
    }
  }
  individual cur : idx # [3]
}
action send(x:t,
   y:u) = {
  require a.b(x); # [r1:4.1, 8]
  # } comment brace
  if y > 0 {
     cur(x) := y;
  }
  <<<
   if (a) { "}"
  >>>
  require a; require b;
}
before send { require z > 0; }
after init {
   p := 1;
   around deep {
      ensure _generating -> q;
   }
   q := 2
}
before open_end {
  require never;
"""


def test_blocks_ignore_comments_and_native_code(files):
    got = rows(blocks.extract_blocks(files(("f", SPEC))), "mixin_kind", "monitor_action", "start_line", "end_line", "has_generating_guard")
    assert got == [
        ("after", "init", 28, 34, True),
        ("around", "deep", 30, 32, True),
        ("before", "send", 27, 27, False),
        ("direct", "go", 9, 11, False),
        ("direct", "send", 15, 26, False),
    ]


def test_requirements_and_writes_belong_to_innermost_block(files):
    f = files(("f", SPEC))
    assert rows(blocks.extract_requirements(f), "line", "kind", "formula_text", "monitor_action", "mixin_kind", "tags") == [
        (17, "require", "a.b(x)", "send", "direct", ["r1:4.1", "8"]),
        (25, "require", "a; require b", "send", "direct", []),
        (27, "require", "z > 0", "send", "before", []),
        (31, "ensure", "_generating -> q", "deep", "around", []),
    ]
    assert rows(blocks.extract_writes(f), "line", "var_name", "monitor_action") == [
        (20, "cur", "send"), (29, "p", "init"), (33, "q", "init"),
    ]


def test_symbols_over_several_lines(files):
    got = rows(symbols.extract_symbols(files(("f", SPEC))), "line", "name", "kind", "detail")
    assert (3, "color", "class", "enum: red, green") in got
    assert (15, "send", "function", "(x:t, y:u)") in got
    assert (9, "go", "function", "(x:t) returns (ok:bool)") in got


def test_nested_symbols(files):
    got = dict((r[0], r[1:]) for r in rows(symbols.extract_nested_symbols(files(("f", SPEC))), "qualified_name", "line", "depth"))
    assert got["outer.inner.open"] == (8, 2)
    assert got["outer.cur"] == (13, 1)
    assert got["send"][1] == 0 and got["outer.inner"] == (7, 1)


def test_references_calls_need_a_declaration_above(files):
    f = files(("f", "call early(x);\naction a = {\n  call b.c(x);\n}\nbefore a {\n}\ninstance i : m(1)"))
    assert rows(symbols.extract_references(f, symbols.extract_symbols(f)), "source_name", "target_name", "kind", "line") == [
        ("a", "b.c", "call", 2), ("before a", "a", "monitor", 4), ("i", "m", "instance", 6),
    ]


def test_includes_exports(files):
    f = files(("f", SPEC + "export go\n  import action\naction export run\n# export no\n"))
    assert rows(symbols.extract_includes(f), "include_name", "line") == [("a", 1)]
    assert rows(symbols.extract_includes(f, indented=True), "include_name") == [("a",), ("indented",)]
    assert rows(symbols.extract_exports(f), "name", "direction") == [("action", "import"), ("go", "export"), ("run", "export")]


def test_tags(spark):
    cases = {
        "require x; # [r1:4.1, r1:8]": ["r1:4.1", "r1:8"],
        "# Description text [r2:8]": ["r2:8"],
        "#require foo # [8]": [],
        "## head [a]": [],
        "x [a]": [],
        "x # [a, b c, d.e]": ["a", "d.e"],
        "# [4]": ["4"],
        "x # [a] y": [],
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.parse_tags(F.col("t")).alias("g"))
    assert {r["t"]: r["g"] for r in df.collect()} == cases


def test_annotations_drop_bare_integers(files):
    f = files(("f", "a # [1, 2]\nb # [1, r:2]\n# [7]"))
    assert rows(symbols.extract_annotations(f), "id", "tags") == [("f:1:0", ["1", "r:2"])]


def test_lines_with_neighbours(files):
    got = rows(blocks.explode_lines(files(("f", "a\nb\n")), before=2, after=1), "line_no", "text", "prev1", "prev2", "next1")
    assert got == [(0, "a", None, None, "b"), (1, "b", "a", None, ""), (2, "", "b", "a", None)]


def _braces(text):
    out, depth = [], 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        code = line if line.strip().startswith("#lang") else line.split("#")[0]
        for col, ch in enumerate(code):
            depth += (ch == "{") - (ch == "}")
            if depth < 0:
                out.append((i, "}", str(col)))
                depth = 0
    if depth:
        out.append((len(lines) - 1, "{", str(depth)))
    return out


def test_unmatched_braces_against_scan(files):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("{}x#\n") for _ in range(30)) for _ in range(60)]
    f = files(*[(f"p{i}", t) for i, t in enumerate(texts)])
    want = sorted(((f"p{i}", *d) for i, t in enumerate(texts) for d in _braces(t)), key=repr)
    assert rows(lint.lint_unmatched_brace(f), "path", "line", "subject", "detail") == want


def test_text_lint(files):
    f = files(
        ("a_test.x", "relation r(x:t,\n  Y:t)\nrelation r\n#require old\n# todo\nafter init {\n}\nexport action go\nrequire z;\n# tag = 1\n# tag = 1\n# tag = q\n"),
    )
    got = rows(lint.text_diagnostics(f), "code", "severity", "line", "subject")
    assert ("missing_header", "warning", 0, None) in got
    assert ("lowercase_param", "error", 0, "x") in got
    assert ("duplicate_decl", "error", 2, "r") in got
    assert ("missing_init", "warning", 2, "r") in got
    assert ("commented_requirement", "info", 3, "require") in got
    assert ("empty_init", "warning", 5, None) in got
    assert ("missing_finalize", "warning", 0, None) in got
    assert ("missing_tag", "hint", 8, "require") in got
    assert ("duplicate_tag_value", "warning", 10, "1") in got
    assert ("placeholder_tag", "info", 11, "q") in got


def test_unguarded_action(files):
    f = files(("f", "action a = {\n  x := 1;\n}\naction b = {\n require y;\n x := 1;\n}\naction c = {\n}"))
    assert rows(lint.lint_unguarded_action(f), "line", "subject") == [(0, "a")]


def test_unguarded_action_bodies(files):
    f = files(
        ("unclosed", "action a = {\n x := 1;\nif y {\n}\n"),
        ("after", "action a = {\n}\nx := 1;\naction b(x:t) returns\n (y:t) = {\n { x := 1 } }\nrequire z;"),
        ("nested", "object o = {\n  action a = { x := 1; { require(q) } }\n  action b = { if q { x := 1 } }\n}\nrequire z;"),
        ("line", "action a = { x := 1 } action b = { y := 1 }\n# action c = { z := 1 }\n"),
        ("stray", "}}\naction a = {\n x := 1\n}\n{{"),
        ("none", "action a = {\n require x; x := 1\n}\naction b = { y }"), ("empty", ""), ("null", None),
    )
    got = rows(lint.lint_unguarded_action(f), "path", "line", "subject")
    assert got == [("after", 3, "b"), ("line", 0, "a"), ("nested", 2, "b"), ("stray", 1, "a"), ("unclosed", 0, "a")]


def test_entities_are_linear_in_the_objects_of_a_file(files):
    many = "\n".join(f"object o{i} = {{\n variant this of o{i}\n}}\nobject p{i} = {{\n}}" for i in range(10000))
    f = files(
        ("many", many), ("none", "object a = {\n}\nvariant this of b"), ("null", None),
        ("roles", "module m(x) = {\n}\nobject a = {\n}\nobject b = {\n}\nmodule n(x) = {\n}\nobject a = {\n}\nvariant this of a\nmodule k(x) = {\n}\naction my_behavior\nobject a = {\n}"),
        ("earlier", "variant this of a\nobject a = {\n}"),
    )
    got = patterns.detect_entities(f)
    assert got.filter("path = 'many'").count() == 10000
    assert rows(got.filter("path <> 'many'"), "path", "line", "name", "args", "details") == [
        ("roles", 2, "a", ["n", "k"], {"role_type": "asymmetric", "has_behavior": "true"}),
        ("roles", 8, "a", ["k"], {"role_type": "symmetric", "has_behavior": "true"}),
    ]


def test_sections_and_sentences(spark):
    doc = (
        "RFC 9000 x\n\n1.  Intro\n\nThe client MUST send a packet. It\n   SHOULD NOT wait, see Section 4.1 and [RFC2119], Section 3. "
        "The client MUST send a packet.\n\n1.1.  Scope\ntext. Servers MAY reply as RFC 7 says.\n\n3.  Figure 2\n\n2.  Body\n\n1.2.  Back\n\n1.  Back\n"
    )
    s = documents.parse_sections(spark.createDataFrame([("d", doc)], "doc string, text string"))
    assert rows(s, "number", "title", "start_line") == [("1", "Intro", 2), ("1.1", "Scope", 7), ("2", "Body", 12)]
    assert rows(documents.extract_normative(s), "section", "keyword") == [("1", "MUST"), ("1", "SHOULD NOT"), ("1.1", "MAY")]
    refs = rows(documents.extract_cross_refs(s), "source_section", "target_doc", "target_section")
    assert refs == [("1", "rfc2119", "3"), ("1", None, "4.1"), ("1.1", "rfc7", None)]
    context = documents.extract_cross_refs(s).filter("target_doc = 'rfc2119'").first()["context"]
    assert "see Section 4.1 and [RFC2119], Section 3. The client" in context


def test_requirement_sentences(spark):
    text = "First. It SHALL do.  You MUST NOT go. MAY open"
    got = documents.extract_requirement_sentences(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert rows(got, "text", "level", "offset") == [("It SHALL do.", "MUST", 6), ("You MUST NOT go.", "MUST NOT", 19)]


def test_logs(spark):
    lines = [
        "x.spec: line 3: error: bad thing", "x.spec: line 3: error: bad thing", "pkg.ToolError: f.spec: line 9: nope",
        "a/b.cpp:4:5: fatal error: oops", "y.spec:7: warning: w", "FileNotFoundError: gone", "Isolate iso1:",
        "The following properties are to be checked:", " f.spec: line 4: inv ... PASS",
        "The following program assertions are treated as guarantees:", "in action go when called from env:",
        " f.spec: line 5: g ... FAIL", "The following initializers are present:", " f.spec: line 6: z ... FAIL",
        "Isolate iso2 :", " f.spec: line 7: a ... PASS", "isolate foo : OK",
    ]
    log = spark.createDataFrame([("L", i, t) for i, t in enumerate(lines)], "log_id string, line_no int, text string")
    assert rows(logs.parse_diagnostics_log(log), "line_no", "file", "line", "severity", "source") == [
        (0, "x.spec", 3, "error", "checker"), (2, "f.spec", 9, "error", "runtime_error"),
        (3, "a/b.cpp", 4, "error", "compiler"), (4, "y.spec", 7, "warning", "checker"), (5, "", 0, "error", "exception"),
    ]
    checks = logs.parse_check_results(log)
    assert rows(checks, "isolate", "check_type", "action", "line", "result") == [
        ("iso1", "guarantee", "go when called from env", 5, "FAIL"), ("iso1", "property", None, 4, "PASS"),
    ]
    assert logs.check_headline(checks).first()["summary"] == "1/2 checks failed in 1 isolates, most in iso1"
    assert rows(logs.parse_isolate_status(log), "isolate", "passed") == [("foo", True)]


def test_log_lines_are_parsed_in_one_pass(spark):
    lines = ["Isolate i1:", "The following properties are to be checked:", "\tf.x: line 1: p ... FAIL \r", "g.x: line 2: q ... PASS", "Errors", "f.x: line 3: error:"]
    log = spark.createDataFrame([(k, i, t) for k in "ab" for i, t in enumerate(lines)], "log_id string, line_no int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    found = logs.parse_diagnostics_log(log)
    assert rows(found, "log_id", "line_no", "file", "message") == [("a", 5, "f.x", ""), ("b", 5, "f.x", "")]
    assert "Generate" in plan(found) and "Join" not in plan(checks := logs.parse_check_results(log))
    head = logs.check_headline(checks)
    assert "Join" not in plan(head)
    assert rows(head.drop("summary")) == [(k, 2, 1, 1, "property", 1, "i1") for k in "ab"]


def test_counterexamples(spark):
    text = (
        "The following assertion at line 12 is not always true:\n  require pkt > 0\nCounterexample:\n  Step 1:\n    Action: send\n"
        "    x = 1\n    x = 2\n  Step 2:\n    y.z = true"
    ).split("\n")
    log = spark.createDataFrame(
        [("L", i, t) for i, t in enumerate(text)] + [("M", 0, "Counterexample:"), ("N", 0, "fine")],
        "log_id string, line_no int, text string",
    )
    got = rows(logs.parse_counterexamples(log), "log_id", "assertion_line", "assertion", "step_number", "action", "assignments")
    assert got == [
        ("L", 12, "require pkt > 0", 1, "send", {"x": "2"}), ("L", 12, "require pkt > 0", 2, None, {"y.z": "true"}),
        ("M", None, None, None, None, {}),
    ]


PATTERNS = """include a
object frame = {
  type this
  object ack = {
    variant this of frame = struct { a : t, b : u.arr }
  }
}
object packet = {
  type this = struct {
     payload : frame.arr,
     n : nat
  }
}
module mm(a, b) = {
}
instance sd : serdes(packet, data, my_ser, other)
implement net.recv(x:t) {
}
export action go
<<< impl
 enum { s0, s1 } state;
 class my_ser : public lib_binary_ser_128 { setn(1); recv(x);
 if (tag == 0) { frame_type = 0x01; }
>>>
"""


def test_patterns(spark, files):
    f = files(("f", PATTERNS))
    p = patterns.detect_patterns(f).cache()
    got = rows(p, "kind", "subtype", "line", "name")
    for want in [
        ("entity", "entity", 1, "frame"), ("variants", "struct_object", 7, "packet"), ("module", "definition", 13, "mm"),
        ("serdes", "serializer", 19, "my_ser"), ("shim", "recv_handler", 16, "net.recv"), ("shim", "socket_operations", 19, "socket_ops"),
        ("monitors", "export", 18, "export.go"), ("include_chain", "include_chain", 0, "includes"),
    ]:
        assert want in got
    assert rows(patterns.pattern_crossref(p), "finding", "related") == [
        ("export_without_monitor", "go"), ("module_without_instance", "mm"), ("unknown_deserializer", "other"),
    ]
    types = spark.createDataFrame([("packet",)], "t string")
    assert rows(patterns.find_variants(p, f, types), "member", "is_array") == [("n", False), ("payload", True)]
    assert rows(patterns.extract_tag_map(f), "tag", "wire_type") == [(0, "0x01")]
    assert rows(patterns.extract_variant_structs(f), "parent", "name") == [("frame", "ack")]


def test_change_impact_of_variant_goes_through_its_struct(spark, files):
    f = files(
        ("a_frame.x", "object frame = {\n  type this\n  object ack = {\n    variant this of frame = struct { n : idx }\n  }\n}"),
        ("b_packet.x", "include a_frame\nobject packet = {\n  type this = struct { payload : frame.arr }\n}"),
        ("c_ser.x", "include b_packet\n<<< impl\nclass my_ser : public lib_binary_ser_128 { setn(1); }\n>>>"),
        ("d_deser.x", "include b_packet\n<<< impl\nclass my_deser : public lib_binary_deser_128 { getn(1); }\n>>>"),
        ("e_wire.x", "include c_ser\ninstance wire : serdes(packet, data, my_ser, my_deser)"),
        ("z.x", "include other"),
    )
    p = patterns.detect_patterns(f).cache()
    got = rows(change_impact(p, f, symbols.extract_includes(f), "frame", "add_variant"), "bucket", "path", "category")
    assert got == [
        ("auto", "a_frame.x", "type_definition"), ("auto", "c_ser.x", "serializer"), ("auto", "d_deser.x", "deserializer"),
        ("manual_review", "b_packet.x", "other"), ("manual_review", "e_wire.x", "other"), ("unaffected", "z.x", None),
    ]
    own = rows(change_impact(p, f, symbols.extract_includes(f), "packet"), "bucket", "path")
    assert [b for b, _ in own].count("auto") == 3 and ("auto", "b_packet.x") in own


def test_word_index_columns(spark, files):
    text = "ab  cd_1(ab)\n\n é ab"
    idx = word_index(files(("f", text)))
    lines = text.split("\n")
    for r in idx.collect():
        assert lines[r["line"]][r["col"]:].startswith(r["word"])
    assert find_references(idx, spark.createDataFrame([("ab",)], "w string")).count() == 3
    plan = rename_plan(idx, spark.createDataFrame([("ab", "zz")], "old string, new string"))
    assert [(r["line"], r["col"]) for r in plan.orderBy("edit_no").collect()] == [(2, 3), (0, 9), (0, 0)]


def test_pattern_queries_scan_texts_once(spark, tmp_path, monkeypatch):
    from factloom.operators import patterns
    from workload import relations
    from workload.registry import QUERIES

    src = str(tmp_path / "src")
    text = "object box = {\n  type this = struct { a : idx, b : fr.arr }\n  object p = {\n    variant this of fr = struct { f : idx }\n  }\n}\n"
    spark.createDataFrame([(f"a{i}.spec", text) for i in range(3)], "path string, content string").write.parquet(src)
    monkeypatch.setattr(relations, "table", lambda spark, sf, name: spark.read.parquet(src))
    monkeypatch.setattr(patterns, "cut_lineage", lambda df: df.localCheckpoint(), raising=False)
    for name, scans in (("find_variants", 2), ("pattern_crossref", 0)):  # members and codes are read from the texts
        got = QUERIES[name](spark, "unused")
        assert got._jdf.queryExecution().executedPlan().toString().count(f"file:{src}") <= scans
        assert name != "find_variants" or {(r.type_name, r.kind, r.tag, r.member) for r in got.collect()} == {
            ("box", "struct", 0, "a"), ("box", "struct", 1, "b"), ("fr", "variant", 0, "p")
        }


def test_scan_check_log_query_writes_zipped_files(spark, tmp_path, monkeypatch):
    from workload import extraction
    from workload.registry import QUERIES

    log = spark.createDataFrame([(f"log{o}", i, f"line {o}.{i}") for o in (1, 255, 256, 700) for i in range(3)], "log_id string, line_no int, text string")
    monkeypatch.setattr(extraction, "table", lambda spark, sf, name: log)
    monkeypatch.setattr(extraction, "scratch", lambda spark, name: str(tmp_path / name))
    got = rows(QUERIES["scan_check_log"](spark, "unused"))
    lines = {0: [(o, i) for o in (1, 255) for i in range(3)], 1: [(256, i) for i in range(3)], 2: [(700, i) for i in range(3)]}
    want = [(b, n, f"line {o}.{i}") for b, ls in lines.items() for n, (o, i) in enumerate(ls)] + [(b, len(ls), "") for b, ls in lines.items()]
    assert got == sorted(want, key=repr)
    parts = [f.name for f in (tmp_path / "scan_check_log").rglob("part-*")]
    assert parts and all(f.endswith(".txt.gz") for f in parts)
