"""Action reports on literal rows."""

from conftest import rows

from factloom.operators import reports


def _actions(spark):
    return spark.createDataFrame(
        [("a1", "send", "net.send", "x/a.spec", 1), ("a2", "recv", "net.recv", "y/a.spec", 2), ("a3", "drop", "q.drop", "y/b.spec", 3)],
        "id string, name string, qualified_name string, path string, line int",
    )


def test_select_actions(spark):
    actions = _actions(spark)
    members = spark.createDataFrame([("t", "y/a.spec"), ("t", "y/b.spec")], "scope_file string, member_path string")

    def ids(**asked):
        return sorted(r.id for r in reports.select_actions(actions, members, **asked).collect())

    assert ids() == ["a1", "a2", "a3"]
    assert ids(scope="t") == ["a2", "a3"]
    assert ids(scope="no such scope") == ["a1", "a2", "a3"]
    assert ids(action="net.send") == ids(action="send") == ids(action="a1") == ["a1"]
    assert ids(path="y/a.spec") == ["a2"]
    assert ids(path="a.spec") == ids(path="else/a.spec") == ["a1", "a2"]
    assert ids(scope="t", path="x/a.spec") == ["a2"]  # its exact file is out of the scope, so the base name decides
    assert ids(corpus="y/", scope="t", action="drop") == ["a3"]
    assert ids(action="none") == []


def _facts(spark):
    reqs = spark.createDataFrame(
        [
            ("r1", "a.spec", 1, "require", "before", "a1", "p", ["t:1", "t:2"]),
            ("r2", "a.spec", 2, "ensure", "after", "a1", "q" * 201, ["t:2"]),
            ("r3", "b.spec", 3, "assert", "direct", "a2", "r" * 200, []),
        ],
        "id string, path string, line int, kind string, mixin_kind string, monitor_action string, formula_text string, tags array<string>",
    )
    reads = spark.createDataFrame([("r1", "v"), ("r2", "v"), ("r2", "w")], "id string, var string")
    writes = spark.createDataFrame([("a.spec", "u"), ("a.spec", "v"), ("c.spec", "w")], "path string, var string")
    return reqs, reads, writes


def test_action_report(spark):
    members = spark.createDataFrame([("t", "y/a.spec"), ("t", "x/a.spec")], "scope_file string, member_path string")
    names = spark.createDataFrame([("t", "send", "import"), ("u", "send", "export")], "scope_file string, name string, direction string")
    facts = _facts(spark)
    full = reports.action_report(_actions(spark), *facts)
    assert rows(full, "id", "before", "after", "direct", "require", "assert", "requirements", "vars_read", "vars_written", "tags") == [
        ("a1", 1, 1, 0, 1, 0, 2, 2, 2, 2), ("a2", 0, 0, 1, 0, 1, 1, 0, 0, 0), ("a3", 0, 0, 0, 0, 0, 0, 0, 0, 0),
    ]
    assert rows(full, "direction", "total", "has_more") == [(None, 3, False)] * 3
    page = reports.action_report(_actions(spark), *facts, members, names, "t", limit=1)
    assert rows(page, "id", "direction", "total", "has_more") == [("a1", "RECEIVED", 2, True)]
    page = reports.action_report(_actions(spark), *facts, members, names, "t", offset=1, limit=1)
    assert rows(page, "id", "direction", "total", "has_more") == [("a2", "INTERNAL", 2, False)]
    assert reports.action_report(_actions(spark), *facts, offset=9, limit=5).count() == 0


def test_formulas_and_variables_of_actions(spark):
    reqs, reads, writes = _facts(spark)
    shown = reports.action_requirements(_actions(spark), reqs)
    assert rows(shown, "id", "formula") == [("r1", "p"), ("r2", "q" * 200 + "..."), ("r3", "r" * 200)]
    assert rows(reports.action_requirements(_actions(spark), reqs, None).filter("id = 'r2'"), "formula") == [("q" * 201,)]
    found = reports.action_variables(_actions(spark), reqs, reads, writes)
    assert rows(found, "action", "access", "var") == [
        ("a1", "read", "v"), ("a1", "read", "w"), ("a1", "written", "u"), ("a1", "written", "v"),
    ]


def test_variable_counts_shuffle_reads_once(spark, tmp_path):
    from factloom.operators.reports import _variable_counts

    for name, data, kind in (
        ("reqs", [(f"r{i}", f"a{i % 2}", f"f{i % 3}") for i in range(6)], "id string, monitor_action string, path string"),
        ("reads", [(f"r{i % 6}", f"x{i % 4}") for i in range(24)] * 3, "id string, var string"),
    ):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}")
    reqs, reads = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("reqs", "reads"))
    got, _ = _variable_counts(reqs, reads, spark.createDataFrame([("f0", "x9")], "path string, var string"))
    want = {}
    for i in range(24):
        want.setdefault(f"a{i % 6 % 2}", set()).add(f"x{i % 4}")
    assert {r.id: r.vars_read for r in got.collect()} == {a: len(v) for a, v in want.items()}
    # no aggregate of the reads by themselves: the distinct pairs of action and variable are enough
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [id#") == 0
