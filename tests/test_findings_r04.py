"""Plans that keep large jobs small, beside the plain ones, on rows of their own."""

import random

from conftest import rows
from pyspark.sql import functions as F

from factloom.operators import coverage, graph, reports, tags
from factloom.operators.patterns import detect_patterns
from factloom.plans import closure, grid, walks
from factloom.plans.closure import reach, reach_others
from factloom.plans.grid import grid_join


def test_reach_others_says_what_reach_says_of_any_seed(spark):
    for seed, nodes in ((1, 6), (2, 12), (3, 30)):
        rnd = random.Random(seed)
        pick = lambda n=nodes, r=rnd: f"n{r.randrange(n)}"
        edges = spark.createDataFrame([(pick(), pick()) for _ in range(nodes)] + [(None, "n1"), ("n2", None)], "src string, dst string")
        seeds = spark.createDataFrame([(pick(),), (pick(),), (pick(),), (None,), ("zz",)], "start string")
        for direction in ("out", "in"):
            want = sorted({r.node for r in reach(edges, seeds, direction).collect()})
            assert [n for (n,) in rows(reach_others(edges, seeds, direction))] == want


def test_change_impact_stores_no_pairs_of_seeds_and_users(spark, monkeypatch):
    """Thirty serializers that a chain of sixty files includes: pairs would be 1,800 rows."""
    kept, cut = [], closure.cut_lineage

    def counted(df):
        df = cut(df)
        kept.append(df.count())
        return df

    monkeypatch.setattr(closure, "cut_lineage", counted)
    includes = [("c0.spec", f"s{i}") for i in range(30)] + [(f"c{i}.spec", f"c{i - 1}") for i in range(1, 60)]
    text = "object box = {{\n  type this = struct {{ a : idx }}\n}}\n<<< impl\nclass ser_{0} : public lib_binary_ser_128 {{ }}\n>>>\ninstance sd{0} : serdes(box, data, ser_{0}, none)"
    files = spark.createDataFrame([(f"s{i}.spec", text.format(i)) for i in range(30)] + [(f"c{i}.spec", "") for i in range(60)], "path string, content string")
    raw = spark.createDataFrame(includes, "from_path string, include_name string")
    got = graph.change_impact(detect_patterns(files), files, raw, "box")
    assert sorted(r.path for r in got.filter("bucket = 'manual_review'").collect()) == sorted(f"c{i}.spec" for i in range(60))
    assert got.filter("category = 'serializer'").count() == 30
    assert max(kept) <= 2 * (30 + 60)


def test_covers_edges_are_written_by_several_tasks(spark, monkeypatch):
    manifest = spark.createDataFrame([(f"r:{i}.{j}",) for i in range(8) for j in range(5)], "req_id string")
    tagged = spark.createDataFrame([(f"i{n}", [f"r:{n % 8}"]) for n in range(64)], "id string, tags array<string>")
    want = sorted((f"i{n}", f"r:{n % 8}.{j}") for n in range(64) for j in range(5))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p"), "dst").select("p").distinct().count()
    edges = tags.wire_covers(tagged, manifest)
    assert rows(edges, "src", "dst") == want and tasks(edges) > 1
    # one set of tags for all rows
    one = tagged.withColumn("tags", F.array(F.lit("r:1")))
    monkeypatch.setattr(tags, "TASK_ROWS", 4)
    edges = tags.wire_covers(one, manifest)
    assert rows(edges, "src", "dst") == sorted((f"i{n}", f"r:1.{j}") for n in range(64) for j in range(5)) and tasks(edges) > 1


def test_grid_join_deals_hot_keys_over_tasks(spark):
    rnd = random.Random(4)
    left = [(rnd.choice(["hot", "hot", "cold", None, f"k{n}"]), n % 150) for n in range(200)]
    right = [(rnd.choice(["hot", "hot", "cold", None]), n % 70) for n in range(90)]
    one, two = spark.createDataFrame(left, "key string, a int"), spark.createDataFrame(right, "key string, b int")
    want = sorted(((k, a, b) for k, a in left for j, b in right if k is not None and k == j), key=repr)
    for cell in (7, 100, 1 << 22):
        got = grid_join(one, two, "key", ["a"], ["b"], cell)
        assert rows(got, "key", "a", "b") == want


def test_matrix_of_one_hot_tag_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(grid.grid_join, "__defaults__", (100,))
    places = spark.createDataFrame([(f"p{n}", n, ["7"]) for n in range(40)], "path string, line int, tags array<string>")
    manifest = spark.createDataFrame([(f"r:7.{n}",) for n in range(40)], "req_id string")
    manifest = manifest.select("req_id", *[F.lit("").alias(c) for c in ("rfc", "section", "level", "text")])
    matrix = coverage.traceability_matrix(manifest, places)
    tasks = matrix.filter("covered").select(F.spark_partition_id().alias("p"), "path", "req_id", "line")
    assert tasks.select("p").distinct().count() > 1
    assert tasks.select("path", "req_id").distinct().count() == tasks.count() == 1600


def test_walks_find_what_rounds_find(spark, monkeypatch):
    """Groups of a few starts, taken apart early, over text and numbers, cycles, loops, nulls, starts without edges and a limit of rounds."""
    monkeypatch.setattr(walks, "TOGETHER", 3)
    monkeypatch.setattr(walks, "PAIRS", 5)
    for seed in (1, 2):
        rnd = random.Random(seed)
        edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)] + [(3, 3), (None, 1), (2, None), (1, 2), (2, 1)]
        asked = [(n,) for n in (*range(12), 1, 77, None)]
        for kind, text in (("long", False), ("int", False), ("string", True)):
            say = (lambda x: None if x is None else f"é{x}") if text else (lambda x: x)
            df = spark.createDataFrame([(say(a), say(b)) for a, b in edges], f"src {kind}, dst {kind}")
            seeds = spark.createDataFrame([(say(n),) for (n,) in asked], f"start {kind}")
            for direction, most in (("out", None), ("in", 2)):
                got = reach(df, seeds, direction, most)
                assert [f.dataType.simpleString() for f in got.schema] == [kind.replace("long", "bigint")] * 2 + ["int"]
                frm, to = ("src", "dst") if direction == "out" else ("dst", "src")
                step = df.select(F.col(frm).alias("node"), F.col(to).alias("next")).filter("node <> next").distinct()
                want = closure._reach_by_rounds(step, seeds.distinct(), most)
                assert rows(got, "start", "node", "hops") == rows(want, "start", "node", "hops")


def test_a_closure_shuffles_and_stores_no_pairs_but_its_result(spark, monkeypatch):
    kept, cut = [], walks.cut_lineage

    def counted(df):
        df = cut(df)
        kept.append(df.count())
        return df

    for module in (closure, walks):
        monkeypatch.setattr(module, "cut_lineage", counted)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    found = reach(chain)
    assert found.count() == 60 * 61 // 2
    assert max(kept) <= 61
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_of_scopes_come_after_their_names(spark):
    reqs = spark.createDataFrame(
        [("a", "send", "require", "before", "p")] * 3 + [("a", "drop", "ensure", "after", "q"), ("b", "send", "require", "before", "p"), ("b", None, "assert", "after", "p"), ("b", "send", None, "after", "p")],
        "path string, monitor_action string, kind string, mixin_kind string, formula_text string",
    )
    members = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "b"), (None, "a")], "scope_file string, member_path string")
    names = spark.createDataFrame([("s", "send", "export"), ("s", "send", "import"), ("s", "drop", "import"), ("t", "send", "import"), (None, "send", "export")], "scope_file string, name string, direction string")
    got = reports.scoped_nct_counts(reqs, members, names)
    assert rows(got, "scope_file", "action", "kind", "n") == sorted(
        [("s", "send", "require", 4), ("s", "send", None, 1), ("s", "drop", "ensure", 1), ("t", "send", "require", 1), ("t", "send", None, 1)], key=repr
    )
    assert rows(reports.scoped_counts(reqs, members, names), "scope_file", "action", "kind", "n") == [("s", "send", "require", 4), ("s", "send", None, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan  # counts stay together until the scopes that do not know a name are gone


def test_members_of_scopes_are_kept_in_columns(spark, tmp_path):
    from workload import questions

    parts = [(k, f"part {k}", "Brand#1", "STD", k % 50) for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    members = questions._members(spark, str(tmp_path))
    assert members.count() == members.distinct().count() > 10
    assert members.inputFiles()  # a table; a checkpoint has none
