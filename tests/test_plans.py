"""Helpers against brute force on small random inputs."""

import random
import re
from itertools import accumulate

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import lint
from factloom.operators.graph import detect_cycles, scope_partitions
from factloom.operators.resolve import near_miss
from factloom.operators.tags import resolve_tags
from factloom.plans.bitsets import count_through, counts_through
from factloom.operators.resolve import resolve_closest
from factloom.plans.closure import reach, reach_least
from factloom.plans.keyed import fill_forward, pick_first, pick_last, running_total, top_per_key


def test_fill_forward_over_chunk_borders(spark):
    rnd = random.Random(1)
    data = [(k, i, rnd.choice([None, None, None, i])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    for inclusive in (True, False):
        got = fill_forward(df, ["k"], ["i"], {"f": F.col("v")}, chunk=F.floor(F.col("i") / 7), inclusive=inclusive)
        want = []
        for k in "ab":
            last = None
            for kk, i, v in data:
                if kk != k:
                    continue
                before = last
                last = v if v is not None else last
                want.append((k, i, last if inclusive else before))
        assert rows(got, "k", "i", "f") == sorted(want, key=repr)


def test_fill_forward_scans_short_keys_once(spark):
    df = spark.createDataFrame([(k, i, i if i % 3 == 0 else None) for k in "ab" for i in range(1, 8)], "k string, i int, v int")
    short = fill_forward(df, ["k"], ["i"], {"f": F.col("v")})
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()  # no tails of chunks, so no second pass
    want = [(k, i, i - i % 3 or None) for k in "ab" for i in range(1, 8)]
    assert rows(short, "k", "i", "f") == sorted(want, key=repr)
    far = spark.createDataFrame([("a", (1 << 16) * n + 5, None) for n in (1, 3)] + [("c", -1, 4), ("c", 0, None)], "k string, i int, v int")
    want += [("a", (1 << 16) * n + 5, 6) for n in (1, 3)] + [("c", -1, 4), ("c", 0, 4)]
    assert rows(fill_forward(df.unionByName(far), ["k"], ["i"], {"f": F.col("v")}), "k", "i", "f") == sorted(want, key=repr)


def test_fill_forward_keeps_null_inside_struct_as_reset(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "reset"), (3, None)], "i int, v string")
    value = F.when(F.col("v") == "reset", F.struct(F.lit(None).cast("string").alias("x"))).when(
        F.col("v").isNotNull(), F.struct(F.col("v").alias("x"))
    )
    got = fill_forward(df.withColumn("k", F.lit(1)), ["k"], ["i"], {"f": value}, chunk=F.col("i"))
    assert [r["x"] for r in got.orderBy("i").select("f.x").collect()] == ["a", "a", None, None]


def test_running_total_over_chunk_borders(spark):
    rnd = random.Random(2)
    data = [("k", i, rnd.randint(-3, 3)) for i in range(150)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = running_total(df, ["k"], ["i"], {"s": F.col("v")}, chunk=F.floor(F.col("i") / 11))
    want = list(accumulate(v for _, _, v in data))
    assert [r["s"] for r in got.orderBy("i").collect()] == want


def test_pick_and_top(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows(pick_first(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, "z")]
    assert rows(pick_last(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 5, "z")]
    assert rows(top_per_key(df, ["k"], [F.col("o")], 1), "k", "o", "rank") == [("a", 1, 1), ("b", 5, 1)]


def _closure(edges, starts):
    out = set()
    for s in starts:
        seen, todo = set(), [s]
        while todo:
            n = todo.pop()
            for a, b in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(s, n) for n in seen if n != s}
    return out


def test_reach_excludes_start_and_survives_cycles(spark):
    rnd = random.Random(3)
    for _ in range(3):
        edges = {(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(14)} | {(0, 1), (1, 0), (2, 2)}
        df = spark.createDataFrame(sorted(edges), "src int, dst int")
        seeds = spark.createDataFrame([(0,), (2,), (77,)], "n int")
        assert set(rows(reach(df, seeds), "start", "node")) == _closure(edges, [0, 2, 77])
        back = {(b, a) for a, b in edges}
        assert set(rows(reach(df, seeds, "in"), "start", "node")) == _closure(back, [0, 2, 77])


def test_reach_goes_over_numbers_where_nodes_are_texts(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("d",), ("none",)], "n string")
    got = reach(df, seeds)
    assert rows(got) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(reach(df, seeds, "in"), "start", "node", "hops") == [
        ("a", "b", 2), ("a", "c", 1), ("d", "a", 3), ("d", "b", 2), ("d", "c", 1),
    ]
    assert rows(reach(df, seeds, max_rounds=0)) == []
    assert [t for c, t in got.dtypes] == ["string", "string", "int"]
    stored = [x for x in got._jdf.queryExecution().analyzed().toString().split("\n") if "LogicalRDD" in x and "hops" in x]
    assert stored and all(re.search(r"start#\d+L, node#\d+L", x) for x in stored)  # long, not text


def test_reach_hops_and_rounds(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "n int")
    assert rows(reach(df, seeds, max_rounds=3), "node", "hops") == [(1, 1), (2, 2), (3, 3)]
    assert reach(df, seeds).count() == 20
    assert reach(df, spark.createDataFrame([(99,)], "n int")).count() == 0


def test_detect_cycles(spark):
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")
    assert detect_cycles(dag).count() == 0
    cyc = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (9, 9)], "src int, dst int")
    assert rows(detect_cycles(cyc), "src", "dst") == [(2, 3), (3, 2), (9, 9)]
    known = spark.createDataFrame([(1,), (2,)], "n int")
    assert detect_cycles(cyc, known).count() == 0


def _named(tag, keys):
    if tag in keys:
        return {tag}
    if ":" in tag:
        return {k for k in keys if k.startswith(tag + ".")}
    out = set()
    for k in keys:
        if ":" in k:
            p = k.split(":")[0]
            if k == f"{p}:{tag}" or k.startswith(f"{p}:{tag}."):
                out.add(k)
    return out


def test_resolve_tags_against_prefix_scan(spark):
    rnd = random.Random(4)
    part = lambda: ".".join(str(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 3)))
    keys = {f"r{rnd.randint(1, 3)}:{part()}" for _ in range(40)} | {"plain", "7.2", "a:b:c.d"}
    tags = {part() for _ in range(30)} | {f"r{rnd.randint(1, 4)}:{part()}" for _ in range(40)}
    tags |= {"plain", "7", "a:b:c", "b:c", "none"} | set(list(keys)[:5])
    got = resolve_tags(
        spark.createDataFrame([(t,) for t in tags], "tag string"),
        spark.createDataFrame([(k,) for k in keys], "req_id string"),
    )
    assert set(rows(got, "tag", "key")) == {(t, k) for t in tags for k in _named(t, keys)}


def _distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("few", [0, 1, 32])
def test_near_miss_against_all_pairs(spark, few):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("ab_") for _ in range(rnd.randint(1, 7)))
    names, stems = {word() for _ in range(60)}, {word() for _ in range(25)}
    got = dict(
        rows(
            near_miss(
                spark.createDataFrame([(n,) for n in names], "n string"),
                spark.createDataFrame([(s,) for s in stems], "s string"),
                few,
            )
        )
    )
    for n in names:
        same = [s for s in stems if s != n and set(s.split("_")) == set(n.split("_"))]
        near = [s for s in stems if s != n and _distance(n, s) <= 2]
        assert got[n] == (min(same) if same else min(near) if near else None), n


def test_count_through(spark):
    rnd = random.Random(6)
    owners = {(f"o{rnd.randint(0, 5)}", f"h{rnd.randint(0, 6)}") for _ in range(20)}
    items = {(f"h{rnd.randint(0, 6)}", f"i{rnd.randint(0, 30)}") for _ in range(60)}
    o, i = spark.createDataFrame(sorted(owners), "o string, h string"), spark.createDataFrame(sorted(items), "h string, i string")
    want = {}
    for own, hub in owners:
        want.setdefault(own, set()).update(x for h, x in items if h == hub)
    for dense, fan in ((1, 1), (1, 3), (3, 1), (3, 2), (5, 1), (256, 64)):
        got = count_through(o, i, "o", "h", "i", "n", dense, fan)
        assert dict(rows(got)) == {k: len(s) for k, s in want.items() if s}, (dense, fan)


def test_counts_through_two_columns_and_a_heavy_hub(spark):
    """A hub that most owners and items go through, null values, and a value that stands under many hubs."""
    rnd = random.Random(8)
    owners = {(o, "hot") for o in range(30)} | {(o, f"h{rnd.randint(0, 5)}") for o in range(40)}
    items = [("hot", i, f"f{i % 7}") for i in range(400)] + [(f"h{rnd.randint(0, 5)}", rnd.randint(0, 600), None) for _ in range(300)]
    o = spark.createDataFrame(sorted(owners), "o int, h string")
    i = spark.createDataFrame(items, "h string, i int, f string")
    want = {}
    for own, hub in owners:
        for h, item, file in items:
            if h == hub:
                ids, files = want.setdefault(own, (set(), set()))
                ids.add(item)
                files |= {file} - {None}
    for dense, fan in ((256, 64), (16, 8), (1, 1)):
        got = counts_through(o, i, "o", "h", {"n": "i", "m": "f"}, dense, fan)
        assert {r.o: (r.n, r.m) for r in got.collect()} == {k: (len(a), len(b)) for k, (a, b) in want.items()}


def test_scope_partitions_is_greedy_by_name(spark):
    rnd = random.Random(7)
    members = {(f"t{s:02d}", f"d{rnd.randint(0, 2)}/c{stem}.x") for s in range(14) for stem in range(3) if rnd.random() < 0.6}
    members |= {(f"t{s:02d}", f"own{s}.x") for s in range(14)}
    need = {}
    for s, p in members:
        if "/" in p:
            need.setdefault(s, {}).setdefault(p.split("/")[1], set()).add(p)
    colours = {}
    for s in sorted({s for s, _ in members}):
        rivals = {
            o for o in colours for stem, mine in need.get(s, {}).items()
            for theirs in [need.get(o, {}).get(stem, set())] if any(a != b for a in mine for b in theirs)
        }
        c = 0
        while c in {colours[o] for o in rivals}:
            c += 1
        colours[s] = c
    got = scope_partitions(
        spark.createDataFrame(sorted(members), "scope_file string, member_path string"),
        spark.createDataFrame([("c0",), ("c1",), ("c2",)], "stem string"),
    )
    assert dict(rows(got)) == {s: f"partition_{c}" for s, c in colours.items()}


@pytest.mark.parametrize("sizes", [(2048, 8192), (5, 3)])
def test_scope_partitions_rounds_do_not_grow_with_rivals(spark, monkeypatch, sizes):
    from factloom.operators import graph

    rnd = random.Random(3)
    members = {(f"t{s:03d}", f"d{rnd.randint(0, 20)}/c{rnd.randint(0, 3)}.x") for s in range(60) for _ in range(rnd.randint(0, 3))}
    members |= {(f"t{s:03d}", f"own{s}.x") for s in range(60)}
    need = {s: {} for s, _ in members}
    for s, p in members:
        if "/" in p:
            need[s].setdefault(p.split("/")[1], set()).add(p)
    leader, colours = {}, {}  # scopes that need the same files are one
    for s in sorted(need):
        same = leader.setdefault(frozenset(p for v in need[s].values() for p in v), s)
        rivals = {
            o for o in colours for stem, mine in need[s].items() if any(a != b for a in mine for b in need[o].get(stem, ()))
        } if same == s else ()
        taken = {colours[o] for o in rivals}
        colours[s] = next(c for c in range(99) if c not in taken) if same == s else colours[same]
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: cuts.append(df) or df.localCheckpoint())
    got = scope_partitions(
        spark.createDataFrame(sorted(members), "scope_file string, member_path string"),
        spark.createDataFrame([(f"c{i}",) for i in range(4)], "stem string"),
        *sizes,
    )
    assert max(colours.values()) > 9
    assert dict(rows(got)) == {s: f"partition_{c}" for s, c in colours.items()}
    if sizes[0] > 60:
        assert len(cuts) == 5  # one round


def test_dirty_expand_keeps_nodes_not_pairs(spark, monkeypatch):
    from factloom.operators.graph import dirty_expand
    from factloom.plans import closure

    sizes = []
    monkeypatch.setattr(closure, "cut_lineage", lambda df: sizes.append(df.localCheckpoint()) or sizes[-1])
    chain = [(f"n{i + 1}", f"n{i}") for i in range(6)] + [("n0", "n6")]
    edges = spark.createDataFrame(chain + [("n0", f"s{i}") for i in range(40)] + [("x", "y")], "from_path string, to_path string")
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(40)], "path string")
    got = dirty_expand(seeds, edges, 100)
    assert rows(got) == sorted([(f"n{i}",) for i in range(7)] + [(f"s{i}",) for i in range(40)])
    assert max(df.count() for df in sizes) == 48  # the edges; 40 * 7 pairs of a seed and a node before
    assert dirty_expand(seeds, edges, 50) is None


def test_resolve_closest_never_broadcasts(spark, tmp_path):
    spark.createDataFrame([(f"a/b{i % 3}/c/x{i % 2}.spec",) for i in range(6)], "path string").write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([("a/b1/z.spec", "x0"), ("q.spec", "x1"), ("q.spec", "none")], "from_path string, include_name string").write.parquet(str(tmp_path / "i"))
    got = resolve_closest(spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "f")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [("a/b1/z.spec", "x0", "a/b1/c/x0.spec"), ("q.spec", "none", None), ("q.spec", "x1", "a/b0/c/x1.spec")]


def test_running_offsets(spark):
    data = [list(range(n)) for n in (0, 1, 63, 64, 65, 300)]
    df = spark.createDataFrame([(d,) for d in data], "a array<int>")
    got = [r[0] for r in df.select(T.running_offsets(F.col("a"))).collect()]
    assert got == [[sum(d[:i]) for i in range(len(d))] for d in data]


def test_search_scoped_ranks_all_hits(spark):
    from factloom.operators.navigate import search_scoped

    symbols = spark.createDataFrame(
        [(f"f{i}.spec", f"m.ring{i:04}", 1) for i in range(1500)], "path string, qualified_name string, line int"
    )
    visible = spark.createDataFrame([("a.spec", "f1400.spec")], "from_path string, path string")
    layers = spark.createDataFrame([], "path string, layer string")
    found = search_scoped(symbols, "ring", "a.spec", visible, layers)
    assert found.count() == 1500 and found.first().path == "f1400.spec"


def test_edges_of_one_set_of_tags_are_not_shuffled(spark):
    from factloom.operators import coverage, tags

    tagged = spark.createDataFrame(
        [("a", ["r:1", "1"]), ("a", ["r:1", None]), ("b", ["1", "r:1"]), ("c", []), ("d", None), ("e", ["q:9"]), (None, ["r:1.2"])], "id string, tags array<string>"
    )
    manifest = spark.createDataFrame([("r:1.1",), ("r:1.2",), ("s:1.3",), ("s:2",)], "req_id string")
    edges = tags.wire_covers(tagged, manifest)
    want = [(i, k) for i in "ab" for k in ("r:1.1", "r:1.2", "s:1.3")] + [(None, "r:1.2")]
    assert sorted(((r["src"], r["dst"]) for r in edges.collect()), key=repr) == sorted(want, key=repr)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project") and plan.splitlines()[1].lstrip("+- ").startswith("Join Inner")
    assert sorted(((r["src"], r["dst"]) for r in tags.first_covers(tagged, manifest).collect()), key=repr) == [("a", "r:1.1"), ("b", "r:1.1"), (None, "r:1.2")]
    places = spark.createDataFrame([("p", 1, ["r:1"]), ("p", 2, ["r:1", "s:2"])], "path string, line int, tags array<string>")
    manifest = manifest.select("req_id", *[F.lit("").alias(c) for c in ("rfc", "section", "level", "text")])
    matrix = coverage.traceability_matrix(manifest, places)
    assert sorted((r["req_id"], r["line"] or 0, r["covered"]) for r in matrix.collect()) == [
        ("r:1.1", 1, True), ("r:1.1", 2, True), ("r:1.2", 1, True), ("r:1.2", 2, True), ("s:1.3", 0, False), ("s:2", 2, True),
    ]
    assert matrix._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_log_lines_are_numbered_before_they_are_made(spark, tmp_path):
    from workload import derived

    items = [(o, n, p, s, f, "O") for o in range(1, 4) for n, p, s, f in ((1, 9, 3, "A"), (1, 7, 4, "N"), (1, 7, 5, "R"), (3, 1, 1, "A"), (2, 8, 2, "R"))]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = spark.sql(derived._spark_sql(spark, "log", str(tmp_path)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    places = {t: f"parquet.`{tmp_path}/{t}.parquet`" for t in derived.TABLES} | {"numbers_to_6": "explode(sequence(0, 6))"}
    want = spark.sql(derived._fill(derived.DERIVED["log"], places))
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want) and got.count() == 84
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 1


def test_reads_are_dealt_once_as_numbers(spark, tmp_path, monkeypatch):
    from workload import derived
    from workload.derived import DERIVED, SPARK_FORM, _spark_sql

    items = [(o, n, s) for o in (1, 2, 1250, 1251, 2500) for n in (1, 2, 7) for s in (1, 2, 4, 2496)] * 2
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = spark.sql(_spark_sql(spark, "reads", str(tmp_path)))
    want = spark.sql(DERIVED["reads"].replace("{lineitem}", f"parquet.`{tmp_path}/lineitem.parquet`"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert "reads" in SPARK_FORM and plan(got) == 1 < plan(want)
    assert rows(got) == rows(want)
    monkeypatch.setattr(derived, "TASK_ROWS", 20)  # 120 line items
    more = spark.sql(_spark_sql(spark, "reads", str(tmp_path)))
    assert more.rdd.getNumPartitions() == 6 and rows(more) == rows(want)


def test_constrains_tasks_are_bounded(spark, monkeypatch):
    from factloom.operators import wiring

    monkeypatch.setattr(wiring, "TASK_ROWS", 10)
    reqs = spark.createDataFrame([(f"r{i % 90}", f"a{i % 30}") for i in range(100)] + [("r1", ""), ("r2", None)], "id string, monitor_action string")
    got = wiring.wire_constrains(reqs)
    assert rows(got) == sorted((f"r{i}", "CONSTRAINS", f"a{i % 30}") for i in range(90))
    assert got.rdd.getNumPartitions() == 11


def _first_bringers(edges, asked):
    out = {}
    for path in asked:
        for line, name, to in sorted(e[1:] for e in edges if e[0] == path):
            seen, todo = {to}, [to]
            while todo:
                at = todo.pop()
                new = {e[3] for e in edges if e[0] == at} - seen
                seen |= new
                todo += new
            for node in seen:
                out.setdefault((path, node), (line, name))
    return sorted((p, *i, n) for (p, n), i in out.items())


def test_first_bringer_takes_files_in_include_order_or_falls_back_on_a_cycle(spark, monkeypatch):
    rnd = random.Random(5)
    dag = [(f"f{a}", line, f"n{rnd.randrange(3)}", f"f{rnd.randrange(a)}") for a in range(1, 12) for line in (1, 2, 2)]
    dag += [("f7", 9, "n0", "f7"), ("f1", 3, "gone", "out")]
    asked = [f"f{a}" for a in range(0, 12, 2)] + ["f7"]
    closures = []
    monkeypatch.setattr(lint, "reach", lambda *a: closures.append(1) or reach(*a))
    for edges, fallbacks in ((dag, 0), ([*dag, ("f0", 4, "n1", "f9")], 1), ([], 0)):
        includes = spark.createDataFrame(edges, "from_path string, line int, include_name string, to_path string")
        files = spark.createDataFrame([(a,) for a in asked], "path string")
        got = lint.first_bringer(includes, files)
        assert rows(got, "path", "line", "include_name", "brought") == sorted(_first_bringers(edges, asked), key=repr)
        assert len(closures) == fallbacks
        closures.clear()


def test_least_rank_over_paths_of_unlike_length(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], "node long, next long")
    seeds = spark.createDataFrame([(7, 4, 2), (7, 1, 1), (8, 5, 1), (8, 3, 3)], "start long, node long, rank long")
    want = [(7, n, 1) for n in (1, 2, 3, 4, 5)] + [(8, 3, 3), (8, 4, 3), (8, 5, 1)]
    assert rows(reach_least(edges, seeds), "start", "node", "least") == want
