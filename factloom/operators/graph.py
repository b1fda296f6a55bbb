"""Closures, scopes, impact and shared-state views over include and fact edges."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import stem_of
from factloom.operators.patterns import categorize_file, containing_structs, find_variants, serdes_correlation
from factloom.plans.bitsets import count_through
from factloom.plans.closure import reach, reach_any, reach_others
from factloom.plans.lineage import cut_lineage


def transitive_closure(
    edges: DataFrame, seeds: DataFrame | None = None, direction: str = "out", max_rounds: int | None = None
) -> DataFrame:
    """``(start, node, hops)`` reachable pairs; see ``plans.closure.reach``."""
    return reach(edges, seeds, direction, max_rounds)


def _include_edges(includes: DataFrame) -> DataFrame:
    return includes.select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))


def _with_self(closure: DataFrame, seeds: DataFrame) -> DataFrame:
    own = seeds.select(F.col(seeds.columns[0]).alias("start")).distinct()
    return closure.select("start", "node").unionByName(own.withColumn("node", F.col("start")))


def layer_closure(layers: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked layer with itself and everything it depends on."""
    edges = layers.select(F.col("layer").alias("src"), F.explode("depends_on").alias("dst"))
    asked = ids.select(F.col(ids.columns[0]).alias("start"))
    return _with_self(reach(edges, asked), asked).select(
        F.col("start").alias("layer"), F.col("node").alias("visible")
    )


def detect_cycles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The edges left after peeling sources and sinks: empty exactly when there is no cycle.

    Edges to nodes outside ``nodes`` are ignored. A self loop is a cycle.
    """
    live = edges.select("src", "dst").distinct()
    if nodes is not None:
        known = nodes.select(F.col(nodes.columns[0]).alias("dst")).distinct()
        live = live.join(known, "dst", "left_semi").select("src", "dst")
    live = cut_lineage(live)
    size = live.count()
    while size:
        ends = live.select(F.col("src").alias("node"), F.lit(1).alias("side")).unionByName(
            live.select(F.col("dst").alias("node"), F.lit(2).alias("side"))
        )
        both = ends.groupBy("node").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo < hi")
        inner = live.join(both.select(F.col("node").alias("src")), "src", "left_semi")
        live = cut_lineage(inner.join(both.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
        left = live.count()
        if left == size:
            break
        size = left
    return live


# What the behavior files in a closure say about the tester (roles are inverted).
ROLE_MARKS = {"server_behavior": "client", "client_behavior": "server", "mim_behavior": "mim", "man_in_the_middle": "mim"}


def detect_role(scope_members: DataFrame) -> DataFrame:
    """Tester role per scope: mim, else client or server when only one side's behavior is in, else unknown."""
    stem = stem_of(F.col("member_path"))
    behaviour = F.contains(stem, F.lit("_behavior"))
    server = behaviour & F.contains(stem, F.lit("server_behavior"))
    client = behaviour & ~server & F.contains(stem, F.lit("client_behavior"))
    mim = behaviour & ~server & ~client & (
        F.contains(stem, F.lit("mim_behavior")) | F.contains(stem, F.lit("man_in_the_middle"))
    )
    flags = scope_members.groupBy("scope_file").agg(
        F.max(server).alias("s"), F.max(client).alias("c"), F.max(mim).alias("m")
    )
    role = (
        F.when(F.col("m"), "mim")
        .when(F.col("s") & ~F.col("c"), "client")
        .when(F.col("c") & ~F.col("s"), "server")
        .otherwise("unknown")
    )
    return flags.select("scope_file", role.alias("role"))


def scope_members_of(files: DataFrame, includes: DataFrame, exports: DataFrame) -> DataFrame:
    """``(scope_file, member_path)``: every exporting file with its include closure and itself."""
    seeds = (
        exports.filter("direction = 'export'").select("path").distinct()
        .join(files.select("path").distinct(), "path", "left_semi")
    )
    return _with_self(reach(_include_edges(includes), seeds), seeds).select(
        F.col("start").alias("scope_file"), F.col("node").alias("member_path")
    )


def scope_exports(scope_members: DataFrame, exports: DataFrame) -> DataFrame:
    """``(scope_file, name, direction)`` over the closure of each scope."""
    e = exports.select(F.col("path").alias("member_path"), "name", "direction").distinct()
    return scope_members.join(e, "member_path").select("scope_file", "name", "direction").distinct()


def compute_scopes(files: DataFrame, includes: DataFrame, exports: DataFrame) -> DataFrame:
    """One row per exporting file: role, closure size, exported and imported names."""
    members = cut_lineage(scope_members_of(files, includes, exports))
    sizes = members.groupBy("scope_file").agg(F.count("*").alias("file_count"))
    names = scope_exports(members, exports).groupBy("scope_file").agg(
        F.count_if(F.col("direction") == "export").alias("exported_names"),
        F.count_if(F.col("direction") == "import").alias("imported_names"),
    )
    return sizes.join(detect_role(members), "scope_file").join(names, "scope_file")


def tests_for_file(scope_members: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, scope_file)``: the scopes that hold each asked file."""
    asked = files.select(F.col("path").alias("member_path")).distinct()
    return scope_members.join(asked, "member_path", "left_semi").select(
        F.col("member_path").alias("path"), "scope_file"
    ).distinct()


def scope_files_for_file(scope_members: DataFrame, includes: DataFrame, files: DataFrame) -> DataFrame:
    """``(from_path, path)``: union of the scopes that hold a file, or its own closure when none does."""
    held = tests_for_file(scope_members, files)
    by_scope = held.join(scope_members, "scope_file").select(
        F.col("path").alias("from_path"), F.col("member_path").alias("path")
    ).distinct()
    alone = files.select("path").distinct().join(held.select("path").distinct(), "path", "left_anti")
    own = _with_self(reach(_include_edges(includes), alone), alone).select(
        F.col("start").alias("from_path"), F.col("node").alias("path")
    )
    return by_scope.unionByName(own)


def symbols_in_scope(
    symbols: DataFrame, scope_members: DataFrame, includes: DataFrame, files: DataFrame
) -> DataFrame:
    """Symbols that each asked file can see."""
    return scope_files_for_file(scope_members, includes, files).join(symbols, "path")


def active_requirements(reqs: DataFrame, includes: DataFrame, files: DataFrame) -> DataFrame:
    """Requirements of each asked file and of everything it includes, directly or not."""
    seen = _with_self(reach(_include_edges(includes), files.select("path")), files.select("path"))
    return seen.select(F.col("start").alias("for_path"), F.col("node").alias("path")).join(reqs, "path")


# ---- one-hop questions ---------------------------------------------------------------------------


def requirements_for_action(edges: DataFrame, reqs: DataFrame, actions: DataFrame) -> DataFrame:
    """Requirements that constrain each asked action."""
    asked = actions.select(F.col(actions.columns[0]).alias("dst")).distinct()
    e = edges.filter("etype = 'CONSTRAINS'").join(asked, "dst", "left_semi")
    return e.select(F.col("dst").alias("action"), F.col("src").alias("id")).join(reqs, "id")


def state_vars_read_by(edges: DataFrame, state_vars: DataFrame, ids: DataFrame) -> DataFrame:
    """Variables that each asked requirement or property reads."""
    asked = ids.select(F.col(ids.columns[0]).alias("src")).distinct()
    e = edges.filter("etype = 'READS'").join(asked, "src", "left_semi")
    return e.select(F.col("src").alias("reader"), F.col("dst").alias("id")).distinct().join(state_vars, "id")


def requirements_sharing_var(edges: DataFrame, reqs: DataFrame, state_vars: DataFrame) -> DataFrame:
    """Requirements that read each asked variable."""
    asked = state_vars.select(F.col(state_vars.columns[0]).alias("dst")).distinct()
    e = edges.filter("etype = 'READS'").join(asked, "dst", "left_semi")
    return e.select(F.col("dst").alias("var"), F.col("src").alias("id")).distinct().join(reqs, "id")


def properties_on_axiom(edges: DataFrame, properties: DataFrame, axioms: DataFrame) -> DataFrame:
    """Properties that depend on each asked axiom, over variables they share."""
    asked = axioms.select(F.col(axioms.columns[0]).alias("axiom")).distinct()
    via = edges.filter("etype = 'AXIOM'").select(F.col("src").alias("var"), F.col("dst").alias("axiom"))
    via = via.join(asked, "axiom", "left_semi")
    own = edges.filter("etype = 'SHARES'").select(F.col("src").alias("id"), F.col("dst").alias("var"))
    return own.join(via, "var").select("axiom", "id").distinct().join(properties, "id")


def vars_written_by_action(reqs: DataFrame, writes: DataFrame, actions: DataFrame) -> DataFrame:
    """Variables written in any file that holds a requirement on the asked action."""
    asked = actions.select(F.col(actions.columns[0]).alias("action")).distinct()
    held = reqs.select(F.col("monitor_action").alias("action"), "path").distinct().join(asked, "action", "left_semi")
    return held.join(writes.select("path", "var").distinct(), "path").select("action", "var").distinct()


def written_var_counts(reqs: DataFrame, writes: DataFrame) -> DataFrame:
    """``(action, vars_written)`` for all actions, exact, without writing out the pairs."""
    held = reqs.select(F.col("monitor_action").alias("action"), "path")
    return count_through(held, writes, "action", "path", "var", "vars_written")


def impact_of_var(edges: DataFrame, reqs: DataFrame, state_vars: DataFrame) -> DataFrame:
    """Readers of each asked variable, counted by file."""
    return requirements_sharing_var(edges, reqs.select("id", "path"), state_vars).groupBy("var", "path").agg(
        F.count("*").alias("requirements")
    )


# ---- change impact --------------------------------------------------------------------------------


def change_impact(
    patterns: DataFrame,
    files: DataFrame,
    includes_raw: DataFrame,
    type_name: str,
    change_type: str = "add_field",
    all_files: bool = False,
) -> DataFrame:
    """Files that a change of a type touches: ``auto`` (definition, serializer, deserializer),
    ``manual_review`` (reach an auto file through includes, with a category) and ``unaffected``.

    Only files with at least one include are classified, unless ``all_files``. An unknown type gives
    no rows.
    """
    types = patterns.sparkSession.createDataFrame([(type_name,)], "type string")
    shape = find_variants(patterns, files, types).groupBy(F.col("type_name").alias("type")).agg(
        F.min(F.struct("path", "kind")).alias("d")
    )
    edit = "add_field_to_struct" if change_type == "add_field" else "add_variant_case"
    auto = shape.select(
        F.col("d.path").alias("path"), F.lit("type_definition").alias("category"), F.lit(edit).alias("edit")
    )
    pairs = serdes_correlation(patterns, types).select(F.col("message_type").alias("type"), "ser_path", "deser_path")
    # a variant type without instances of its own: the first instance of a struct that holds it
    variant = shape.filter("d.kind = 'variant'").join(pairs, "type", "left_anti").select("type")
    holders = containing_structs(patterns, variant)
    held = serdes_correlation(patterns, holders.select("struct")).withColumnRenamed("message_type", "struct")
    held = held.join(holders, "struct").groupBy("type").agg(
        F.min_by(F.struct("ser_path", "deser_path"), F.struct("instance_path", "instance_line")).alias("s")
    )
    pairs = pairs.unionByName(held.select("type", "s.*").filter("ser_path IS NOT NULL"))
    for side, word, verb in (("ser_path", "serializer", "set"), ("deser_path", "deserializer", "get")):
        auto = auto.unionByName(
            pairs.filter(F.col(side).isNotNull()).select(
                F.col(side).alias("path"), F.lit(word).alias("category"),
                F.lit(f"add_state_and_{verb}_case").alias("edit"),
            )
        )
    auto = cut_lineage(auto.distinct())
    stems = auto.select(stem_of(F.col("path")).alias("start")).distinct()
    includes_raw = cut_lineage(includes_raw.select("from_path", "include_name"))  # read twice; the texts once
    edges = includes_raw.select(stem_of(F.col("from_path")).alias("src"), F.col("include_name").alias("dst"))
    users = reach_others(edges, stems, "in").select(F.col("node").alias("stem"))
    every = files.select("path") if all_files else includes_raw.select(F.col("from_path").alias("path"))
    rest = (
        every.distinct().withColumn("stem", stem_of(F.col("path")))
        .join(auto.select("path").distinct(), "path", "left_anti")
        .join(users.withColumn("_hit", F.lit(True)), "stem", "left")
        .join(categorize_file(patterns), "path", "left")
        .select(
            F.when(F.col("_hit"), "manual_review").otherwise("unaffected").alias("bucket"),
            "path",
            F.when(F.col("_hit"), F.coalesce("category", F.lit("other"))).alias("category"),
            F.lit(None).cast("string").alias("edit"),
        )
    )
    known = auto.filter("category = 'type_definition'").exists()
    return auto.select(F.lit("auto").alias("bucket"), "path", "category", "edit").unionByName(rest).filter(known)


def dirty_expand(
    changed: DataFrame, includes: DataFrame, n_files: int, budget: float = 0.5
) -> DataFrame | None:
    """Changed files and everything that includes them; ``None`` when that is more than the budget."""
    seeds = changed.select(F.col(changed.columns[0]).alias("path")).distinct()
    dirty = cut_lineage(reach_any(_include_edges(includes), seeds, "in").select(F.col("node").alias("path")))
    if n_files and dirty.count() / n_files > budget:
        return None
    return dirty


# ---- shared state ---------------------------------------------------------------------------------


def action_dependency(
    reads: DataFrame, writers: DataFrame, actions: DataFrame | None = None, max_edges: int | None = None
) -> DataFrame:
    """Writer action -> reader action over a shared variable; ``reads`` and ``writers`` are ``(action, var)``.

    Requirement rows never carry writes of their own, so writers are given explicitly (writes found in
    the action's own blocks, or ``vars_written_by_action``). Without ``actions`` the edges go through the
    variable: ``(writer, writes, var)`` and ``(var, reads, reader)``, which holds every dependency and
    grows with the input only. With ``actions`` the direct edges that start at those actions are written
    out, the first ``max_edges`` by name if that is given, labelled with the first shared variable.
    """
    w = writers.select("action", "var").distinct()
    r = reads.select("action", "var").distinct()
    if actions is None:
        return w.select(F.col("action").alias("source"), F.lit("writes").alias("type"), F.col("var").alias("target")).unionByName(
            r.select(F.col("var").alias("source"), F.lit("reads").alias("type"), F.col("action").alias("target"))
        )
    asked = actions.select(F.col(actions.columns[0]).alias("action")).distinct()
    near = w.join(asked, "action", "left_semi").select(F.col("action").alias("source"), "var")
    pairs = near.join(r.select(F.col("action").alias("target"), "var"), "var").filter("source <> target")
    edges = pairs.groupBy("source", "target").agg(F.min("var").alias("label")).withColumn("type", F.lit("shared_state"))
    return edges if max_edges is None else edges.orderBy("source", "target").limit(max_edges)


def state_machine(
    actions: DataFrame,
    reqs: DataFrame,
    reads: DataFrame,
    writers: DataFrame,
    properties: DataFrame | None = None,
    property_reads: DataFrame | None = None,
) -> DataFrame:
    """State nodes, invariants and transitions as rows ``(part, action, item, role)``.

    A transition of an action leads from each of its sources to each of its targets: reads to writes, or
    one set to itself when the other is empty. It is kept as its source and target rows, which say the
    same without writing out the product; guards are the require / assume formulas of the action.
    ``transitions_of`` writes out the product for asked actions.
    """
    r = reads.select("action", "var").distinct()
    w = writers.select("action", "var").distinct()
    touched = r.unionByName(w).join(actions.select(F.col("id").alias("action")), "action", "left_semi")
    active = touched.select("var").distinct()
    states = active.select(
        F.lit("state").alias("part"), F.lit(None).cast("string").alias("action"), F.col("var").alias("item"),
        F.lit("node").alias("role"),
    )
    out = states
    if properties is not None:
        inv = property_reads.join(active, "var", "left_semi").select("id").distinct().join(properties, "id", "left_semi")
        out = out.unionByName(
            inv.select(
                F.lit("invariant").alias("part"), F.lit(None).cast("string").alias("action"),
                F.col("id").alias("item"), F.lit("node").alias("role"),
            )
        )
    ra, wa = r.join(active, "var", "left_semi"), w.join(active, "var", "left_semi")
    has_r, has_w = ra.select("action").distinct(), wa.select("action").distinct()
    sources = ra.unionByName(wa.join(has_r, "action", "left_anti").select(*ra.columns))
    targets = wa.unionByName(ra.join(has_w, "action", "left_anti").select(*wa.columns))
    for rows, role in ((sources, "source"), (targets, "target")):
        out = out.unionByName(
            rows.select(F.lit("transition").alias("part"), "action", F.col("var").alias("item"), F.lit(role).alias("role"))
        )
    moving = has_r.unionByName(has_w).distinct()
    guards = reqs.filter(F.col("kind").isin("require", "assume")).select(
        F.col("monitor_action").alias("action"), F.col("formula_text").alias("item")
    ).join(moving, "action", "left_semi")
    return out.unionByName(
        guards.select(F.lit("transition").alias("part"), "action", "item", F.lit("guard").alias("role"))
    )


def transitions_of(machine: DataFrame, actions: DataFrame, max_items: int | None = None) -> DataFrame:
    """Source-target pairs of the asked actions from a ``state_machine`` table; the first ``max_items``, if given."""
    asked = actions.select(F.col(actions.columns[0]).alias("action")).distinct()
    t = machine.filter("part = 'transition'").join(asked, "action", "left_semi")
    s = t.filter("role = 'source'").select("action", F.col("item").alias("source"))
    g = t.filter("role = 'target'").select("action", F.col("item").alias("target"))
    pairs = s.join(g, "action")
    return pairs if max_items is None else pairs.orderBy("action", "source", "target").limit(max_items)


# ---- scopes and statistics ------------------------------------------------------------------------


#: Scopes that a round of ``scope_partitions`` colours, and colours that a task of it looks at.
ROUND, COLORS = 2048, 8192


def _open_colors(colors: int, size: int):
    """Of a part of ``size`` colours, given as its rows ``(stem, variant, color)``, those that each asked scope may take, at
    most one more than scopes of the round stand before it: ``(rank, part, open)``. There are ``colors`` in all."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"rank": [], "part": [], "open": []})
        part = int(asked["part"].iloc[0])
        base = part * size
        full: dict[str, np.ndarray] = {}
        same: dict[tuple, list[int]] = {}
        for stem, variant, color in zip(held["stem"], held["variant"], held["color"], strict=True) if len(held) else ():
            full.setdefault(stem, np.zeros(size, bool))[color - base] = True
            if isinstance(variant, str):
                same.setdefault((stem, variant), []).append(color - base)
        out = []
        for (rank, place), need in asked.groupby(["rank", "place"]):
            taken = np.arange(base, base + size) >= colors
            for stem, variant in zip(need["stem"], need["variant"], strict=True):
                if stem in full:
                    other = full[stem].copy()
                    other[same.get((stem, variant), [])] = False
                    taken |= other
            out.append((rank, part, (np.flatnonzero(~taken)[: place + 1] + base).tolist()))
        return pd.DataFrame(out, columns=["rank", "part", "open"])

    return run


def _first_fit(fresh: int):
    """``(rank, color)`` of the scopes of one round, in the order of their ranks; colours from ``fresh`` on are new."""

    def run(need: pd.DataFrame, may: pd.DataFrame) -> pd.DataFrame:
        options = dict(zip(may["rank"], may["open"], strict=True)) if len(may) else {}
        held: dict[int, dict] = {}  # what scopes of this round have brought to a colour
        out, new = [], 0
        for rank, rows in need.groupby("rank"):
            rows = list(zip(rows["stem"], rows["variant"], strict=True))

            def fits(color, rows=rows):
                has = held.get(color)
                return has is None or all(isinstance(v, str) and has[s] == v for s, v in rows if s in has)

            color = next((c for c in itertools.chain(options.get(rank, ()), range(fresh, fresh + new)) if fits(c)), fresh + new)
            new = max(new, color - fresh + 1)
            held.setdefault(color, {}).update(rows)
            out.append((rank, color))
        return pd.DataFrame(out, columns=["rank", "color"])

    return run


def scope_partitions(
    scope_members: DataFrame, shared_stems: DataFrame, round_size: int = ROUND, part_size: int = COLORS
) -> DataFrame:
    """Partition per scope, so that no two scopes of a partition need different files of one name.

    Greedy colouring in the order of scope names, ``round_size`` scopes a round. Rivals are never paired: a colour is held as the
    one variant of each name that its scopes need. The colours are dealt to tasks, which say for each scope of the round
    the smallest ones that are open to it; as a scope before it in the round takes one of them at most, its place in the round is how many
    it may need. One task then gives the colours of the round, from at most ``round_size`` numbers a scope, whatever the tables' sizes.
    """
    need = (
        scope_members.select(F.col("scope_file").alias("scope"), F.col("member_path").alias("variant"))
        .withColumn("stem", stem_of(F.col("variant")))
        .join(shared_stems.select("stem").distinct(), "stem", "left_semi")
        .distinct()
    )
    # scopes that need exactly the same files have the same rivals and get the same colour: one stands for all
    mark = F.xxhash64("stem", "variant")
    marks = need.groupBy("scope").agg(
        F.count("*").alias("m1"), F.bit_xor(mark).alias("m2"), F.sum(mark.cast("decimal(38,0)")).alias("m3")
    )
    alike = ["m1", "m2", "m3"]
    leaders = marks.groupBy(*alike).agg(F.min("scope").alias("leader"))
    led = cut_lineage(marks.join(leaders, alike).select("scope", "leader"))
    # ranks by name: the rows of a sorted partition are numbered, and the driver adds up one size a partition
    order = cut_lineage(led.filter("scope = leader").select("scope").orderBy("scope").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = {r["part"]: r["n"] for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), itertools.accumulate((sizes[k] for k in sorted(sizes)), initial=0)))  # noqa: B905
    start = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.lit(None)
    order = cut_lineage(order.select("scope", (start[part.cast("long")] + F.col("id").bitwiseAND((1 << 33) - 1)).alias("rank")))
    # a scope that needs several files of a name is a rival of all others that need one
    need = need.join(order, "scope").groupBy("rank", "stem").agg(
        F.when(F.count("*") == 1, F.min("variant")).alias("variant")
    )
    need = cut_lineage(need)
    done: list[DataFrame] = []
    colors = 0
    for first in range(0, sum(sizes.values()), round_size):
        asked = need.filter((F.col("rank") >= first) & (F.col("rank") < first + round_size))
        may = asked.select("rank", F.array().cast("array<int>").alias("open")).limit(0)
        if done:
            held = reduce(DataFrame.unionByName, done).join(asked.select("stem").distinct(), "stem", "left_semi")
            held = held.select("stem", "variant", "color").distinct().withColumn("part", F.floor(F.col("color") / part_size).cast("int"))
            parts = F.explode(F.sequence(F.lit(0), F.lit((colors - 1) // part_size))).alias("part")
            rows = asked.select("rank", (F.col("rank") - first).alias("place"), "stem", "variant", parts)
            found = held.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(
                _open_colors(colors, part_size), "rank long, part int, open array<int>"
            )
            listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "open"))), lambda x: x["open"]))
            may = found.groupBy("rank").agg(listed.alias("open")).select(
                "rank", F.slice("open", F.lit(1), (F.col("rank") - first + 1).cast("int")).alias("open")
            )
        one = F.lit(0)
        given = asked.withColumn("one", one).groupBy("one").cogroup(may.withColumn("one", one).groupBy("one")).applyInPandas(
            _first_fit(colors), "rank long, color int"
        )
        given = cut_lineage(given.join(asked, "rank"))
        done.append(given)
        if len(done) > 8:
            done = [cut_lineage(reduce(DataFrame.unionByName, done))]
        colors = max(colors, given.agg(F.max("color")).first()[0] + 1)
    everyone = scope_members.select(F.col("scope_file").alias("scope")).distinct()
    none = need.select("rank", "stem", "variant", F.lit(0).alias("color")).limit(0)
    coloured = reduce(DataFrame.unionByName, done, none).select("rank", "color").distinct().join(order, "rank")
    coloured = coloured.select(F.col("scope").alias("leader"), "color")
    return everyone.join(led.join(coloured, "leader"), "scope", "left").select(
        F.col("scope").alias("scope_file"),
        F.concat(F.lit("partition_"), F.coalesce("color", F.lit(0)).cast("string")).alias("partition"),
    )


def include_summary(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows ``(path, relation, other)`` for asked files: includes, included_by, transitive."""
    asked = files.select("path").distinct()
    direct = includes.select("from_path", "to_path").filter("to_path IS NOT NULL").distinct()
    out = direct.join(asked.withColumnRenamed("path", "from_path"), "from_path", "left_semi").select(
        F.col("from_path").alias("path"), F.lit("includes").alias("relation"), F.col("to_path").alias("other")
    )
    back = direct.join(asked.withColumnRenamed("path", "to_path"), "to_path", "left_semi").select(
        F.col("to_path").alias("path"), F.lit("included_by").alias("relation"), F.col("from_path").alias("other")
    )
    far = reach(_include_edges(direct), asked).select(
        F.col("start").alias("path"), F.lit("transitive").alias("relation"), F.col("node").alias("other")
    )
    return out.unionByName(back).unionByName(far)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts by type, edge counts by type, number of files, largest out-degree."""
    n = nodes.groupBy("node_type").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("nodes:"), F.col("node_type")).alias("metric"), "value"
    )
    e = edges.groupBy("etype").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("edges:"), F.col("etype")).alias("metric"), "value"
    )
    files = nodes.agg(F.count_distinct("path").alias("value")).select(F.lit("files").alias("metric"), "value")
    degree = edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d").alias("value")).select(
        F.lit("max_out_degree").alias("metric"), "value"
    )
    return n.unionByName(e).unionByName(files).unionByName(degree)


