"""Queries over scopes, graphs, reports, lint, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import (
    coverage, documents, filters, graph, lint, maintain, navigate, patterns, reports, resolve, symbols, wiring,
)
from factloom.plans.lineage import cut_lineage
from factloom.sources import index as store
from factloom.streaming.changes import extract_facts
from workload.derived import LINES, cte, scratch, table
from workload.registry import register

ON_LINES = lambda body: cte("src", LINES + body)




# ---- closures and scopes --------------------------------------------------------------------------

_CYC = "RECURSIVE , cl AS (SELECT src AS start, dst AS node FROM edges_cyclic UNION SELECT start, dst FROM cl JOIN edges_cyclic ON src = node) "


@register("transitive_closure", cte("edges_cyclic", _CYC + "SELECT start, node FROM cl WHERE start <> node"))
def _(spark, sf):
    return graph.transitive_closure(table(spark, sf, "edges_cyclic")).select("start", "node")


@register(
    "transitive_closure_in",
    cte(
        "edges_dag",
        "RECURSIVE , sd AS (SELECT DISTINCT l_suppkey AS start FROM lineitem), cl AS (SELECT start, start AS node, 0 AS hops FROM sd UNION SELECT start, src, hops + 1 FROM cl JOIN edges_dag ON dst = node) SELECT start, node, min(hops) AS hops FROM cl WHERE start <> node GROUP BY start, node",
    ),
)
def _(spark, sf):
    seeds = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    return graph.transitive_closure(table(spark, sf, "edges_dag"), seeds, "in")


def _layers(spark, sf):
    return table(spark, sf, "layer_edges").groupBy(F.col("src").alias("layer")).agg(F.collect_set("dst").alias("depends_on"))


@register(
    "layer_closure",
    cte(
        "layer_edges",
        "RECURSIVE , cl AS (SELECT DISTINCT src AS layer, src AS visible FROM layer_edges UNION SELECT layer, dst FROM cl JOIN layer_edges ON src = visible) SELECT * FROM cl",
    ),
)
def _(spark, sf):
    layers = _layers(spark, sf)
    return graph.layer_closure(layers, layers.select("layer"))


@register(
    "detect_cycles",
    cte(
        "edges_cyclic",
        _CYC
        + ", cyc AS (SELECT DISTINCT start AS v FROM cl WHERE start = node) SELECT DISTINCT src, dst FROM edges_cyclic e WHERE (src IN (SELECT v FROM cyc) OR EXISTS (SELECT 1 FROM cl WHERE node = src AND start IN (SELECT v FROM cyc))) AND (dst IN (SELECT v FROM cyc) OR EXISTS (SELECT 1 FROM cl WHERE start = dst AND node IN (SELECT v FROM cyc)))",
    ),
)
def _(spark, sf):
    return graph.detect_cycles(table(spark, sf, "edges_cyclic"))


_MEM = """RECURSIVE , mem AS (SELECT DISTINCT path AS scope_file, path AS member_path FROM exports WHERE direction = 'export' UNION SELECT scope_file, to_path FROM mem JOIN includes ON from_path = member_path)
, nms AS (SELECT DISTINCT scope_file, name, direction FROM mem JOIN exports ON path = member_path)
, rl AS (SELECT scope_file, bool_or(contains(member_path, 'server_behavior')) AS s, bool_or(contains(member_path, 'client_behavior')) AS c FROM mem GROUP BY scope_file)
, roles AS (SELECT scope_file, CASE WHEN s AND NOT c THEN 'client' WHEN c AND NOT s THEN 'server' ELSE 'unknown' END AS role FROM rl) """
_ST = "exports includes"


def _members(spark, sf):
    """The members of all scopes, a table of columns that is read several times: a checkpoint would hold both names in each of its many rows."""
    members = graph.scope_members_of(table(spark, sf, "files"), table(spark, sf, "includes"), table(spark, sf, "exports"))
    found = scratch(spark, "members")
    members.write.option("compression", "zstd").parquet(found)
    return spark.read.schema(members.schema).parquet(found)


@register(
    "compute_scopes",
    cte(
        _ST,
        _MEM
        + """SELECT m.scope_file, role, count(*) AS file_count, (SELECT count(DISTINCT name) FROM nms n WHERE n.scope_file = m.scope_file AND direction = 'export') AS exported_names,
(SELECT count(DISTINCT name) FROM nms n WHERE n.scope_file = m.scope_file AND direction = 'import') AS imported_names FROM mem m JOIN roles USING (scope_file) GROUP BY m.scope_file, role""",
    ),
)
def _(spark, sf):
    return graph.compute_scopes(table(spark, sf, "files"), table(spark, sf, "includes"), table(spark, sf, "exports"))


@register("detect_role", cte(_ST, _MEM + "SELECT * FROM roles"))
def _(spark, sf):
    return graph.detect_role(_members(spark, sf))


@register("tests_for_file", cte(_ST, _MEM + "SELECT DISTINCT member_path AS path, scope_file FROM mem"))
def _(spark, sf):
    return graph.tests_for_file(_members(spark, sf), table(spark, sf, "files"))


@register("filter_in_any_scope", cte(_ST + " files", _MEM + "SELECT path, k FROM files WHERE path IN (SELECT member_path FROM mem)"))
def _(spark, sf):
    return filters.filter_in_any_scope(table(spark, sf, "files").select("path", "k"), _members(spark, sf))


@register(
    "filter_scope",
    cte(_ST + " spec_reqs", _MEM + "SELECT id, path FROM spec_reqs WHERE path IN (SELECT member_path FROM mem WHERE scope_file = (SELECT max(scope_file) FROM mem))"),
)
def _(spark, sf):
    m = _members(spark, sf)
    scope = m.agg(F.max("scope_file")).first()[0]
    return filters.filter_scope(table(spark, sf, "spec_reqs"), m, scope=scope).select("id", "path")


# asked files: the shims
_VISIBLE = (
    _MEM
    + """, ask AS (SELECT path FROM files WHERE contains(path, '_shim.')), held AS (SELECT DISTINCT member_path AS path, scope_file FROM mem WHERE member_path IN (SELECT path FROM ask))
, own AS (SELECT path AS from_path, path FROM ask WHERE path NOT IN (SELECT path FROM held) UNION SELECT o.from_path, to_path FROM own o JOIN includes i ON i.from_path = o.path)
, vis AS (SELECT DISTINCT path AS from_path, member_path AS path FROM held JOIN mem USING (scope_file) UNION SELECT from_path, path FROM own) """
)


def _asked(spark, sf):
    return table(spark, sf, "files").filter(F.contains("path", F.lit("_shim."))).select("path")


@register("scope_files_for_file", cte(_ST + " files", _VISIBLE + "SELECT * FROM vis"))
def _(spark, sf):
    return graph.scope_files_for_file(_members(spark, sf), table(spark, sf, "includes"), _asked(spark, sf))


@register("symbols_in_scope", cte(_ST + " files", _VISIBLE + "SELECT from_path, path, 'act_' || k AS name FROM vis JOIN files USING (path)"))
def _(spark, sf):
    s = table(spark, sf, "files").select("path", F.concat(F.lit("act_"), "k").alias("name"))
    return graph.symbols_in_scope(s, _members(spark, sf), table(spark, sf, "includes"), _asked(spark, sf))


@register(
    "active_requirements",
    cte(
        "includes files spec_reqs",
        "RECURSIVE , cl AS (SELECT path AS for_path, path FROM files WHERE contains(path, '_shim.') UNION SELECT for_path, to_path FROM cl JOIN includes ON from_path = path) SELECT for_path, path, count(*) AS n FROM cl JOIN spec_reqs USING (path) GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    r = graph.active_requirements(table(spark, sf, "spec_reqs"), table(spark, sf, "includes"), _asked(spark, sf))
    return r.groupBy("for_path", "path").agg(F.count("*").alias("n"))


@register(
    "include_summary",
    cte(
        "includes files",
        """RECURSIVE , ask AS (SELECT path FROM files WHERE contains(path, '_shim.')), cl AS (SELECT path, path AS other FROM ask UNION SELECT cl.path, to_path FROM cl JOIN includes ON from_path = other)
SELECT path, 'transitive' AS relation, other FROM cl WHERE path <> other UNION SELECT from_path, 'includes', to_path FROM includes WHERE from_path IN (SELECT path FROM ask) UNION SELECT to_path, 'included_by', from_path FROM includes WHERE to_path IN (SELECT path FROM ask)""",
    ),
)
def _(spark, sf):
    return graph.include_summary(table(spark, sf, "includes"), _asked(spark, sf))


_BRING = """RECURSIVE , ask AS (SELECT path FROM files WHERE contains(path, '_shim.')), cl AS (SELECT DISTINCT to_path AS start, to_path AS node FROM includes WHERE from_path IN (SELECT path FROM ask) UNION SELECT start, to_path FROM cl JOIN includes ON from_path = node)
, fb AS (SELECT from_path AS path, node AS brought, min((line, include_name)) AS m FROM includes JOIN cl ON start = to_path WHERE from_path IN (SELECT path FROM ask) GROUP BY 1, 2)
, ih AS (SELECT fb.path, m[1] AS line, m[2] AS include_name, count(*) AS inherited FROM fb JOIN spec_reqs r ON r.path = brought GROUP BY 1, 2, 3) """


def _inherited(spark, sf, fn):
    return fn(table(spark, sf, "includes"), table(spark, sf, "spec_reqs"), _asked(spark, sf))


@register("include_summary_counts", cte("includes files spec_reqs", _BRING + "SELECT * FROM ih"))
def _(spark, sf):
    return _inherited(spark, sf, lint.include_summary_counts)


@register(
    "lint_inherited_requirements",
    cte("includes files spec_reqs", _BRING + "SELECT 'inherited_requirements' AS code, 'info' AS severity, path, line, include_name AS subject, CAST(inherited AS VARCHAR) AS detail FROM ih"),
)
def _(spark, sf):
    return _inherited(spark, sf, lint.lint_inherited_requirements)


@register(
    "inherited_related",
    cte(
        "includes files spec_reqs",
        _BRING
        + "SELECT fb.path, m[1] AS line, m[2] AS include_name, brought, r.line AS req_line, r.kind, r.formula_text AS formula FROM fb JOIN spec_reqs r ON r.path = brought",
    ),
)
def _(spark, sf):
    return _inherited(spark, sf, lint.inherited_related).select("path", "line", "include_name", "brought", "req_line", "kind", "formula")


# ---- one-hop questions ------------------------------------------------------------------------------


def _constrains(spark, sf):
    return wiring.wire_constrains(table(spark, sf, "reqs"))


def _reads_edges(spark, sf):
    return table(spark, sf, "reads").select(F.col("id").alias("src"), F.lit("READS").alias("etype"), F.col("var").alias("dst"))


@register("requirements_for_action", cte("reqs actions", "SELECT monitor_action AS action, id, kind FROM reqs WHERE monitor_action IN (SELECT id FROM actions)"))
def _(spark, sf):
    asked = table(spark, sf, "actions").select("id")
    return graph.requirements_for_action(_constrains(spark, sf), table(spark, sf, "reqs"), asked).select("action", "id", "kind")


@register("state_vars_read_by", cte("reads vars reqs", "SELECT DISTINCT r.id AS reader, v.id FROM reads r JOIN vars v ON v.id = r.var WHERE r.id IN (SELECT id FROM reqs)"))
def _(spark, sf):
    asked = table(spark, sf, "reqs").select("id")
    return graph.state_vars_read_by(_reads_edges(spark, sf), table(spark, sf, "vars"), asked).select("reader", "id")


@register("requirements_sharing_var", cte("reads reqs vars", "SELECT DISTINCT var, r.id FROM reads r JOIN reqs USING (id) WHERE var IN (SELECT id FROM vars)"))
def _(spark, sf):
    asked = table(spark, sf, "vars").select("id")
    return graph.requirements_sharing_var(_reads_edges(spark, sf), table(spark, sf, "reqs"), asked).select("var", "id")


@register("impact_of_var", cte("reads reqs vars", "SELECT var, path, count(*) AS requirements FROM (SELECT DISTINCT var, id FROM reads) r JOIN reqs USING (id) WHERE var IN (SELECT id FROM vars) GROUP BY var, path"))
def _(spark, sf):
    return graph.impact_of_var(_reads_edges(spark, sf), table(spark, sf, "reqs"), table(spark, sf, "vars"))


@register("vars_written_by_action", cte("reqs writes", "SELECT DISTINCT monitor_action AS action, var FROM reqs JOIN writes USING (path) WHERE monitor_action IN ('act_12', 'act_70', 'act_155')"))
def _(spark, sf):
    asked = spark.createDataFrame([("act_12",), ("act_70",), ("act_155",)], "id string")
    return graph.vars_written_by_action(table(spark, sf, "reqs"), table(spark, sf, "writes"), asked)


@register("written_var_counts", cte("reqs writes", "SELECT monitor_action AS action, count(DISTINCT var) AS vars_written FROM (SELECT DISTINCT monitor_action, path FROM reqs) JOIN (SELECT DISTINCT path, var FROM writes) USING (path) GROUP BY 1"))
def _(spark, sf):
    return graph.written_var_counts(table(spark, sf, "reqs"), table(spark, sf, "writes"))


@register(
    "dirty_expand",
    cte(
        "includes",
        "RECURSIVE , cl AS (SELECT 'corpus1/layer0/p0/common_0.spec' AS path UNION SELECT from_path FROM cl JOIN includes ON to_path = path) SELECT path FROM cl",
    ),
)
def _(spark, sf):
    changed = spark.createDataFrame([("corpus1/layer0/p0/common_0.spec",)], "path string")
    return graph.dirty_expand(changed, table(spark, sf, "includes"), table(spark, sf, "files").count())


@register(
    "action_dependency",
    cte(
        "action_reads action_writes",
        "SELECT action AS source, 'writes' AS type, var AS target FROM action_writes UNION ALL SELECT var, 'reads', action FROM action_reads",
    ),
)
def _(spark, sf):
    return graph.action_dependency(table(spark, sf, "action_reads"), table(spark, sf, "action_writes"))


@register(
    "action_dependency_direct",
    cte(
        "action_reads action_writes",
        "SELECT w.action AS source, r.action AS target, min(var) AS label, 'shared_state' AS type FROM action_writes w JOIN action_reads r USING (var) WHERE w.action IN ('act_5', 'act_17') AND w.action <> r.action GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    asked = spark.createDataFrame([("act_5",), ("act_17",)], "id string")
    return graph.action_dependency(table(spark, sf, "action_reads"), table(spark, sf, "action_writes"), asked)


_MACHINE = """, tch AS (SELECT * FROM action_reads UNION ALL SELECT * FROM action_writes), act AS (SELECT DISTINCT var FROM tch WHERE action IN (SELECT id FROM actions))
, r AS (SELECT * FROM action_reads WHERE var IN (SELECT var FROM act)), w AS (SELECT * FROM action_writes WHERE var IN (SELECT var FROM act))
, sm AS (SELECT 'state' AS part, CAST(NULL AS VARCHAR) AS action, var AS item, 'node' AS role FROM act
UNION ALL SELECT 'invariant', NULL, id, 'node' FROM props WHERE id IN (SELECT id FROM prop_reads WHERE var IN (SELECT var FROM act))
UNION ALL SELECT 'transition', action, var, 'source' FROM r UNION ALL SELECT 'transition', action, var, 'source' FROM w WHERE action NOT IN (SELECT action FROM r)
UNION ALL SELECT 'transition', action, var, 'target' FROM w UNION ALL SELECT 'transition', action, var, 'target' FROM r WHERE action NOT IN (SELECT action FROM w)
UNION ALL SELECT 'transition', monitor_action, formula_text, 'guard' FROM reqs WHERE kind IN ('require', 'assume') AND monitor_action IN (SELECT action FROM r UNION SELECT action FROM w)) """
_MT = "actions reqs action_reads action_writes props prop_reads"


def _machine(spark, sf):
    t = {n: table(spark, sf, n) for n in _MT.split()}
    return graph.state_machine(t["actions"], t["reqs"], t["action_reads"], t["action_writes"], t["props"], t["prop_reads"])


@register("state_machine", cte(_MT, _MACHINE + "SELECT * FROM sm"))
def _(spark, sf):
    return _machine(spark, sf)


@register(
    "transitions_of",
    cte(_MT, _MACHINE + "SELECT action, s.item AS source, t.item AS target FROM sm s JOIN sm t USING (action) WHERE s.role = 'source' AND t.role = 'target' AND action IN ('act_3', 'act_8')"),
)
def _(spark, sf):
    return graph.transitions_of(_machine(spark, sf), spark.createDataFrame([("act_3",), ("act_8",)], "id string"))


@register("scope_partitions")
def _(spark, sf):
    shared = resolve.collisions(table(spark, sf, "files")).select("stem")
    return graph.scope_partitions(_members(spark, sf), shared)


@register(
    "graph_stats",
    cte(
        "reqs actions vars reads",
        """, nd AS (SELECT 'requirement' AS t, path FROM reqs UNION ALL SELECT 'action', path FROM actions UNION ALL SELECT 'state_var', path FROM vars)
, ed AS (SELECT DISTINCT id AS src, 'CONSTRAINS' AS etype, monitor_action AS dst FROM reqs UNION ALL SELECT id, 'READS', var FROM reads)
SELECT 'nodes:' || t AS metric, count(*) AS value FROM nd GROUP BY t UNION ALL SELECT 'edges:' || etype, count(*) FROM ed GROUP BY etype UNION ALL SELECT 'files', count(DISTINCT path) FROM nd UNION ALL SELECT 'max_out_degree', max(c) FROM (SELECT count(*) AS c FROM ed GROUP BY src) AS x""",
    ),
)
def _(spark, sf):
    node = lambda n, t: table(spark, sf, n).select(F.lit(t).alias("node_type"), "path")
    nodes = node("reqs", "requirement").unionByName(node("actions", "action")).unionByName(node("vars", "state_var"))
    return graph.graph_stats(nodes, _constrains(spark, sf).unionByName(_reads_edges(spark, sf)))


# ---- reports --------------------------------------------------------------------------------------------


@register(
    "action_requirements",
    cte(
        "reqs actions",
        """SELECT monitor_action AS action, mixin_kind, id, kind, CASE WHEN contains(formula_text, '_generating') THEN 'TESTER_ONLY' WHEN mixin_kind IN ('after', 'around') OR kind IN ('ensure', 'assert') THEN 'GUARANTEE' ELSE 'ASSUMPTION' END AS class, formula_text AS formula, path, line
FROM reqs WHERE monitor_action IN (SELECT id FROM actions)""",
    ),
)
def _(spark, sf):
    return reports.action_requirements(table(spark, sf, "actions"), table(spark, sf, "reqs"))


_SUMMARY = """, rw AS (SELECT monitor_action AS id, count(DISTINCT var) AS vars_written FROM (SELECT DISTINCT monitor_action, path FROM reqs) JOIN (SELECT DISTINCT path, var FROM writes) USING (path) GROUP BY 1)
, rd AS (SELECT monitor_action AS id, count(DISTINCT var) AS vars_read FROM reads JOIN reqs USING (id) GROUP BY 1)
, tg AS (SELECT id, count(DISTINCT tag) AS tags FROM (SELECT monitor_action AS id, unnest(tags) AS tag FROM reqs) AS x GROUP BY 1)
, ct AS (SELECT monitor_action AS id, count(*) FILTER (kind = 'require' AND mixin_kind = 'before') AS before_require, count(*) FILTER (kind = 'ensure' AND mixin_kind = 'before') AS before_ensure, count(*) FILTER (kind = 'require' AND mixin_kind = 'after') AS after_require,
  count(*) FILTER (kind = 'ensure' AND mixin_kind = 'after') AS after_ensure, count(*) FILTER (kind = 'assume') AS assumes, count(*) FILTER (kind = 'assert') AS asserts, count(*) AS requirements FROM reqs GROUP BY 1)
SELECT a.id, name, path, line, coalesce(before_require, 0) AS before_require, coalesce(before_ensure, 0) AS before_ensure, coalesce(after_require, 0) AS after_require, coalesce(after_ensure, 0) AS after_ensure, coalesce(assumes, 0) AS assumes, coalesce(asserts, 0) AS asserts,
  coalesce(requirements, 0) AS requirements, coalesce(vars_read, 0) AS vars_read, coalesce(vars_written, 0) AS vars_written, coalesce(tags, 0) AS tags FROM actions a LEFT JOIN ct USING (id) LEFT JOIN rd USING (id) LEFT JOIN rw USING (id) LEFT JOIN tg USING (id)"""


@register("model_summary", cte("actions reqs reads writes", _SUMMARY))
def _(spark, sf):
    return reports.model_summary(*[table(spark, sf, n) for n in ("actions", "reqs", "reads", "writes")])


# scopes over the files of the action table: the files of one kind of property, all exports seen from them
_PAGE_SCOPE = """, sm AS (SELECT DISTINCT 'test_' || kind || '.spec' AS scope_file, path AS member_path FROM props)
, ac AS (SELECT * FROM actions WHERE path IN (SELECT member_path FROM sm WHERE scope_file = 'test_invariant.spec') AND contains(path, 'f1'))
, dr AS (SELECT ac.id, CASE WHEN bool_or(direction = 'export') THEN 'GENERATED' WHEN bool_or(direction = 'import') THEN 'RECEIVED' ELSE 'INTERNAL' END AS direction FROM ac LEFT JOIN exports e ON e.name = ac.name GROUP BY ac.id)"""
_REPORT_COUNTS = """, rw AS (SELECT monitor_action AS id, count(DISTINCT var) AS vars_written FROM (SELECT DISTINCT monitor_action, path FROM reqs WHERE monitor_action IN (SELECT id FROM ac)) JOIN (SELECT DISTINCT path, var FROM writes) USING (path) GROUP BY 1)
, rd AS (SELECT monitor_action AS id, count(DISTINCT var) AS vars_read FROM reads JOIN reqs USING (id) GROUP BY 1)
, tg AS (SELECT id, count(DISTINCT tag) AS tags FROM (SELECT monitor_action AS id, unnest(tags) AS tag FROM reqs) AS x GROUP BY 1)
, ct AS (SELECT monitor_action AS id, """ + ", ".join(
    [f"count(*) FILTER (mixin_kind = '{m}') AS {m}" for m in reports.MIXINS]
    + [f"count(*) FILTER (kind = '{k}') AS {k}" for k in reports.KINDS]
) + """, count(*) AS requirements FROM reqs GROUP BY 1)
"""
_REPORT = "SELECT a.id, a.name, a.qualified_name, a.path, a.line, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in [*reports.MIXINS, *reports.KINDS, "requirements", "vars_read", "vars_written", "tags"]
)
_REPORT_FROM = "LEFT JOIN ct USING (id) LEFT JOIN rd USING (id) LEFT JOIN rw USING (id) LEFT JOIN tg USING (id)"


def _report_scope(spark, sf):
    members = table(spark, sf, "props").select(
        F.concat(F.lit("test_"), "kind", F.lit(".spec")).alias("scope_file"), F.col("path").alias("member_path")
    ).distinct()
    names = members.select("scope_file").distinct().join(
        table(spark, sf, "exports").select(F.lit("test_invariant.spec").alias("scope_file"), "name", "direction"), "scope_file"
    )
    return members, names


def _facts(spark, sf):
    return [table(spark, sf, n) for n in ("actions", "reqs", "reads", "writes")]


@register(
    "action_report",
    cte(
        "actions reqs reads writes",
        ", ac AS (SELECT * FROM actions)" + _REPORT_COUNTS + _REPORT
        + ", NULL AS direction, (SELECT count(*) FROM ac) AS total, false AS has_more FROM ac a " + _REPORT_FROM,
    ),
)
def _(spark, sf):
    return reports.action_report(*_facts(spark, sf))


@register(
    "action_report_scoped",
    cte(
        "actions reqs reads writes props exports",
        _PAGE_SCOPE + _REPORT_COUNTS + _REPORT
        + ", direction, (SELECT count(*) FROM ac) AS total, (SELECT count(*) FROM ac) > 40 AS has_more FROM (SELECT * FROM ac ORDER BY path, line, id LIMIT 30 OFFSET 10) AS a JOIN dr USING (id) "
        + _REPORT_FROM,
    ),
)
def _(spark, sf):
    members, names = _report_scope(spark, sf)
    return reports.action_report(*_facts(spark, sf), members, names, "test_invariant.spec", offset=10, limit=30, corpus="f1")


@register(
    "action_variables",
    cte(
        "actions reqs reads writes props exports",
        _PAGE_SCOPE
        + """, own AS (SELECT * FROM reqs WHERE monitor_action IN (SELECT id FROM ac))
SELECT DISTINCT monitor_action AS action, 'read' AS access, var FROM own JOIN reads USING (id) UNION SELECT monitor_action, 'written', var FROM own JOIN writes USING (path)""",
    ),
)
def _(spark, sf):
    actions, *facts = _facts(spark, sf)
    members, _ = _report_scope(spark, sf)
    asked = reports.select_actions(actions, members, "test_invariant.spec", corpus="f1")
    return reports.action_variables(asked, *facts)


@register(
    "model_summary_scoped",
    cte(
        "actions reqs reads writes props exports",
        _PAGE_SCOPE + _SUMMARY.replace("FROM actions a", "FROM ac a JOIN dr USING (id)").replace(" AS tags FROM ac", " AS tags, direction FROM ac"),
    ),
)
def _(spark, sf):
    return reports.scoped_model_summary(*_facts(spark, sf), *_report_scope(spark, sf), "test_invariant.spec", "f1")


@register("model_totals", cte("actions reqs vars", "SELECT 'actions' AS metric, count(*) AS value FROM actions UNION ALL SELECT 'state_vars', count(*) FROM vars UNION ALL SELECT 'requirements', count(*) FROM reqs"))
def _(spark, sf):
    return reports.model_totals(table(spark, sf, "actions"), table(spark, sf, "vars"), table(spark, sf, "reqs"))


@register("action_tags", cte("actions reqs", "SELECT DISTINCT action, tag FROM (SELECT monitor_action AS action, unnest(tags) AS tag FROM reqs) AS x WHERE action IN (SELECT id FROM actions)"))
def _(spark, sf):
    return reports.action_tags(table(spark, sf, "actions"), table(spark, sf, "reqs"))


for _by, _key in (("file", "path"), ("module", "split_part(qualified_name, '.', 1)")):
    register(
        f"layered_overview_{_by}" if _by == "module" else "layered_overview",
        cte(
            "actions vars reqs",
            f""", n AS (SELECT monitor_action AS id, count(*) AS c FROM reqs GROUP BY 1), x AS (SELECT {_key} AS "group", 1 AS a, 0 AS v, coalesce(c, 0) AS r FROM actions LEFT JOIN n USING (id) UNION ALL SELECT {_key}, 0, 1, 0 FROM vars)
SELECT "group", CAST(sum(a) AS BIGINT) AS actions, CAST(sum(v) AS BIGINT) AS state_vars, CAST(sum(r) AS BIGINT) AS requirements FROM x GROUP BY 1""",
        ),
    )(
        lambda spark, sf, by=_by: reports.layered_overview(
            table(spark, sf, "actions"), table(spark, sf, "vars"), table(spark, sf, "reqs"), by
        )
    )


@register("requirement_counts", cte("reqs", "SELECT monitor_action AS action, kind, count(*) AS n FROM reqs GROUP BY 1, 2"))
def _(spark, sf):
    return reports.requirement_counts(table(spark, sf, "reqs"))


_SCOPED = (
    _MEM
    + """, sc AS (SELECT scope_file, monitor_action AS action, kind, CASE WHEN contains(formula_text, '_generating') THEN 'TESTER_ONLY' WHEN mixin_kind IN ('after', 'around') OR kind IN ('ensure', 'assert') THEN 'GUARANTEE' ELSE 'ASSUMPTION' END AS class
  FROM mem JOIN spec_reqs ON path = member_path WHERE EXISTS (SELECT 1 FROM nms WHERE nms.scope_file = mem.scope_file AND name = monitor_action)) """
)


def _scoped(spark, sf, fn):
    m, e = _members(spark, sf), table(spark, sf, "exports")
    return fn(table(spark, sf, "spec_reqs"), m, graph.scope_exports(m, e))


@register(
    "scoped_counts",
    cte(_ST + " spec_reqs", _SCOPED + "SELECT scope_file, action, kind, count(*) AS n FROM sc WHERE EXISTS (SELECT 1 FROM nms WHERE nms.scope_file = sc.scope_file AND name = action AND direction = 'export') GROUP BY 1, 2, 3"),
)
def _(spark, sf):
    return _scoped(spark, sf, reports.scoped_counts)


@register("scoped_nct_counts", cte(_ST + " spec_reqs", _SCOPED + "SELECT scope_file, action, kind, class, count(*) AS n FROM sc GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    return _scoped(spark, sf, reports.scoped_nct_counts)


@register(
    "monitor_summary",
    cte(
        "actions reqs reads",
        """, k AS (SELECT monitor_action AS action, count(*) FILTER (kind = 'require') AS require, count(*) FILTER (kind = 'ensure') AS ensure, count(*) FILTER (kind = 'assume') AS assume, count(*) FILTER (kind = 'assert') AS assert FROM reqs GROUP BY 1)
, r AS (SELECT monitor_action AS action, count(DISTINCT var) AS vars_read FROM reads JOIN reqs USING (id) GROUP BY 1)
SELECT path, line, action, require, ensure, assume, assert, coalesce(vars_read, 0) AS vars_read FROM (SELECT path, line, id AS action FROM actions) AS m JOIN k USING (action) LEFT JOIN r USING (action)""",
    ),
)
def _(spark, sf):
    m = table(spark, sf, "actions").select("path", "line", F.col("id").alias("action"))
    return reports.monitor_summary(m, table(spark, sf, "reqs"), table(spark, sf, "reads"))


@register(
    "state_var_summary",
    cte("vars reads reqs", "SELECT v.id, v.path, count(DISTINCT r.id) AS readers, count(DISTINCT q.path) AS files FROM vars v JOIN reads r ON r.var = v.id JOIN reqs q ON q.id = r.id GROUP BY 1, 2"),
)
def _(spark, sf):
    return reports.state_var_summary(table(spark, sf, "vars"), table(spark, sf, "reads"), table(spark, sf, "reqs")).select(
        "id", "path", "readers", "files"
    )


@register(
    "property_summary",
    cte(
        "props prop_reads reads reqs",
        "SELECT p.id, count(DISTINCT r.id) AS requirements, count(DISTINCT q.path) AS files FROM props p JOIN prop_reads pr ON pr.id = p.id JOIN reads r ON r.var = pr.var JOIN reqs q ON q.id = r.id GROUP BY 1",
    ),
)
def _(spark, sf):
    return reports.property_summary(*[table(spark, sf, n) for n in ("props", "prop_reads", "reads", "reqs")]).select("id", "requirements", "files")


@register(
    "annotation_levels",
    cte("annotations manifest", "SELECT path, line, tag, level FROM (SELECT path, line, unnest(tags) AS tag FROM annotations) AS a LEFT JOIN manifest ON req_id = tag"),
)
def _(spark, sf):
    return reports.annotation_levels(table(spark, sf, "annotations"), table(spark, sf, "manifest"))


_GATE = """, g AS (SELECT 'lang_header' AS "check", 'minimal' AS level, count(*) FILTER (NOT starts_with(content, '#lang')) AS count, count(*) FILTER (NOT starts_with(content, '#lang')) = 0 AS passed FROM src
UNION ALL SELECT 'minimum_files', 'minimal', count(*), count(*) >= 3 FROM src
UNION ALL SELECT 'includes_resolve', 'minimal', count(*), count(*) = 0 FROM lines WHERE regexp_matches(text, '^include \\w+') AND regexp_extract(text, '^include (\\w+)', 1) NOT IN (SELECT regexp_extract(path, '([^/]+)\\.spec', 1) FROM src)
UNION ALL SELECT 'test_specs_exist', 'standard', count(*), count(*) > 0 FROM src WHERE contains(path, '_test.')
UNION ALL SELECT 'monitors_exist', 'standard', count(*), count(*) > 0 FROM lines WHERE regexp_matches(text, '^\\s*(before|after|around)\\s+')
UNION ALL SELECT 'exports_exist', 'standard', count(*), count(*) > 0 FROM lines WHERE regexp_matches(text, '^\\s*export\\s+\\w+')
UNION ALL SELECT 'annotations_exist', 'comprehensive', count(*), count(*) > 0 FROM lines WHERE regexp_matches(text, '#\\s*\\[[\\w:.,\\s]+\\]\\s*$')
UNION ALL SELECT 'manifest_exists', 'comprehensive', count(*), count(*) > 0 FROM manifest) """


def _gate(spark, sf):
    src = table(spark, sf, "src")
    return reports.quality_gate(src, symbols.extract_includes(src), table(spark, sf, "manifest"), "comprehensive")


@register("quality_gate", cte("src manifest", LINES + _GATE + "SELECT * FROM g"))
def _(spark, sf):
    return _gate(spark, sf)


@register("gate_result", cte("src manifest", LINES + _GATE + "SELECT bool_and(passed) AS passed, count(*) FILTER (passed) AS checks_passed, count(*) AS checks_total FROM g"))
def _(spark, sf):
    return reports.gate_result(_gate(spark, sf))


@register(
    "completeness_score",
    cte(
        "src",
        """, m AS (SELECT * FROM (VALUES ('types', 'type '), ('codec', 'interpret '), ('frame', 'variant '), ('packet', 'type.*quic_packet'), ('connection', 'relation conn'), ('transport', 'action '), ('security', 'action '), ('application', 'action app_'), ('shim', '<<< impl'), ('test_specs', 'export '), ('entities', 'instance '), ('behavior', 'before '), ('recovery', 'no such text'), ('extensions', 'no such text')) AS v(layer, marker))
, p AS (SELECT m.layer, bool_or(contains(content, marker)) AS present FROM m, src GROUP BY m.layer)
SELECT layer, present, (SELECT CAST(round(100.0 * count(*) FILTER (present) / 14) AS INT) FROM p) AS score, CASE WHEN present THEN NULL WHEN layer IN ('types', 'frame', 'packet', 'connection') THEN 'high' ELSE 'medium' END AS priority FROM p""",
    ),
)
def _(spark, sf):
    return reports.completeness_score(table(spark, sf, "src"), "corpus0")


@register(
    "suggestions",
    cte(
        "actions vars reqs reads",
        """SELECT 'uncovered_action' AS type, name, path, line, 'high' AS priority FROM actions WHERE id NOT IN (SELECT monitor_action FROM reqs) UNION ALL SELECT 'unguarded_state', name, path, line, 'medium' FROM vars WHERE id NOT IN (SELECT var FROM reads JOIN reqs USING (id))""",
    ),
)
def _(spark, sf):
    return reports.suggestions(*[table(spark, sf, n) for n in ("actions", "reqs", "vars", "reads", "writes")])


@register(
    "suggestions_for_action",
    cte(
        "vars reqs reads writes",
        """, own AS (SELECT DISTINCT var FROM reads JOIN reqs USING (id) WHERE monitor_action = 'act_12'), sh AS (SELECT DISTINCT id FROM reads WHERE var IN (SELECT var FROM own) AND id IN (SELECT id FROM reqs))
, rel AS (SELECT DISTINCT var FROM reads WHERE id IN (SELECT id FROM sh) AND var NOT IN (SELECT var FROM own)), wr AS (SELECT DISTINCT var FROM writes WHERE path IN (SELECT path FROM reqs WHERE monitor_action = 'act_12') AND var NOT IN (SELECT var FROM own))
SELECT 'state_var' AS type, name, path, line, 'medium' AS priority FROM vars WHERE id IN (SELECT var FROM rel) UNION ALL SELECT 'missing_guard', name, path, line, 'high' FROM vars WHERE id IN (SELECT var FROM wr)""",
    ),
)
def _(spark, sf):
    return reports.suggestions(*[table(spark, sf, n) for n in ("actions", "reqs", "vars", "reads", "writes")], action="act_12")


# check results of files: the orders of a customer, later order dates first
@register(
    "verification_dashboard",
    """WITH r AS (SELECT 'f' || o_custkey AS path, o_orderdate AS checked_at, o_orderstatus = 'F' AS success FROM orders), l AS (SELECT path, max_by(success, (checked_at, success)) AS success FROM r GROUP BY path)
SELECT c_mktsegment AS corpus, CASE WHEN success THEN 'verified' WHEN NOT success THEN 'failed' ELSE 'pending' END AS state, count(*) AS files FROM customer LEFT JOIN l ON l.path = 'f' || c_custkey GROUP BY 1, 2""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(
        F.concat(F.lit("f"), "o_custkey").alias("path"), F.col("o_orderdate").alias("checked_at"), (F.col("o_orderstatus") == "F").alias("success")
    )
    f = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("corpus"), F.concat(F.lit("f"), "c_custkey").alias("path"))
    return reports.verification_dashboard(r, f)


@register(
    "failure_reasons",
    """WITH f AS (SELECT o_orderpriority || ' ' || o_orderstatus AS message, 'f' || o_custkey AS path FROM orders), c AS (SELECT message, count(*) AS n FROM f GROUP BY 1) SELECT message, n, path FROM c JOIN (SELECT DISTINCT message, path FROM f) AS s USING (message)""",
)
def _(spark, sf):
    f = table(spark, sf, "orders").select(
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"), F.concat(F.lit("f"), "o_custkey").alias("path")
    )
    return reports.failure_reasons(f)


@register(
    "error_groups",
    """WITH e AS (SELECT p_name || ' ' || p_partkey AS symbol, CASE WHEN p_size % 3 = 0 THEN 'unresolved' WHEN p_size % 3 = 2 THEN 'duplicate' ELSE 'other' END AS kind FROM part), c AS (SELECT kind, count(*) AS n FROM e GROUP BY 1) SELECT kind, n, symbol FROM c JOIN (SELECT DISTINCT kind, symbol FROM e) AS s USING (kind)""",
)
def _(spark, sf):
    e = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("symbol"), (F.col("p_size") % 3).alias("locations"))
    return reports.error_groups(e)


# changes: every event is an operation on a file of the corpus
_CHG = "SELECT 'k' || (user_id % 100) AS path, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'change' END AS op, event_id AS seq, props AS content FROM events"


def _changes(spark, sf):
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "create").otherwise("change")
    return table(spark, sf, "events").select(
        F.concat(F.lit("k"), (F.col("user_id") % 100).cast("string")).alias("path"), op.alias("op"), F.col("event_id").alias("seq"), F.col("props").alias("content")
    )


@register(
    "scope_view_status",
    f"""WITH m AS (SELECT DISTINCT 's' || c_nationkey AS scope_file, 'k' || (c_custkey % 200) AS member_path FROM customer), chg AS ({_CHG}), l AS (SELECT path, max_by(op, seq) AS op FROM chg GROUP BY path)
, j AS (SELECT scope_file, op FROM m LEFT JOIN l ON path = member_path)
SELECT scope_file, bool_or(coalesce(op IN ('create', 'change'), false)) AS is_stale, CASE WHEN count(*) FILTER (coalesce(op, '') <> 'delete') = 0 THEN 'building' WHEN bool_or(coalesce(op = 'delete', false)) THEN 'partial' ELSE 'complete' END AS completeness, count(*) FILTER (coalesce(op, '') <> 'delete') AS files FROM j GROUP BY 1""",
)
def _(spark, sf):
    m = table(spark, sf, "customer").select(
        F.concat(F.lit("s"), "c_nationkey").alias("scope_file"), F.concat(F.lit("k"), (F.col("c_custkey") % 200).cast("string")).alias("member_path")
    ).distinct()
    return reports.scope_view_status(m, _changes(spark, sf))


@register("list_scopes", cte("exports", "SELECT split_part(path, '/', 1) AS corpus, path AS scope_file, count(*) AS names FROM exports WHERE direction = 'export' AND starts_with(path, 'corpus1/') GROUP BY 1, 2"))
def _(spark, sf):
    s = table(spark, sf, "exports").filter("direction = 'export'").groupBy(
        F.substring_index("path", "/", 1).alias("corpus"), F.col("path").alias("scope_file")
    ).agg(F.count("*").alias("names"))
    return reports.list_scopes(s, "corpus1")


@register("tool_metrics", cte("ev", "SELECT name, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'timeout') AS timeouts, CAST(round(sum(CAST(round(duration_ms * 100) AS BIGINT))) AS BIGINT) AS total_cents FROM ev GROUP BY 1"))
def _(spark, sf):
    ev = table(spark, sf, "ev")
    cents = ev.groupBy("name").agg(F.sum(F.round(F.col("duration_ms") * 100).cast("long")).alias("total_cents"))
    return reports.tool_metrics(ev).drop("avg_ms").join(cents, "name")


@register(
    "scan_session_events",
    cte("ev", "SELECT event_id, session_id, name, status, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS INT) AS k FROM ev"),
)
def _(spark, sf):
    # the events are written as JSON lines and read back through the source
    from factloom.sources.corpus import scan_session_events

    path = scratch(spark, "session-events")
    ev = table(spark, sf, "ev")
    ev.select(
        F.col("ts").alias("timestamp"), "session_id", F.lit("tool").alias("channel"), F.lit("call").alias("event_type"), "name", "status", "duration_ms",
        F.col("event_id").cast("string").alias("call_id"), F.col("props").alias("payload"),
    ).write.json(path)
    back = scan_session_events(spark, path)
    k = F.variant_get(F.parse_json("payload"), "$.k", "int")
    return back.select(F.col("call_id").cast("long").alias("event_id"), "session_id", "name", "status", k.alias("k"))


@register("recent_events", cte("ev", "SELECT event_id AS seq, session_id, name FROM ev ORDER BY event_id DESC LIMIT 20"))
def _(spark, sf):
    return reports.recent_events(table(spark, sf, "ev").select(F.col("event_id").alias("seq"), "session_id", "name"))


@register("archive_split", "WITH j AS (SELECT 'c' || conv_id AS journal_id, turn AS seq FROM conversations), n AS (SELECT journal_id, count(*) AS n, min(seq) AS lo FROM j GROUP BY 1) SELECT journal_id, seq, n > 4 AND seq - lo < n // 2 AS archived FROM j JOIN n USING (journal_id)")
def _(spark, sf):
    j = table(spark, sf, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("journal_id"), F.col("turn").alias("seq"))
    return reports.archive_split(j, 4)


# ---- manifests and staleness ---------------------------------------------------------------------------


@register(
    "manifest_info",
    cte("manifest", "SELECT 'r' || n_nationkey AS corpus, count(DISTINCT layer) AS manifests, count(req_id) AS requirements FROM nation LEFT JOIN manifest ON rfc = 'r' || n_nationkey GROUP BY 1"),
)
def _(spark, sf):
    m = table(spark, sf, "manifest").select(F.col("rfc").alias("corpus"), F.col("layer").alias("path"), "req_id")
    return reports.manifest_info(m, table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("corpus")))


@register(
    "validate_manifest",
    """WITH m AS (SELECT 'm' || c_nationkey AS path, CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE 'doc' END AS rfc, CASE WHEN c_nationkey = 3 THEN NULL ELSE 'q' || (c_custkey % 60) END AS req_id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS text, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '1' END AS section,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'must' WHEN 'MACHINERY' THEN 'Shall' WHEN 'HOUSEHOLD' THEN 'NEVER' ELSE 'MAY' END AS level FROM customer), r AS (SELECT * FROM m WHERE req_id IS NOT NULL)
SELECT path, req_id, 'missing_text' AS rule FROM r WHERE text = '' UNION ALL SELECT path, req_id, 'missing_section' FROM r WHERE section IS NULL UNION ALL SELECT path, req_id, 'level_synonym' FROM r WHERE level = 'Shall' UNION ALL SELECT path, req_id, 'invalid_level' FROM r WHERE level = 'NEVER'
UNION ALL SELECT path, req_id, 'duplicate_id' FROM r GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT path, NULL, 'missing_document' FROM m GROUP BY path HAVING max(rfc) = '' UNION ALL SELECT path, NULL, 'missing_requirements' FROM m GROUP BY path HAVING count(req_id) = 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return reports.validate_manifest(
        c.select(
            F.concat(F.lit("m"), "c_nationkey").alias("path"),
            F.when(F.col("c_nationkey") % 6 == 0, "").otherwise("doc").alias("rfc"),
            F.when(F.col("c_nationkey") != 3, F.concat(F.lit("q"), (F.col("c_custkey") % 60).cast("string"))).alias("req_id"),
            F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("text"),
            F.when(F.col("c_custkey") % 9 != 0, "1").alias("section"),
            F.when(seg == "BUILDING", "must").when(seg == "MACHINERY", "Shall").when(seg == "HOUSEHOLD", "NEVER").otherwise("MAY").alias("level"),
        )
    )


@register(
    "manifest_staleness",
    """WITH m AS (SELECT 'm' || doc_id AS path, 'd' || doc_id AS source, sha256(CASE WHEN n_chars % 5 = 0 THEN text || ' ' ELSE text END) AS content_hash, CASE WHEN n_chars % 11 = 0 THEN 'other' ELSE '' END AS obsoleted_by FROM documents), d AS (SELECT 'd' || doc_id AS source, sha256(text) AS h FROM documents WHERE lang <> 'de')
SELECT path, m.source, h = content_hash AS hash_match, coalesce(h <> content_hash, false) OR obsoleted_by <> '' AS is_stale FROM m LEFT JOIN d USING (source)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    source = F.concat(F.lit("d"), "doc_id")
    seen = F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    meta = d.select(
        F.concat(F.lit("m"), "doc_id").alias("path"), source.alias("source"), F.sha2(F.encode(seen, "utf-8"), 256).alias("content_hash"),
        F.when(F.col("n_chars") % 11 == 0, "other").otherwise("").alias("obsoleted_by"),
    )
    return reports.manifest_staleness(meta, d.filter("lang <> 'de'").select(source.alias("source"), "text"))


@register(
    "index_staleness",
    """WITH b AS (SELECT source AS corpus, 'd' || doc_id AS path, CAST(n_chars AS DOUBLE) AS mtime, doc_id, n_chars, lang FROM documents), m AS (SELECT corpus, path, CASE WHEN n_chars % 97 = 0 THEN NULL ELSE mtime END AS was FROM b WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)), f AS (SELECT corpus, path, CASE WHEN n_chars % 61 = 0 THEN mtime + 2 WHEN n_chars % 61 = 1 THEN mtime + 1 ELSE mtime END AS now FROM b WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
, j AS (SELECT coalesce(m.corpus, f.corpus) AS corpus, m.path IS NOT NULL AS known, was, now FROM m FULL JOIN f USING (corpus, path)), a AS (SELECT corpus, count(*) FILTER (known) AS total_files, count(*) FILTER (known AND (was IS NULL OR now IS NULL OR abs(now - was) > 1)) AS changed_files, count(*) FILTER (NOT known) AS new_files FROM j GROUP BY 1)
SELECT *, CASE WHEN total_files = 0 THEN 'stale_major' WHEN changed_files = 0 THEN 'fresh' WHEN changed_files * 10 < total_files THEN 'stale_minor' ELSE 'stale_major' END AS status FROM a""",
)
def _(spark, sf):
    n = F.col("n_chars")
    b = table(spark, sf, "documents").select(
        F.col("source").alias("corpus"), F.concat(F.lit("d"), "doc_id").alias("path"), n.cast("double").alias("t"), "n_chars", "doc_id"
    )
    labels = table(spark, sf, "labels")
    meta = b.join(labels.filter("quality = 0"), "doc_id", "left_anti").select("corpus", "path", F.when(n % 97 != 0, F.col("t")).alias("mtime"))
    files = b.join(labels.filter("toxic = 1"), "doc_id", "left_anti").select(
        "corpus", "path", F.when(n % 61 == 0, F.col("t") + 2).when(n % 61 == 1, F.col("t") + 1).otherwise(F.col("t")).alias("mtime")
    )
    return reports.index_staleness(meta, files)


@register(
    "classify_files",
    """SELECT 'd' || doc_id AS path, sha256(text) AS sha256, n_chars % 7 <> 0 AND doc_id IN (SELECT doc_id FROM labels) AS cache_hit FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    files = d.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    # the index knows an older text of some documents, and facts of the labelled ones only
    old = F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    meta = d.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(F.encode(old, "utf-8"), 256).alias("sha256"))
    facts = table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id").alias("path"))
    return reports.classify_files(files, meta, [facts])


# ---- lint ------------------------------------------------------------------------------------------------

_D = "SELECT '{code}' AS code, '{sev}' AS severity, path, {line} AS line, {subject} AS subject, {detail} AS detail FROM "


def _dg(code, sev, line="line", subject="CAST(NULL AS VARCHAR)", detail="CAST(NULL AS VARCHAR)"):
    return _D.format(code=code, sev=sev, line=line, subject=subject, detail=detail)


_BRACES = """, br AS (SELECT path, line, pos, CASE WHEN ch = '{' THEN 1 ELSE -1 END AS d FROM (SELECT path, line, CAST(p - 1 AS INT) AS pos, code[p] AS ch FROM (SELECT path, line, CASE WHEN starts_with(text, '#lang') THEN text ELSE string_split(text, '#')[1] END AS code FROM lines) AS c, unnest(range(1, length(code) + 1)) AS u(p)) AS z WHERE ch IN ('{', '}'))
, rn AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY line, pos) AS s FROM br), mn AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY path ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM rn)
, tot AS (SELECT path, sum(d) - least(0, min(s)) AS open FROM rn GROUP BY path), lst AS (SELECT path, max(line) AS line FROM lines GROUP BY path) """
_DECLS = """, dc AS (SELECT path, line, regexp_extract(text, '^(relation|function|type|individual)\\s+\\w+', 1) AS kw, regexp_extract(text, '^\\w+\\s+(\\w+)', 1) AS name FROM lines WHERE regexp_matches(text, '^(relation|function|type|individual)\\s+\\w+')) """
_TAGC = """, tc AS (SELECT path, line, regexp_extract(text, '#\\s*tag\\s*=\\s*(\\w+)', 1) AS v FROM lines WHERE regexp_matches(text, '#\\s*tag\\s*=\\s*\\w+')) """

_LINT_SQL = {
    "missing_header": _dg("missing_header", "warning", "0") + "src WHERE NOT starts_with(content, '#lang')",
    "unmatched_brace": _BRACES + _dg("unmatched_brace", "error", subject="'}'", detail="CAST(pos AS VARCHAR)") + "mn WHERE s < low UNION ALL "
    + _dg("unmatched_brace", "error", subject="'{'", detail="CAST(open AS VARCHAR)") + "tot JOIN lst USING (path) WHERE open > 0",
    "missing_init": _DECLS + ", ini AS (SELECT path, regexp_extract(text, '^\\s*(\\w+)', 1) AS name FROM (SELECT *, lag(text) OVER (PARTITION BY path ORDER BY line) AS pv FROM lines) AS x WHERE pv = 'after init {' AND contains(text, ':=')), mx AS (SELECT path, name, max(line) AS line FROM dc WHERE kw IN ('relation', 'function') GROUP BY 1, 2) "
    + _dg("missing_init", "warning", subject="name") + "mx ANTI JOIN ini USING (path, name)",
    "empty_init": _dg("empty_init", "warning") + "lines WHERE regexp_matches(text, 'after\\s+init\\s*\\{\\s*\\}')",
    "duplicate_decl": _DECLS + ", ft AS (SELECT path, name, min(line) AS f FROM dc GROUP BY 1, 2) " + _dg("duplicate_decl", "error", subject="name", detail="CAST(f + 1 AS VARCHAR)") + "dc JOIN ft USING (path, name) WHERE line > f",
    "unguarded_action": ", nx AS (SELECT *, lead(text) OVER (PARTITION BY path ORDER BY line) AS n1 FROM lines) " + _dg("unguarded_action", "hint", subject="regexp_extract(text, 'action (\\w+)', 1)") + "nx WHERE starts_with(text, 'action quick_')",
    "duplicate_tag_value": _TAGC + ", ft AS (SELECT path, v, min(line) AS f FROM tc WHERE regexp_matches(v, '^\\d+$') GROUP BY 1, 2) " + _dg("duplicate_tag_value", "warning", subject="v", detail="CAST(f + 1 AS VARCHAR)") + "tc JOIN ft USING (path, v) WHERE line > f",
    "placeholder_tag": _TAGC + _dg("placeholder_tag", "info", subject="v") + "tc WHERE NOT regexp_matches(v, '^\\d+$')",
    "lowercase_param": _dg("lowercase_param", "error", subject="trim(regexp_extract(p, '^([^:]*)', 1))", detail="kw") + "(SELECT path, line, regexp_extract(text, '^\\s*(relation|function)', 1) AS kw, unnest(string_split(regexp_extract(text, '\\(([^)]+)\\)', 1), ',')) AS p FROM lines WHERE regexp_matches(text, '^\\s*(relation|function)\\s+[\\w.]+\\s*\\(')) AS x WHERE regexp_matches(trim(p), '^[a-z]')",
    "commented_requirement": ", nb AS (SELECT *, lag(text) OVER w AS p1, lag(text, 2) OVER w AS p2, lead(text) OVER w AS n1 FROM lines WINDOW w AS (PARTITION BY path ORDER BY line)) SELECT 'commented_requirement' AS code, CASE WHEN regexp_matches(lower(coalesce(p1, '') || ' ' || coalesce(p2, '') || ' ' || coalesce(n1, '')), 'todo|fixme|disabled|skip|intentional') THEN 'info' ELSE 'hint' END AS severity, path, line, 'require' AS subject, CAST(NULL AS VARCHAR) AS detail FROM nb WHERE starts_with(text, '#require ')",
    "missing_tag": _dg("missing_tag", "hint", subject="regexp_extract(text, '^\\s*(\\w+)', 1)") + "lines WHERE regexp_matches(text, '^\\s*(require|ensure|assume|assert)\\s+.+;\\s*$')",
    "missing_finalize": _dg("missing_finalize", "warning", "0") + "src WHERE contains(path, '_test.spec') AND contains(content, chr(10) || 'export action')",
}

for _rule, _sql in _LINT_SQL.items():
    register(f"lint_{_rule}", ON_LINES(_sql))(
        lambda spark, sf, fn=lint.TEXT_RULES[_rule]: fn(table(spark, sf, "src"))
    )

_ALL = ", all_d AS (" + " UNION ALL ".join(
    "SELECT * FROM (" + "WITH " + s[1:].strip() + ")" if s.startswith(",") else s for s in _LINT_SQL.values()
) + ") "


def _diags(spark, sf):
    return [lint.text_diagnostics(table(spark, sf, "src"))]


@register("all_diagnostics", ON_LINES(_ALL + "SELECT * FROM all_d WHERE severity IN ('error', 'warning') AND regexp_matches(path, '/layer[12]/')"))
def _(spark, sf):
    return lint.all_diagnostics(_diags(spark, sf), table(spark, sf, "file_layers"), ["layer1", "layer2"], "warning")


@register("diagnostics_counts", ON_LINES(_ALL + "SELECT code, severity, count(*) AS n FROM all_d GROUP BY 1, 2"))
def _(spark, sf):
    return lint.diagnostics_counts(lint.all_diagnostics(_diags(spark, sf)))


@register("filter_severity", ON_LINES(_ALL + "SELECT * FROM all_d WHERE severity IN ('error', 'warning', 'info')"))
def _(spark, sf):
    return filters.filter_severity(lint.all_diagnostics(_diags(spark, sf)), "info")


@register("filter_mode", ON_LINES(_ALL + "SELECT * FROM all_d WHERE severity = 'error'"))
def _(spark, sf):
    return filters.filter_mode(lint.all_diagnostics(_diags(spark, sf)), "basic")


@register(
    "lint_unresolved_include",
    ON_LINES(
        """, inc AS (SELECT path, line, regexp_extract(text, '^include (\\w+)', 1) AS nm FROM lines WHERE regexp_matches(text, '^include \\w+')), st AS (SELECT DISTINCT regexp_extract(path, '([^/]+)\\.spec$', 1) AS stem FROM src)
, bad AS (SELECT * FROM inc WHERE nm NOT IN (SELECT stem FROM st)), nr AS (SELECT nm, min(stem) AS s FROM (SELECT DISTINCT nm FROM bad) JOIN st ON levenshtein(nm, stem) <= 2 GROUP BY nm)
SELECT CASE WHEN s IS NULL THEN 'unresolved_include' ELSE 'near_miss' END AS code, CASE WHEN s IS NULL THEN 'error' ELSE 'warning' END AS severity, path, line, bad.nm AS subject, s AS detail FROM bad LEFT JOIN nr USING (nm)"""
    ),
)
def _(spark, sf):
    src = table(spark, sf, "src")
    return lint.lint_unresolved_include(symbols.extract_includes(src), src)


@register("lint_no_monitor", cte("actions reqs", _dg("no_monitor", "hint", subject="name") + "actions WHERE name NOT IN (SELECT monitor_action FROM reqs)"))
def _(spark, sf):
    return lint.lint_no_monitor(table(spark, sf, "actions"), table(spark, sf, "reqs"))


@register(
    "lint_no_monitor_scoped",
    cte("actions reqs exports", _dg("no_monitor", "hint", subject="name") + "actions WHERE name NOT IN (SELECT monitor_action FROM reqs WHERE kind = 'ensure' AND mixin_kind = 'around') AND name IN (SELECT name FROM exports)"),
)
def _(spark, sf):
    return lint.lint_no_monitor(
        table(spark, sf, "actions"), table(spark, sf, "reqs").filter("kind = 'ensure' AND mixin_kind = 'around'"), table(spark, sf, "exports")
    )


@register(
    "lint_export_no_monitor",
    ON_LINES(_dg("no_monitor", "hint", subject="regexp_extract(text, 'action (\\w+)', 1)", detail="'exported'") + "lines WHERE starts_with(text, 'export action ')"),
)
def _(spark, sf):
    src = table(spark, sf, "src")
    return lint.lint_export_no_monitor(cut_lineage(patterns.detect_monitors(src)), symbols.extract_symbols(src))


@register(
    "lint_high_impact_var",
    cte(
        "vars reads reqs",
        ", n AS (SELECT var, count(DISTINCT r.id) AS c, count(DISTINCT path) AS f FROM reads r JOIN reqs USING (id) GROUP BY var HAVING count(DISTINCT r.id) >= 5) " + _dg("high_impact_var", "info", subject="name", detail="c || '/' || f") + "vars JOIN n ON var = id",
    ),
)
def _(spark, sf):
    return lint.lint_high_impact_var(table(spark, sf, "vars"), table(spark, sf, "reads"), table(spark, sf, "reqs"))


_INT = ", tg AS (SELECT path, line, i, string_split(tags[i], ':')[-1] AS last FROM annotations, unnest(range(1, len(tags) + 1)) AS u(i)), it AS (SELECT path, line, i, CAST(last AS BIGINT) AS n FROM tg WHERE regexp_matches(last, '^\\d+$')) "


@register(
    "lint_tag_duplicate",
    cte("annotations", _INT + ", ft AS (SELECT path, n, min((line, i)) AS f FROM it GROUP BY 1, 2) " + _dg("tag_duplicate", "warning", subject="CAST(n AS VARCHAR)", detail="CAST(f[1] + 1 AS VARCHAR)") + "it JOIN ft USING (path, n) WHERE (line, i) > f"),
)
def _(spark, sf):
    return lint.lint_tag_duplicate(table(spark, sf, "annotations"))


@register(
    "lint_tag_gap",
    cte(
        "annotations",
        _INT
        + """, t AS (SELECT path, n, min(line) AS line FROM it GROUP BY 1, 2), sp AS (SELECT path, count(*) AS c, min(n) AS lo, max(n) AS hi FROM t GROUP BY 1), ok AS (SELECT * FROM sp WHERE c >= 5 AND (hi - lo + 1 - c) / (hi - lo + 1) < 0.3)
, ms AS (SELECT path, unnest(range(lo, hi + 1)) AS n FROM ok EXCEPT SELECT path, n FROM t)
SELECT 'tag_gap' AS code, 'info' AS severity, ms.path, coalesce(b.line, a.line, 0) AS line, CAST(ms.n AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS detail FROM ms LEFT JOIN t b ON b.path = ms.path AND b.n = ms.n - 1 LEFT JOIN t a ON a.path = ms.path AND a.n = ms.n + 1""",
    ),
)
def _(spark, sf):
    return lint.lint_tag_gap(table(spark, sf, "annotations"))


@register(
    "lint_orphan_tag",
    cte(
        "annotations manifest",
        ", tg AS (SELECT path, line, unnest(tags) AS tag FROM annotations), ok AS (SELECT DISTINCT tag FROM tg JOIN manifest ON req_id = tag OR (contains(tag, ':') AND starts_with(req_id, tag || '.')) OR (NOT contains(tag, ':') AND (section = tag OR starts_with(section, tag || '.')))) "
        + _dg("orphan_tag", "warning", subject="tag") + "tg WHERE tag NOT IN (SELECT tag FROM ok)",
    ),
)
def _(spark, sf):
    return lint.lint_orphan_tag(table(spark, sf, "annotations"), table(spark, sf, "manifest"))


@register(
    "lint_unguarded_write",
    cte(
        "actions vars writes reads",
        """, w AS (SELECT path, line, var FROM writes WHERE var NOT IN (SELECT var FROM reads)), a AS (SELECT path, line, min(name) AS name FROM actions GROUP BY 1, 2)
, u AS (SELECT path, line, 0 AS o, name, NULL AS var FROM a UNION ALL SELECT path, line, 1, NULL, var FROM w), f AS (SELECT path, var, last_value(CASE WHEN name IS NOT NULL THEN (line, name) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line, o) AS own FROM u)
, pl AS (SELECT DISTINCT path, own[1] AS line, own[2] AS act, var FROM f WHERE var IS NOT NULL AND own IS NOT NULL AND var IN (SELECT id FROM vars)) """
        + _dg("unguarded_write", "hint", subject="act", detail="var") + "pl UNION ALL " + _dg("unguarded_write", "hint", subject="''", detail="id") + "vars WHERE id IN (SELECT var FROM w) AND id NOT IN (SELECT var FROM pl)",
    ),
)
def _(spark, sf):
    w = table(spark, sf, "writes").withColumnRenamed("var", "var_name")
    return lint.lint_unguarded_write(table(spark, sf, "actions"), table(spark, sf, "vars"), w, table(spark, sf, "reads"))


@register("lint_dead_guard", cte("reqs", _dg("dead_guard", "info", subject="monitor_action") + "reqs WHERE formula_text = 'false'"))
def _(spark, sf):
    return lint.lint_dead_guard(table(spark, sf, "reqs"))


@register("lint_orphan_hook", cte("reqs actions", _dg("orphan_hook", "warning", subject="monitor_action") + "reqs WHERE monitor_action NOT IN (SELECT name FROM actions)"))
def _(spark, sf):
    return lint.lint_orphan_hook(table(spark, sf, "reqs"), table(spark, sf, "actions"))


@register("lint_unused_state_var", cte("vars reads", _dg("unused_state_var", "hint", subject="name") + "vars WHERE id NOT IN (SELECT var FROM reads)"))
def _(spark, sf):
    return lint.lint_unused_state_var(table(spark, sf, "vars"), _reads_edges(spark, sf))


@register(
    "lint_shadow_declaration",
    cte(
        "symbols",
        """, pl AS (SELECT corpus, name, kind, path, min(line) AS line FROM symbols GROUP BY ALL), x AS (SELECT s.corpus, s.name, s.kind, s.path, s.line, min((o.path, o.line)) AS o FROM symbols s JOIN pl o ON o.corpus = s.corpus AND o.name = s.name AND o.kind = s.kind AND o.path <> s.path GROUP BY ALL) """
        + _dg("shadow_declaration", "hint", subject="name", detail="o[1]") + "x",
    ),
)
def _(spark, sf):
    return lint.lint_shadow_declaration(navigate.shadow_declarations(table(spark, sf, "symbols")))


# ---- search, pages, lists ----------------------------------------------------------------------------------


@register(
    "search_documents",
    "SELECT 'd' || doc_id AS doc, text AS title, text AS abstract, CASE lang WHEN 'en' THEN 'Proposed Standard' WHEN 'de' THEN 'Draft Standard' WHEN 'fr' THEN 'Informational' ELSE lang END AS status FROM documents WHERE contains(lower(text), 'the')",
)
def _(spark, sf):
    code = F.when(F.col("lang") == "en", "ps").when(F.col("lang") == "de", "ds").when(F.col("lang") == "fr", "inf").otherwise(F.col("lang"))
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("doc"), F.col("text").alias("title"), F.col("text").alias("abstract"), code.alias("status")
    )
    return documents.search_documents(d, "The")


@register("paginate", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer) > 60 AS has_more FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return reports.paginate(c, [F.col("c_acctbal").desc(), "c_custkey"], 40, 20).select("c_custkey", "c_name", "total", "has_more")


@register("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def _(spark, sf):
    return reports.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), "p_partkey"], 25)


@register(
    "truncate_lists",
    "WITH x AS (SELECT l_suppkey AS supp, l_orderkey AS item FROM lineitem), r AS (SELECT supp, item, row_number() OVER (PARTITION BY supp ORDER BY item) AS rank, count(*) OVER (PARTITION BY supp) AS original_count FROM x) SELECT supp, item, rank, original_count, original_count > 7 AS truncated FROM r WHERE rank <= 7",
)
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("item"))
    return reports.truncate_lists(x, "supp", "item", 7)


# ---- maintenance -----------------------------------------------------------------------------------------


@register(
    "id_diff",
    "WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O') SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b USING (id)",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return maintain.id_diff(li.filter("l_returnflag = 'A'").select("l_orderkey"), li.filter("l_linestatus = 'O'").select("l_orderkey"))


_EDGES = ", ed AS (SELECT DISTINCT id AS src, 'CONSTRAINS' AS etype, monitor_action AS dst FROM reqs UNION ALL SELECT id, 'READS', var FROM reads UNION ALL SELECT DISTINCT path || ':' || line || ':write:' || var, 'WRITES', var FROM writes) "


def _all_edges(spark, sf):
    w = table(spark, sf, "writes").select(
        F.concat_ws(":", "path", "line", F.lit("write"), "var").alias("src"), F.lit("WRITES").alias("etype"), F.col("var").alias("dst")
    ).distinct()
    return _constrains(spark, sf).unionByName(_reads_edges(spark, sf)).unionByName(w)


def _node_table(spark, sf, tier=1):
    part = lambda n: table(spark, sf, n).select("id", "path", "line", F.lit(tier).alias("tier"))
    return part("reqs").unionByName(part("actions"))


@register(
    "remove_file",
    cte(
        "reqs reads writes actions",
        _EDGES + ", gone AS (SELECT id FROM reqs WHERE path = 'f7.spec' UNION SELECT id FROM actions WHERE path = 'f7.spec') SELECT etype, count(*) AS n FROM ed WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) AND NOT (etype = 'WRITES' AND starts_with(src, 'f7.spec:')) GROUP BY etype UNION ALL SELECT 'nodes', count(*) FROM (SELECT path FROM reqs UNION ALL SELECT path FROM actions) AS n WHERE path <> 'f7.spec'",
    ),
)
def _(spark, sf):
    out = maintain.remove_file(_node_table(spark, sf), _all_edges(spark, sf), "f7.spec")
    n = out["nodes"].agg(F.count("*").alias("n")).select(F.lit("nodes").alias("etype"), "n")
    return out["edges"].groupBy("etype").agg(F.count("*").alias("n")).unionByName(n)


@register(
    "upsert_file",
    cte(
        "reqs reads",
        """, nd AS (SELECT id, path, line, CASE WHEN line % 5 = 0 THEN 3 ELSE 1 END AS tier FROM reqs), nw AS (SELECT id, path, line + 1 AS line, 2 AS tier FROM reqs WHERE path = 'f9.spec' AND kind <> 'assert')
, kept AS (SELECT * FROM nd WHERE NOT (path = 'f9.spec' AND tier <= 2)), un AS (SELECT * FROM kept UNION ALL SELECT * FROM nw WHERE id NOT IN (SELECT id FROM kept))
SELECT path, tier, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM un GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    reqs = table(spark, sf, "reqs")
    nodes = reqs.select("id", "path", "line", F.when(F.col("line") % 5 == 0, 3).otherwise(1).alias("tier"))
    new = reqs.filter("path = 'f9.spec' AND kind <> 'assert'").select("id", "path", (F.col("line") + 1).alias("line"), F.lit(2).alias("tier"))
    e = _reads_edges(spark, sf)
    out = maintain.upsert_file(nodes, e, new, e.limit(0), "f9.spec", 2)
    return out["nodes"].groupBy("path", "tier").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@register(
    "overlay_merge",
    f"""WITH b AS (SELECT 'k' || c_custkey AS path, c_name AS content FROM customer), chg AS ({_CHG}), l AS (SELECT path, max_by(op, seq) AS op, arg_max_null(content, seq) AS content FROM chg GROUP BY path)
SELECT path, content, 'base' AS origin FROM b WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT path, content, 'overlay' FROM l WHERE op <> 'delete'""",
)
def _(spark, sf):
    base = table(spark, sf, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("path"), F.col("c_name").alias("content"))
    return maintain.overlay_merge(base, _changes(spark, sf))


@register(
    "remap_paths",
    cte("files", "SELECT regexp_replace(path, '^corpus1/', 'moved/one/') AS path, regexp_replace(path, '^corpus1/', 'moved/one/') || ':1:a' AS id FROM files"),
)
def _(spark, sf):
    f = table(spark, sf, "files").select("path", F.concat("path", F.lit(":1:a")).alias("id"))
    return maintain.remap_paths(f, "corpus1", "moved/one", ["path", "id"])


@register("clear_wiring", cte("reqs reads writes", _EDGES + "SELECT etype, count(*) AS n FROM ed WHERE etype <> 'READS' GROUP BY etype"))
def _(spark, sf):
    return maintain.clear_wiring(_all_edges(spark, sf)).groupBy("etype").agg(F.count("*").alias("n"))


@register("write_index")
def _(spark, sf):
    out = scratch(spark, "index")
    src = table(spark, sf, "src").select("path", "content")
    store.write_index({"files": src, **extract_facts(src)}, out)
    tables = store.load_index(spark, out)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, t in sorted(tables.items())]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


@register(
    "load_index",
    cte("reqs", "SELECT kind, mixin_kind, count(*) AS n, count(DISTINCT path) AS files FROM reqs GROUP BY 1, 2"),
)
def _(spark, sf):
    out = scratch(spark, "index")
    store.write_index({"requirements": table(spark, sf, "reqs"), "edges": _constrains(spark, sf)}, out)
    back = store.load_index(spark, out)["requirements"]
    return back.groupBy("kind", "mixin_kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@register(
    "merge_indexes",
    cte(
        "reqs",
        ", a AS (SELECT id, path, line FROM reqs WHERE kind <> 'ensure'), b AS (SELECT id, path, line + 5 AS line FROM reqs WHERE mixin_kind <> 'around') SELECT coalesce(b.id, a.id) AS id, coalesce(b.path, a.path) AS path, coalesce(b.line, a.line) AS line FROM a FULL JOIN b USING (id)",
    ),
)
def _(spark, sf):
    reqs = table(spark, sf, "reqs")
    one, two = scratch(spark, "index-a"), scratch(spark, "index-b")
    edges = _constrains(spark, sf)
    store.write_index({"requirements": reqs.filter("kind <> 'ensure'").select("id", "path", "line"), "edges": edges}, one)
    b = reqs.filter("mixin_kind <> 'around'").select("id", "path", (F.col("line") + 5).alias("line"))
    store.write_index({"requirements": b, "edges": edges}, two)
    return store.merge_indexes(spark, [one, two])["requirements"]


# ---- from text to report -----------------------------------------------------------------------------------


@register(
    "corpus_coverage",
    ON_LINES(
        """, t AS (SELECT path, line, trim(text) AS text FROM lines), u AS (SELECT path, line, CASE WHEN starts_with(text, '#')
  THEN CASE WHEN contains(substr(regexp_replace(text, '\\[[\\w:.,\\s]+\\]\\s*$', ''), 2), '#') THEN '' ELSE regexp_extract(text, '\\[([\\w:.,\\s]+)\\]\\s*$', 1) END
  ELSE regexp_extract(text, '#\\s*\\[([\\w:.,\\s]+)\\]\\s*$', 1) END AS raw FROM t)
, tg AS (SELECT DISTINCT trim(unnest(string_split(raw, ','))) AS tag FROM u WHERE raw <> '' AND regexp_matches(raw, '[A-Za-z.:]'))
, man AS (SELECT DISTINCT 'r' || (p_partkey % 5) || ':' || (p_partkey % 7) || '.' || p_size AS req_id, CASE p_size % 4 WHEN 0 THEN 'MUST' WHEN 1 THEN 'MAY' ELSE 'SHOULD' END AS level, (p_partkey % 7) || '.' || p_size AS section FROM part)
, ex AS (SELECT tag FROM tg WHERE tag IN (SELECT req_id FROM man)), cov AS (SELECT req_id FROM man WHERE req_id IN (SELECT tag FROM ex) UNION SELECT req_id FROM man JOIN tg ON (contains(tag, ':') AND starts_with(req_id, tag || '.')) OR (NOT contains(tag, ':') AND (section = tag OR starts_with(section, tag || '.'))) WHERE tag NOT IN (SELECT tag FROM ex))
, mk AS (SELECT man.*, req_id IN (SELECT req_id FROM cov) AS covered FROM man)
SELECT 'total' AS grouping, '' AS value, count(*) AS total, count(*) FILTER (covered) AS covered FROM mk UNION ALL SELECT 'level', level, count(*), count(*) FILTER (covered) FROM mk GROUP BY level UNION ALL SELECT 'layer', 'unspecified', count(*), count(*) FILTER (covered) FROM mk"""
    ),
)
def corpus_coverage(spark, sf):
    size, k = F.col("p_size"), F.col("p_partkey")
    man = table(spark, sf, "part").select(
        F.concat(F.lit("r"), k % 5, F.lit(":"), k % 7, F.lit("."), size).alias("req_id"),
        F.when(size % 4 == 0, "MUST").when(size % 4 == 1, "MAY").otherwise("SHOULD").alias("level"),
        F.lit("").alias("layer"),
    ).distinct()
    annotations = symbols.extract_annotations(table(spark, sf, "src"))
    return coverage.coverage_stats(man, annotations).select("grouping", "value", "total", "covered")



