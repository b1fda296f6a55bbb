"""Queries over fact tables: tags, coverage, resolution, wiring, graph, navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import coverage, filters, graph, navigate, patterns, resolve, symbols, tags, wiring
from factloom.plans.lineage import cut_lineage
from workload.derived import LINES, cte, scratch, table
from workload.extraction import NESTED
from workload.registry import register

ON_LINES = lambda body: cte("src", LINES + body)

# ---- tag resolution and coverage --------------------------------------------------------------------

# which manifest ids a tag names, said with LIKE instead of exploded names
_RESOLVE = """, tg AS (SELECT DISTINCT unnest(tags) AS tag FROM annotations), ex AS (SELECT tag, tag AS key FROM tg WHERE tag IN (SELECT req_id FROM manifest))
, rs AS (SELECT * FROM ex UNION ALL SELECT DISTINCT tag, req_id AS key FROM tg JOIN manifest ON (contains(tag, ':') AND starts_with(req_id, tag || '.'))
  OR (NOT contains(tag, ':') AND (section = tag OR starts_with(section, tag || '.'))) WHERE tag NOT IN (SELECT tag FROM ex))
, cov AS (SELECT DISTINCT key FROM rs), mk AS (SELECT m.*, key IS NOT NULL AS covered FROM manifest AS m LEFT JOIN cov ON cov.key = m.req_id)
"""


def _man(spark, sf):
    return table(spark, sf, "manifest")


def _ann(spark, sf):
    return table(spark, sf, "annotations")


@register("resolve_tags", cte("manifest annotations", _RESOLVE + "SELECT tag, key FROM rs"))
def _(spark, sf):
    return tags.resolve_tags(tags.annotation_tags(_ann(spark, sf)), _man(spark, sf))


@register(
    "tag_ambiguity",
    cte(
        "manifest annotations",
        _RESOLVE
        + "SELECT tag, count(DISTINCT string_split(key, ':')[1]) AS prefixes, count(*) AS keys FROM rs WHERE regexp_matches(tag, '^\\d+$') GROUP BY tag HAVING count(DISTINCT string_split(key, ':')[1]) > 1",
    ),
)
def _(spark, sf):
    return tags.tag_ambiguity(tags.annotation_tags(_ann(spark, sf)), _man(spark, sf))


@register(
    "orphan_tags",
    cte(
        "manifest annotations",
        _RESOLVE + "SELECT path, line, tag FROM (SELECT path, line, unnest(tags) AS tag FROM annotations) AS a WHERE tag NOT IN (SELECT tag FROM rs)",
    ),
)
def _(spark, sf):
    return tags.orphan_tags(_ann(spark, sf), _man(spark, sf)).select("path", "line", "tag")


_STATS = "count(*) AS total, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS uncovered"


@register(
    "coverage_stats",
    cte(
        "manifest annotations",
        _RESOLVE
        + f""", g AS (SELECT 'total' AS grouping, '' AS value, {_STATS} FROM mk UNION ALL SELECT 'level', CASE WHEN level = '' THEN 'UNKNOWN' ELSE level END, {_STATS} FROM mk GROUP BY 2
UNION ALL SELECT 'layer', CASE WHEN layer = '' THEN 'unspecified' ELSE layer END, {_STATS} FROM mk GROUP BY 2) SELECT grouping, value, total, covered, uncovered, CAST(covered * 1000 // total AS BIGINT) AS per_mille FROM g""",
    ),
)
def _(spark, sf):
    s = coverage.coverage_stats(_man(spark, sf), _ann(spark, sf)).drop("percent")
    return s.withColumn("per_mille", F.floor(F.col("covered") * 1000 / F.col("total")))


@register(
    "coverage_core",
    cte(
        "manifest annotations",
        _RESOLVE
        + f"""SELECT 'total' AS grouping, '' AS value, {_STATS} FROM mk UNION ALL SELECT 'level', level, {_STATS} FROM mk GROUP BY 2 UNION ALL SELECT 'layer', layer, {_STATS} FROM mk WHERE layer <> '' GROUP BY 2""",
    ),
)
def _(spark, sf):
    return coverage.coverage_core(_man(spark, sf), _ann(spark, sf))


@register(
    "coverage_graph",
    cte(
        "manifest reqs",
        _RESOLVE.replace("FROM annotations", "FROM reqs")
        + f"SELECT 'total' AS grouping, '' AS value, {_STATS} FROM mk UNION ALL SELECT 'level', level, {_STATS} FROM mk GROUP BY 2",
    ),
)
def _(spark, sf):
    return coverage.coverage_graph(_man(spark, sf), table(spark, sf, "reqs")).drop("percent")


@register(
    "wire_covers",
    cte(
        "manifest reqs",
        _RESOLVE.replace("FROM annotations", "FROM reqs")
        + "SELECT DISTINCT id AS src, 'COVERS' AS etype, key AS dst FROM (SELECT id, unnest(tags) AS tag FROM reqs) AS r JOIN rs USING (tag)",
    ),
)
def _(spark, sf):
    return tags.wire_covers(table(spark, sf, "reqs"), _man(spark, sf))


@register(
    "coverage_model",
    cte(
        "manifest reqs",
        _RESOLVE.replace("FROM annotations", "FROM reqs")
        + """, c AS (SELECT DISTINCT id FROM (SELECT id, unnest(tags) AS tag FROM reqs) AS r JOIN rs USING (tag))
SELECT kind, count(*) AS total, count(c.id) AS covered, count(*) - count(c.id) AS uncovered FROM reqs LEFT JOIN c USING (id) GROUP BY kind""",
    ),
)
def _(spark, sf):
    reqs = table(spark, sf, "reqs")
    return coverage.coverage_model(reqs, tags.first_covers(reqs, _man(spark, sf)))


@register(
    "coverage_by_doc",
    cte(
        "manifest annotations",
        """, tg AS (SELECT DISTINCT unnest(tags) AS tag FROM annotations) SELECT rfc, count(tag) AS covered, count(*) AS total FROM manifest LEFT JOIN tg ON tag = req_id GROUP BY rfc""",
    ),
)
def _(spark, sf):
    return coverage.coverage_by_doc(_man(spark, sf), _ann(spark, sf))


@register(
    "traceability_matrix",
    cte(
        "manifest annotations",
        _RESOLVE
        + """, pl AS (SELECT key, path, line, tag FROM (SELECT path, line, unnest(tags) AS tag FROM annotations) AS a JOIN rs USING (tag))
SELECT req_id, rfc, section, level, text, path, line, tag, path IS NOT NULL AS covered FROM manifest LEFT JOIN pl ON key = req_id""",
    ),
)
def _(spark, sf):
    return coverage.traceability_matrix(_man(spark, sf), _ann(spark, sf))


@register(
    "traceability_counts",
    cte(
        "manifest annotations",
        _RESOLVE
        + """, pl AS (SELECT key, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM annotations) AS a JOIN rs USING (tag) GROUP BY key)
SELECT req_id, level, coalesce(n, 0) AS places FROM manifest LEFT JOIN pl ON key = req_id""",
    ),
)
def _(spark, sf):
    return coverage.traceability_counts(_man(spark, sf), _ann(spark, sf))


_GAPS = (
    _RESOLVE.replace("FROM annotations", "FROM reqs")
    + """, gaps AS (SELECT 'unguarded_state_var' AS gap, id, CASE WHEN id IN (SELECT var FROM writes) THEN 'high' ELSE 'low' END AS severity, path FROM vars WHERE id NOT IN (SELECT var FROM reads)
UNION ALL SELECT 'uncovered_requirement', req_id, level, '' FROM mk WHERE NOT covered
UNION ALL SELECT 'orphan_requirement', id, kind, path FROM reqs WHERE monitor_action NOT IN (SELECT id FROM actions)) """
)
_GAP_TABLES = "manifest reqs vars reads writes actions"


def _gaps(spark, sf):
    t = {n: table(spark, sf, n) for n in _GAP_TABLES.split()}
    return coverage.coverage_gaps(t["vars"], t["reads"], t["writes"], t["manifest"], t["reqs"], t["actions"])


@register("coverage_gaps", cte(_GAP_TABLES, _GAPS + "SELECT * FROM gaps"))
def _(spark, sf):
    return _gaps(spark, sf)


@register("coverage_gap_counts", cte(_GAP_TABLES, _GAPS + "SELECT gap, severity, count(*) AS n FROM gaps GROUP BY gap, severity"))
def _(spark, sf):
    return coverage.coverage_gap_counts(_gaps(spark, sf))


# the baseline knows the annotations of an earlier date
_DIFF = (
    _RESOLVE
    + """, tb AS (SELECT DISTINCT unnest(tags) AS tag FROM annotations_before), rb AS (SELECT DISTINCT key FROM rs JOIN tb USING (tag))
, df AS (SELECT req_id, CASE WHEN rb.key IS NOT NULL AND NOT covered THEN 'new_gap' WHEN rb.key IS NULL AND covered THEN 'recovered' WHEN covered THEN 'unchanged_covered' ELSE 'unchanged_uncovered' END AS change, rb.key IS NOT NULL AS was, covered AS now
  FROM mk LEFT JOIN rb ON rb.key = req_id) """
)


def _diff(spark, sf):
    m, a = _man(spark, sf), _ann(spark, sf)
    return coverage.coverage_diff(coverage.coverage_ids(m, table(spark, sf, "annotations_before")), coverage.coverage_ids(m, a))


@register("coverage_diff", cte("manifest annotations annotations_before", _DIFF + "SELECT * FROM df"))
def _(spark, sf):
    return _diff(spark, sf)


@register(
    "coverage_diff_summary",
    cte(
        "manifest annotations annotations_before",
        _DIFF
        + """SELECT count(*) FILTER (change = 'new_gap') AS new_gaps, count(*) FILTER (change = 'recovered') AS recovered, count(*) FILTER (change = 'unchanged_covered') AS unchanged_covered,
count(*) FILTER (change = 'unchanged_uncovered') AS unchanged_uncovered, 'improved' AS direction FROM df""",
    ),
)
def _(spark, sf):
    return coverage.coverage_diff_summary(_diff(spark, sf)).select(
        "new_gaps", "recovered", "unchanged_covered", "unchanged_uncovered", "direction"
    )


# ---- selections --------------------------------------------------------------------------------------

_NODES = """, d AS (SELECT path, line, regexp_extract(text, '^\\s*(type|action|relation|function|individual|object|module|isolate)\\s+[\\w.]+', 1) AS node_type,
  regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS name FROM lines)
, nodes AS (SELECT path || ':' || (line + 1) || ':' || name AS id, node_type, name, path, line + 1 AS line FROM d WHERE node_type <> '') """


def _nodes(spark, sf):
    n = symbols.symbols_to_nodes(symbols.extract_symbols(table(spark, sf, "src")))
    return n.select("id", "node_type", "name", "path", "line")


@register("nodes_of_type", ON_LINES(_NODES + "SELECT * FROM nodes WHERE node_type = 'relation'"))
def _(spark, sf):
    return filters.nodes_of_type(_nodes(spark, sf), "relation")


@register("first_node_of_type", ON_LINES(_NODES + "SELECT * FROM nodes WHERE node_type = 'action' ORDER BY id LIMIT 1"))
def _(spark, sf):
    return filters.first_node_of_type(_nodes(spark, sf), "action")


@register("nodes_by_name", ON_LINES(_NODES + "SELECT * FROM nodes WHERE name = 'box_7'"))
def _(spark, sf):
    return filters.nodes_by_name(_nodes(spark, sf), "box_7")


@register("nodes_in_file", ON_LINES(_NODES + "SELECT * FROM nodes WHERE path = 'corpus1/layer1/p0/m1_server_behavior.spec'"))
def _(spark, sf):
    return filters.nodes_in_file(_nodes(spark, sf), "corpus1/layer1/p0/m1_server_behavior.spec")


@register("get_node", ON_LINES(_NODES + "SELECT * FROM nodes WHERE id = (SELECT min(id) FROM nodes)"))
def _(spark, sf):
    n = _nodes(spark, sf)
    return filters.get_node(n, n.agg(F.min("id").alias("id")).first()["id"])


@register("outgoing", cte("edges_dag", "SELECT src, 'INCLUDES' AS etype, dst FROM edges_dag WHERE src = 60"))
def _(spark, sf):
    return filters.outgoing(table(spark, sf, "edges_dag").withColumn("etype", F.lit("INCLUDES")), 60, "INCLUDES")


@register("incoming", cte("edges_dag", "SELECT src, 'INCLUDES' AS etype, dst FROM edges_dag WHERE dst = 6"))
def _(spark, sf):
    return filters.incoming(table(spark, sf, "edges_dag").withColumn("etype", F.lit("INCLUDES")), 6)


@register("filter_corpus", cte("files", "SELECT path, k FROM files WHERE contains(path, 'layer2')"))
def _(spark, sf):
    return filters.filter_corpus(table(spark, sf, "files").select("path", "k"), "layer2")


@register("filter_visible", cte("files", "SELECT path, k FROM files WHERE layer IN ('layer1', 'layer4')"))
def _(spark, sf):
    return filters.filter_visible(table(spark, sf, "files").select("path", "k"), table(spark, sf, "file_layers"), ["layer1", "layer4"])


@register(
    "classify_requirement",
    cte(
        "reqs",
        """SELECT id, CASE WHEN contains(formula_text, '_generating') THEN 'TESTER_ONLY' WHEN mixin_kind IN ('after', 'around') OR kind IN ('ensure', 'assert') THEN 'GUARANTEE' ELSE 'ASSUMPTION' END AS class FROM reqs""",
    ),
)
def _(spark, sf):
    return filters.classify_requirement(table(spark, sf, "reqs")).select("id", "class")


@register(
    "classify_direction",
    cte(
        "actions exports",
        """SELECT id, CASE WHEN name IN (SELECT name FROM exports WHERE direction = 'export') THEN 'GENERATED' WHEN name IN (SELECT name FROM exports WHERE direction = 'import') THEN 'RECEIVED' ELSE 'INTERNAL' END AS action_direction FROM actions""",
    ),
)
def _(spark, sf):
    return filters.classify_direction(table(spark, sf, "actions"), table(spark, sf, "exports")).select("id", "action_direction")


# ---- include resolution -------------------------------------------------------------------------------

_INC = """, inc AS (SELECT path AS from_path, regexp_extract(path, '^(.*)/', 1) AS dir, line, regexp_extract(text, '^include\\s+(\\w+)', 1) AS include_name FROM lines WHERE regexp_matches(text, '^include\\s+\\w+'))
, fs AS (SELECT path, regexp_extract(path, '([^/]+)\\.spec$', 1) AS stem, regexp_extract(path, '^(.*)/', 1) AS dir, layer FROM src) """


def _inc(spark, sf):
    return symbols.extract_includes(table(spark, sf, "src")).select("from_path", "include_name", "line")


@register(
    "resolve_includes",
    ON_LINES(
        _INC
        + """, own AS (SELECT path AS from_path, layer FROM src), c AS (
SELECT i.from_path, i.line, i.include_name, f.path AS to_path, 1 AS p FROM inc i JOIN fs f ON f.stem = i.include_name AND f.dir = i.dir
UNION ALL SELECT i.from_path, i.line, i.include_name, f.path, 2 FROM inc i JOIN own o USING (from_path) JOIN fs f ON f.stem = i.include_name AND f.layer = o.layer
UNION ALL SELECT i.from_path, i.line, i.include_name, f.path, 3 FROM inc i JOIN own o USING (from_path) JOIN fs f ON f.stem = i.include_name AND f.layer = 'layer0' AND o.layer IN ('layer1', 'layer2')
UNION ALL SELECT i.from_path, i.line, i.include_name, f.path, 4 FROM inc i JOIN own o USING (from_path) JOIN fs f ON f.stem = i.include_name AND f.layer = 'layer3' AND o.layer = 'layer1'
UNION ALL SELECT from_path, line, include_name, 'std/' || include_name, 9 FROM inc WHERE include_name = 'mising_1')
SELECT i.from_path, i.line, i.include_name, min_by(c.to_path, (c.p, c.to_path)) AS to_path FROM inc i LEFT JOIN c USING (from_path, line, include_name) GROUP BY ALL"""
    ),
)
def _(spark, sf):
    layers = spark.createDataFrame(
        [("layer0", []), ("layer1", ["layer0", "layer3"]), ("layer2", ["layer4", "layer0"])],
        "layer string, depends_on array<string>",
    )
    std = spark.createDataFrame([("mising_1", "std/mising_1")], "name string, path string")
    files, fl = table(spark, sf, "files"), table(spark, sf, "file_layers")
    active = ["layer0", "layer1", "layer2", "layer3"]
    return resolve.resolve_includes(_inc(spark, sf), files, fl, layers, std, active).drop("rule")


@register(
    "resolve_closest",
    ON_LINES(
        _INC
        + """, c AS (SELECT i.from_path, i.line, i.include_name, f.path, CASE WHEN f.dir = i.dir THEN 3 WHEN regexp_extract(f.dir, '^([^/]+/[^/]+)/', 1) = regexp_extract(i.dir, '^([^/]+/[^/]+)/', 1) THEN 2 WHEN string_split(f.dir, '/')[1] = string_split(i.dir, '/')[1] THEN 1 ELSE 0 END AS common FROM inc i JOIN fs f ON f.stem = i.include_name)
SELECT i.from_path, i.line, i.include_name, min_by(path, (-common, path)) AS to_path FROM inc i LEFT JOIN c USING (from_path, line, include_name) GROUP BY ALL"""
    ),
)
def _(spark, sf):
    return resolve.resolve_closest(_inc(spark, sf), table(spark, sf, "files"))


@register(
    "resolve_by_index",
    cte(
        "files includes",
        """, nm AS (SELECT DISTINCT include_name AS name FROM includes UNION SELECT 'nowhere'), tg AS (SELECT regexp_extract(to_path, '([^/]+)\\.spec$', 1) AS name, min(to_path) AS path FROM includes WHERE to_path IS NOT NULL GROUP BY 1)
, fl AS (SELECT stem AS name, min_by(path, (corpus, path)) AS path FROM files GROUP BY 1)
SELECT nm.name, coalesce(tg.path, fl.path) AS path, CASE WHEN tg.path IS NOT NULL THEN 0 WHEN fl.path IS NOT NULL THEN 1 END AS rank FROM nm LEFT JOIN tg USING (name) LEFT JOIN fl USING (name)""",
    ),
)
def _(spark, sf):
    inc = table(spark, sf, "includes")
    names = inc.select(F.col("include_name").alias("name")).unionByName(spark.createDataFrame([("nowhere",)], "name string")).distinct()
    return resolve.resolve_by_index(names, inc, table(spark, sf, "files"))


@register(
    "unresolved_includes",
    ON_LINES(_INC + "SELECT from_path, include_name, line FROM inc WHERE include_name NOT IN (SELECT stem FROM fs)"),
)
def _(spark, sf):
    return resolve.unresolved_includes(_inc(spark, sf), table(spark, sf, "files"))


# names with one or two edits against the supplier and customer names
@register(
    "near_miss",
    """WITH st AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || replace(lower(p_type), ' ', '') AS stem FROM part)
, nm AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN replace(lower(p_type), ' ', '') || '_' || replace(p_name, ' ', '_') WHEN 1 THEN 'x' || replace(p_name, ' ', '_') || '_' || replace(lower(p_type), ' ', '')
  WHEN 2 THEN substr(replace(p_name, ' ', '_') || '_' || replace(lower(p_type), ' ', ''), 3) ELSE 'zzz' || replace(p_name, ' ', '_') || 'q' END AS name FROM part)
, seg AS (SELECT name, min(stem) AS s FROM nm JOIN st ON list_sort(list_distinct(string_split(name, '_'))) = list_sort(list_distinct(string_split(stem, '_'))) AND name <> stem GROUP BY name)
, lev AS (SELECT name, min(stem) AS s FROM nm JOIN st ON levenshtein(name, stem) <= 2 AND name <> stem GROUP BY name)
SELECT nm.name, coalesce(seg.s, lev.s) AS suggestion FROM nm LEFT JOIN seg USING (name) LEFT JOIN lev USING (name)""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    name, kind = F.translate("p_name", " ", "_"), F.regexp_replace(F.lower("p_type"), " ", "")
    whole = F.concat_ws("_", name, kind)
    size = F.col("p_size") % 4
    asked = (
        F.when(size == 0, F.concat_ws("_", kind, name))
        .when(size == 1, F.concat(F.lit("x"), whole))
        .when(size == 2, F.substring(whole, 3, 1000))
        .otherwise(F.concat(F.lit("zzz"), name, F.lit("q")))
    )
    return resolve.near_miss(p.select(asked.alias("name")), p.select(whole.alias("stem")))


@register(
    "collisions",
    cte(
        "files",
        """SELECT stem, count(*) AS files, count(DISTINCT layer) AS layers, min(path) AS first_path, CASE WHEN count(DISTINCT layer) <= 1 THEN 'intra-layer' WHEN bool_or(layer = 'layer1') THEN 'cross-layer-in-scope' ELSE 'cross-boundary' END AS classification,
CASE WHEN count(DISTINCT layer) <= 1 THEN 'error' WHEN bool_or(layer = 'layer1') THEN 'warning' ELSE 'info' END AS severity FROM files GROUP BY stem HAVING count(*) > 1""",
    ),
)
def _(spark, sf):
    return resolve.collisions(table(spark, sf, "files"), table(spark, sf, "file_layers"), ["layer1"])


@register("entry_points", ON_LINES(_INC + "SELECT path FROM fs WHERE stem NOT IN (SELECT include_name FROM inc)"))
def _(spark, sf):
    return resolve.entry_points(table(spark, sf, "files"), _inc(spark, sf))


@register(
    "most_included",
    ON_LINES(_INC + "SELECT include_name, count(*) AS n FROM inc GROUP BY 1 ORDER BY n DESC, include_name LIMIT 30"),
)
def _(spark, sf):
    return resolve.most_included(_inc(spark, sf))


# ---- wiring -------------------------------------------------------------------------------------------


@register(
    "wire_reads",
    cte(
        "reqs vars",
        """, tk AS (SELECT DISTINCT id, unnest(regexp_extract_all(formula_text, '[A-Za-z_][A-Za-z0-9_.]*')) AS tok FROM reqs)
, ok AS (SELECT DISTINCT tok FROM tk WHERE tok IN (SELECT name FROM vars))
, sfx AS (SELECT id, unnest(string_split(tok, '.')) AS piece FROM tk WHERE tok NOT IN (SELECT tok FROM ok) UNION SELECT id, regexp_replace(tok, '^[^.]*\\.', '') FROM tk WHERE contains(tok, '.') AND tok NOT IN (SELECT tok FROM ok))
SELECT DISTINCT id AS src, 'READS' AS etype, tok AS dst FROM (SELECT id, tok FROM tk WHERE tok IN (SELECT tok FROM ok) UNION SELECT id, piece FROM sfx WHERE piece IN (SELECT name FROM vars)) AS x""",
    ),
)
def _(spark, sf):
    return wiring.wire_reads(table(spark, sf, "reqs"), table(spark, sf, "vars"))


@register("wire_constrains", cte("reqs", "SELECT DISTINCT id AS src, 'CONSTRAINS' AS etype, monitor_action AS dst FROM reqs"))
def _(spark, sf):
    return wiring.wire_constrains(table(spark, sf, "reqs"))


def _edges(df):
    return df.select(F.col("id").alias("src"), F.lit("READS").alias("etype"), F.col("var").alias("dst"))


_DEP = """, pr AS (SELECT p.id, kind = 'axiom' AS ax, var FROM props p JOIN prop_reads USING (id)), twoside AS (SELECT var FROM pr GROUP BY var HAVING bool_or(ax) AND NOT bool_and(ax)) """


@register(
    "wire_depends_on",
    cte(
        "props prop_reads",
        _DEP + "SELECT id AS src, 'SHARES' AS etype, var AS dst FROM pr JOIN twoside USING (var) WHERE NOT ax UNION SELECT var, 'AXIOM', id FROM pr JOIN twoside USING (var) WHERE ax",
    ),
)
def _(spark, sf):
    return wiring.wire_depends_on(table(spark, sf, "props"), _edges(table(spark, sf, "prop_reads")))


@register(
    "properties_on_axiom",
    cte(
        "props prop_reads",
        _DEP + "SELECT DISTINCT a.id AS axiom, b.id FROM pr a JOIN pr b USING (var) WHERE a.ax AND NOT b.ax AND a.id IN ('p0', 'p3', 'p9')",
    ),
)
def _(spark, sf):
    props = table(spark, sf, "props")
    e = wiring.wire_depends_on(props, _edges(table(spark, sf, "prop_reads")))
    asked = spark.createDataFrame([("p0",), ("p3",), ("p9",)], "id string")
    return graph.properties_on_axiom(e, props, asked).select("axiom", "id")


@register(
    "wire_depends_on_axioms",
    cte(
        "props prop_reads",
        _DEP + "SELECT DISTINCT b.id AS src, 'DEPENDS_ON' AS etype, a.id AS dst FROM pr a JOIN pr b USING (var) WHERE a.ax AND NOT b.ax AND a.id IN ('p0', 'p6')",
    ),
)
def _(spark, sf):
    asked = spark.createDataFrame([("p0",), ("p6",)], "id string")
    return wiring.wire_depends_on(table(spark, sf, "props"), _edges(table(spark, sf, "prop_reads")), asked)


@register(
    "wire_propagated",
    cte(
        "spec_reqs includes",
        "SELECT DISTINCT id AS src, 'PROPAGATED_FROM' AS etype, from_path AS dst FROM spec_reqs JOIN includes ON to_path = path",
    ),
)
def _(spark, sf):
    return wiring.wire_propagated(table(spark, sf, "spec_reqs"), table(spark, sf, "includes"))


@register(
    "wire_types",
    ON_LINES(
        _NODES
        + """, ty AS (SELECT name, min(id) AS tid FROM nodes WHERE node_type = 'type' GROUP BY name)
, dd AS (SELECT path || ':' || (line + 1) || ':' || regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS id, text, regexp_extract(text, '^\\s*(action|relation|function|individual)\\s', 1) AS kw FROM lines)
, us AS (SELECT id, 'HAS_PARAM' AS etype, trim(regexp_extract(p, ':([^:]*)$', 1)) AS t FROM (SELECT id, unnest(string_split(regexp_extract(text, '^\\s*\\w+\\s+[\\w.]+\\s*\\(([^)]*)\\)', 1), ',')) AS p FROM dd WHERE kw IN ('action', 'relation', 'function')) AS x
  UNION SELECT id, 'RETURNS_TYPE', CASE WHEN kw = 'action' THEN trim(regexp_extract(text, 'returns\\s*\\([^:)]*:([^)]*)\\)', 1)) ELSE trim(regexp_extract(text, ':\\s*(\\w+)\\s*$', 1)) END FROM dd WHERE kw IN ('action', 'function', 'individual'))
SELECT DISTINCT id AS src, etype, tid AS dst FROM us JOIN ty ON ty.name = us.t"""
    ),
)
def _(spark, sf):
    n = symbols.symbols_to_nodes(symbols.extract_symbols(table(spark, sf, "src")))
    return wiring.wire_types(n, n.filter("node_type = 'type'").select("id", "name"))


_REFNODES = (
    _NODES
    + """, f AS (SELECT path, line, regexp_extract(text, '^\\s*(?:action|relation|function)\\s+([\\w.]+)', 1) AS decl, regexp_extract(text, 'call\\s+([\\w.]+)\\s*(?:\\(|;|$)', 1) AS callee, text FROM lines)
, g AS (SELECT path, line, callee, last_value(nullif(decl, '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS src FROM f)
, refs AS (SELECT 'CALLS' AS etype, src AS s, callee AS t FROM g WHERE callee <> '' AND src IS NOT NULL
  UNION SELECT 'USES', regexp_extract(text, '^\\s*instance\\s+([\\w.]+)', 1), regexp_extract(text, '^\\s*instance\\s+[\\w.]+\\s*:\\s*([\\w.]+)', 1) FROM lines WHERE regexp_matches(text, '^\\s*instance\\s+[\\w.]+\\s*:\\s*[\\w.]+')
  UNION SELECT 'MONITORS', regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1), regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) FROM lines WHERE regexp_matches(text, '^\\s*(before|after|around)\\s+[\\w.]+'))
, nm AS (SELECT name, min(id) AS id FROM nodes GROUP BY name)
, re AS (SELECT DISTINCT a.id AS src, etype, b.id AS dst FROM refs JOIN nm a ON a.name = string_split(s, '.')[-1] JOIN nm b ON b.name = string_split(t, '.')[-1] WHERE a.id <> b.id) """
)


def _ref_edges(spark, sf):
    src = table(spark, sf, "src")
    s = symbols.extract_symbols(src)
    return wiring.wire_refs(symbols.extract_references(src, s), symbols.symbols_to_nodes(s))


@register("wire_refs", ON_LINES(_REFNODES + "SELECT * FROM re"))
def _(spark, sf):
    return _ref_edges(spark, sf)


@register(
    "call_hierarchy_in",
    ON_LINES(_REFNODES + "SELECT dst AS query, src AS id, etype FROM re WHERE etype IN ('CALLS', 'MONITORS') AND dst IN (SELECT id FROM nodes WHERE name IN ('act_5', 'act_10', 'act_77'))"),
)
def _(spark, sf):
    n = _nodes(spark, sf)
    q = n.filter(F.col("name").isin("act_5", "act_10", "act_77")).select("id")
    return navigate.call_hierarchy_in(_ref_edges(spark, sf), n, q).select("query", "id", "etype")


@register(
    "call_hierarchy_out",
    ON_LINES(_REFNODES + "SELECT src AS query, dst AS id, etype FROM re WHERE etype = 'CALLS' AND src IN (SELECT id FROM nodes WHERE name IN ('act_15', 'act_20', 'act_77'))"),
)
def _(spark, sf):
    n = _nodes(spark, sf)
    q = n.filter(F.col("name").isin("act_15", "act_20", "act_77")).select("id")
    return navigate.call_hierarchy_out(_ref_edges(spark, sf), n, q).select("query", "id", "etype")


@register(
    "wire_contains",
    ON_LINES(
        NESTED
        + """, i AS (SELECT *, path || ':' || (line + 1) || ':' || name AS id FROM s)
, box AS (SELECT path, qualified_name AS parent_qname, min(id) AS parent FROM i WHERE keyword IN ('object', 'module') GROUP BY 1, 2)
SELECT DISTINCT parent AS src, 'CONTAINS' AS etype, id AS dst FROM i JOIN box USING (path, parent_qname) WHERE parent <> id"""
    ),
)
def _(spark, sf):
    return wiring.wire_contains(symbols.extract_nested_symbols(table(spark, sf, "src")))


@register(
    "wire_includes_nodes",
    cte(
        "symbols",
        """, nd AS (SELECT path || ':' || line || ':' || name AS id, path, line FROM symbols), fn AS (SELECT path, min_by(id, (line, id)) AS node FROM nd GROUP BY path)
, inc AS (SELECT DISTINCT path AS from_path, 'f' || (line // 7 % 120) || '.spec' AS to_path FROM symbols)
SELECT DISTINCT a.node AS src, 'INCLUDES' AS etype, b.node AS dst FROM inc JOIN fn a ON a.path = from_path JOIN fn b ON b.path = to_path WHERE a.node <> b.node""",
    ),
)
def _(spark, sf):
    s = table(spark, sf, "symbols")
    nodes = s.select(F.concat_ws(":", "path", "line", "name").alias("id"), "path", "line")
    inc = s.select(
        F.col("path").alias("from_path"),
        F.concat(F.lit("f"), (F.floor(F.col("line") / 7) % 120).cast("string"), F.lit(".spec")).alias("to_path"),
    )
    return wiring.wire_includes_nodes(nodes, inc)


# ---- navigation ---------------------------------------------------------------------------------------

_QNAMES = """, q AS (SELECT DISTINCT CASE line % 3 WHEN 0 THEN name WHEN 1 THEN qualified_name ELSE 'no.' || name END AS name FROM symbols)
, ex AS (SELECT qualified_name AS query, path, line, qualified_name, kind, 'exact' AS match FROM symbols WHERE qualified_name IN (SELECT name FROM q))
, lf AS (SELECT name AS query, path, line, qualified_name, kind, 'leaf' AS match FROM symbols WHERE name IN (SELECT name FROM q WHERE NOT contains(name, '.')) AND name NOT IN (SELECT query FROM ex))
, fd AS (SELECT * FROM ex UNION ALL SELECT * FROM lf) """


def _queries(spark, sf):
    s = table(spark, sf, "symbols")
    name = F.when(F.col("line") % 3 == 0, F.col("name")).when(F.col("line") % 3 == 1, F.col("qualified_name")).otherwise(
        F.concat(F.lit("no."), "name")
    )
    return s.select(name.alias("name"), F.concat(F.lit("f"), (F.col("line") % 6).cast("string"), F.lit(".spec")).alias("from_path"))


@register("lookup_symbol", cte("symbols", _QNAMES + "SELECT * FROM fd"))
def _(spark, sf):
    return navigate.lookup_symbol(table(spark, sf, "symbols"), _queries(spark, sf)).select(
        "query", "path", "line", "qualified_name", "kind", "match"
    )


_VIS = """, q2 AS (SELECT DISTINCT CASE line % 3 WHEN 0 THEN name WHEN 1 THEN qualified_name ELSE 'no.' || name END AS query, 'f' || (line % 6) || '.spec' AS from_path FROM symbols)
, cd AS (SELECT q2.from_path, fd.* FROM q2 JOIN fd USING (query))
, lay AS (SELECT DISTINCT path, 'L' || (CAST(regexp_extract(path, 'f(\\d+)', 1) AS INT) % 4) AS layer FROM symbols)
, sc AS (SELECT cd.*, a.layer AS la, b.layer AS lb, CASE WHEN cd.path = cd.from_path THEN 0 WHEN CAST(regexp_extract(cd.path, 'f(\\d+)', 1) AS INT) % 10 = CAST(regexp_extract(from_path, 'f(\\d+)', 1) AS INT) % 10 THEN 1 ELSE 3 END AS score
  FROM cd LEFT JOIN lay a ON a.path = cd.path LEFT JOIN lay b ON b.path = from_path)
, vis AS (SELECT *, la IS NULL OR lb IS NULL OR la = lb OR (lb = 'L1' AND la = 'L0') AS seen FROM sc)
, kept AS (SELECT * FROM (SELECT *, bool_or(seen) OVER (PARTITION BY query, from_path) AS any_seen FROM vis) AS x WHERE seen OR NOT any_seen) """


def _scoped_inputs(spark, sf):
    s = table(spark, sf, "symbols")
    number = F.regexp_extract("path", r"f(\d+)", 1).cast("int")
    files = s.select("path").distinct()
    layers = files.withColumn("layer", F.concat(F.lit("L"), (number % 4).cast("string")))
    # a file's scope: the files with the same last digit
    asked = spark.createDataFrame([(f"f{i}.spec", i) for i in range(6)], "from_path string, d int")
    visible = files.withColumn("d", number % 10).join(asked, "d").select("from_path", "path")
    sees = spark.createDataFrame([("L0", "L0"), ("L1", "L1"), ("L1", "L0"), ("L2", "L2"), ("L3", "L3")], "layer string, visible string")
    return s, visible, layers, sees


@register("rank_by_scope", cte("symbols", _QNAMES + _VIS + "SELECT query, from_path, path, line, qualified_name, score FROM kept"))
def _(spark, sf):
    s, visible, layers, sees = _scoped_inputs(spark, sf)
    q = _queries(spark, sf).withColumnRenamed("name", "query").distinct()
    found = navigate.lookup_symbol(s, _queries(spark, sf)).select("query", "path", "line", "qualified_name", "kind")
    return navigate.rank_by_scope(q.join(found, "query"), visible, layers, sees).select(
        "query", "from_path", "path", "line", "qualified_name", "score"
    )


@register(
    "goto_definition",
    cte(
        "symbols",
        _QNAMES + _VIS
        + """, b AS (SELECT query, from_path, min((score, path, line, qualified_name)) AS m FROM kept GROUP BY 1, 2) SELECT query, from_path, m[1] AS score, m[2] AS path, m[3] AS line, m[4] AS qualified_name FROM b""",
    ),
)
def _(spark, sf):
    s, visible, layers, sees = _scoped_inputs(spark, sf)
    return navigate.goto_definition(s, _queries(spark, sf), visible, layers, sees).drop("kind")


@register(
    "find_implementations",
    ON_LINES(
        """, m AS (SELECT path, line, regexp_extract(text, '^\\s*(before|after|around|implement|action)\\s+[\\w.]+', 1) AS keyword, regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS nm FROM lines)
, s AS (SELECT path, line, keyword, string_split(nm, '.')[-1] AS leaf, keyword <> 'action' AS mon FROM m WHERE keyword <> '' AND keyword || nm NOT IN ('actionimport', 'actionexport'))
, q AS (SELECT DISTINCT leaf AS name, leaf, mon AS is_monitor FROM s)
SELECT name, is_monitor, path, line, s.keyword FROM q JOIN s USING (leaf) WHERE s.mon <> q.is_monitor"""
    ),
)
def _(spark, sf):
    s = symbols.extract_nested_symbols(table(spark, sf, "src"))
    q = s.filter(F.col("keyword").isin("action", "before", "after", "around", "implement")).select(
        F.substring_index("name", ".", -1).alias("name"), (F.col("keyword") != "action").alias("is_monitor")
    )
    return navigate.find_implementations(s, q.distinct()).select("name", "is_monitor", "path", "line", "keyword")


_WORDS = """, ln AS (SELECT doc_id, CAST(i - 1 AS INT) AS line, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS d, unnest(range(1, len(l) + 1)) AS t(i))
, pieces AS (SELECT doc_id, line, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w, string_split_regex(text, '[A-Za-z0-9_]+') AS g FROM ln)
, wi AS (SELECT w[j] AS word, 'd' || doc_id AS path, line, CAST(list_sum([length(x) FOR x IN g[1:j]]) + coalesce(list_sum([length(x) FOR x IN w[1:j - 1]]), 0) AS INT) AS col FROM pieces, unnest(range(1, len(w) + 1)) AS t(j)) """


def _index(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    return navigate.word_index(d)


@register("word_index", "WITH " + _WORDS[2:] + "SELECT * FROM wi")
def _(spark, sf):
    return _index(spark, sf)


# every word of the benchmark texts is looked up
_ASKED = ", q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM benchmark) "


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("word")
    ).distinct()


@register("find_references", "WITH " + _WORDS[2:] + _ASKED + "SELECT wi.* FROM wi JOIN q USING (word)")
def _(spark, sf):
    return navigate.find_references(_index(spark, sf), _asked(spark, sf))


@register(
    "reference_kinds",
    "WITH " + _WORDS[2:] + _ASKED
    + """, dc AS (SELECT word, path, min(line) AS line FROM wi GROUP BY word, path) SELECT access, count(*) AS n FROM (SELECT CASE WHEN dc.word IS NULL THEN 'read' ELSE 'write' END AS access FROM wi JOIN q USING (word) LEFT JOIN dc USING (word, path, line)) AS x GROUP BY access""",
)
def _(spark, sf):
    index = _index(spark, sf)
    first = index.groupBy(F.col("word").alias("name"), "path").agg(F.min("line").alias("line"))
    refs = navigate.find_references(index, _asked(spark, sf))
    return navigate.reference_kinds(refs, first).groupBy("access").agg(F.count("*").alias("n"))


@register(
    "rename_plan",
    "WITH " + _WORDS[2:] + _ASKED
    + """SELECT path, line, col, col + length(word) AS end_col, word AS old, word || '_2' AS new, row_number() OVER (PARTITION BY path ORDER BY line DESC, col DESC) AS edit_no FROM wi JOIN q USING (word)""",
)
def _(spark, sf):
    r = _asked(spark, sf).select(F.col("word").alias("old"), F.concat("word", F.lit("_2")).alias("new"))
    return navigate.rename_plan(_index(spark, sf), r)


@register(
    "callers_by_occurrence",
    ON_LINES(
        """, d AS (SELECT path, line, max(nullif(regexp_extract(text, '^\\s*(?:type|action|relation|function|individual|object|module|isolate)\\s+([\\w.]+)', 1), '')) AS decl, max(text) AS text FROM lines GROUP BY path, line)
, o AS (SELECT path, line, last_value(decl IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS container, len(regexp_extract_all(text, '\\bidx\\b')) AS n FROM d)
SELECT 'idx' AS word, path, container, CAST(sum(n) AS BIGINT) AS calls, min(line) AS first_line FROM o WHERE n > 0 GROUP BY path, container"""
    ),
)
def _(spark, sf):
    src = table(spark, sf, "src")
    refs = navigate.find_references(navigate.word_index(src.select("path", "content")), spark.createDataFrame([("idx",)], "w string"))
    return navigate.callers_by_occurrence(refs, symbols.extract_symbols(src))


@register(
    "shadow_declarations",
    cte(
        "symbols",
        """, pl AS (SELECT corpus, name, kind, path, min(line) AS line FROM symbols GROUP BY ALL)
, x AS (SELECT s.corpus, s.name, s.kind, s.path, s.line, count(*) AS other_files, min((o.path, o.line)) AS o FROM symbols s JOIN pl o ON o.corpus = s.corpus AND o.name = s.name AND o.kind = s.kind AND o.path <> s.path GROUP BY ALL)
SELECT corpus, name, kind, path, line, other_files, o[1] AS other_path, o[2] AS other_line FROM x""",
    ),
)
def _(spark, sf):
    return navigate.shadow_declarations(table(spark, sf, "symbols"))


@register(
    "search_symbols",
    cte(
        "symbols",
        """SELECT path, line, qualified_name, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 WHEN starts_with(lower(qualified_name), 'ring') THEN 2 ELSE 3 END AS rank
FROM symbols WHERE contains(lower(qualified_name), 'ring') """,
    ),
)
def _(spark, sf):
    return navigate.search_symbols(table(spark, sf, "symbols"), "RING").select("path", "line", "qualified_name", "rank")


@register(
    "search_scoped",
    cte(
        "symbols",
        """, h AS (SELECT *, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 WHEN starts_with(lower(qualified_name), 'ring') THEN 2 ELSE 3 END AS rank FROM symbols WHERE contains(lower(qualified_name), 'ring'))
, n AS (SELECT *, CAST(regexp_extract(path, 'f(\\d+)', 1) AS INT) AS f FROM h)
SELECT path, line, qualified_name, 1 AS boost, CASE WHEN f % 10 = 3 THEN 0 ELSE 1 END AS scope_rank, CASE WHEN f % 10 = 3 OR f % 4 = 3 THEN 0 ELSE 1 END AS layer_rank FROM n
""",
    ),
)
def _(spark, sf):
    s, visible, layers, _ = _scoped_inputs(spark, sf)
    return navigate.search_scoped(s, "ring", "f3.spec", visible, layers).select(
        "path", "line", "qualified_name", "boost", "scope_rank", "layer_rank"
    )


# ---- patterns -----------------------------------------------------------------------------------------

_PAT = """, b AS (SELECT path, corpus, line, text, regexp_extract(text, '^\\s*(before|after|around|implement)\\s+[\\w.]+\\s*(?:\\([^)]*\\))?\\s*\\{', 1) AS head, CASE WHEN text = '}' THEN line END AS closer FROM lines)
, c AS (SELECT *, first_value(closer IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_close, lead(text) OVER (PARTITION BY path ORDER BY line) AS nx FROM b)
, mon AS (SELECT path, corpus, line, head AS mixin, regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS act, contains(nx, '_generating') AS guard FROM c WHERE head <> '' AND (next_close IS NOT NULL OR text LIKE '%}'))
, impl AS (SELECT path, corpus, min(line) FILTER (starts_with(text, '<<< impl')) AS first_at FROM lines GROUP BY path, corpus)
, pat AS (SELECT 'monitors' AS kind, 'monitor' AS subtype, path, corpus, line, mixin || '.' || act AS name FROM mon
UNION ALL SELECT 'monitors', 'export', path, corpus, line, 'export.' || regexp_extract(text, 'action ([\\w.]+)', 1) FROM lines WHERE starts_with(text, 'export action ')
UNION ALL SELECT 'monitors', 'weight', path, corpus, line, 'weight.' || regexp_extract(text, 'attribute (\\w+)', 1) FROM lines WHERE starts_with(text, 'attribute ')
UNION ALL SELECT 'serdes', CASE WHEN contains(text, 'deser_128') THEN 'deserializer' ELSE 'serializer' END, l.path, l.corpus, first_at, regexp_extract(text, 'class (\\w+)', 1) FROM lines l JOIN impl USING (path) WHERE regexp_matches(text, 'class \\w+ : public')
UNION ALL SELECT 'serdes', 'instance', path, corpus, line, regexp_extract(text, 'instance (\\w+)', 1) FROM lines WHERE regexp_matches(text, '^instance \\w+ : serdes')
UNION ALL SELECT 'variants', 'variant', path, corpus, line, 'variant_of_' || regexp_extract(text, 'of (\\w+)', 1) FROM lines WHERE regexp_matches(text, '^\\s*variant this of')
UNION ALL SELECT 'variants', 'struct_object', o.path, o.corpus, o.line, regexp_extract(o.text, 'object (\\w+)', 1) FROM lines o WHERE regexp_matches(o.text, '^object \\w+ = \\{')
UNION ALL SELECT 'shim', 'recv_handler', path, corpus, line, act FROM mon WHERE mixin = 'implement' UNION ALL SELECT 'shim', 'state_tracking', path, corpus, 0, 'connection_state' FROM lines WHERE text LIKE 'relation isup%'
UNION ALL SELECT 'shim', 'transport', path, corpus, 0, 'transport_udp' FROM lines WHERE text = 'using ip.udp' UNION ALL SELECT 'shim', 'socket_operations', path, corpus, first_at, 'socket_ops' FROM impl WHERE first_at IS NOT NULL
UNION ALL SELECT 'module', 'definition', path, corpus, line, regexp_extract(text, 'module (\\w+)', 1) FROM lines WHERE starts_with(text, 'module ') UNION ALL SELECT 'module', 'instance', path, corpus, line, regexp_extract(text, 'instance (\\w+)', 1) FROM lines WHERE starts_with(text, 'instance ')
UNION ALL SELECT 'entity', 'entity', path, corpus, line, regexp_extract(text, 'object (\\w+)', 1) FROM lines WHERE starts_with(text, 'object frame_') UNION ALL SELECT DISTINCT 'include_chain', 'include_chain', path, corpus, 0, 'includes' FROM lines WHERE regexp_matches(text, '^\\s*include \\w+')) """


def _patterns(spark, sf, kinds=None):
    return patterns.detect_patterns(table(spark, sf, "src"), kinds)


def _stored_patterns(spark, sf, name, kinds=None):
    """The patterns for an operator that reads them many times, a few columns at a time: a table of columns, where a checkpoint holds whole rows."""
    found = scratch(spark, name)
    _patterns(spark, sf, kinds).write.parquet(found)
    return spark.read.parquet(found)


_SHOWN = ["kind", "subtype", "path", "line", "name"]
_NO_CORPUS = "SELECT kind, subtype, path, line, name FROM pat"


@register("detect_patterns", ON_LINES(_PAT + _NO_CORPUS))
def _(spark, sf):
    return _patterns(spark, sf).select(*_SHOWN)


for _name, _kind, _fn in (
    ("detect_serdes", "serdes", patterns.detect_serdes),
    ("detect_variants", "variants", patterns.detect_variants),
    ("detect_monitors", "monitors", patterns.detect_monitors),
    ("detect_shims", "shim", patterns.detect_shims),
    ("detect_modules", "module", patterns.detect_modules),
    ("detect_entities", "entity", patterns.detect_entities),
    ("detect_include_chain", "include_chain", patterns.detect_include_chain),
):
    register(_name, ON_LINES(_PAT + _NO_CORPUS + f" WHERE kind = '{_kind}'"))(
        lambda spark, sf, fn=_fn: fn(table(spark, sf, "src")).select(*_SHOWN)
    )


@register("monitor_guards", ON_LINES(_PAT + "SELECT path, line, guard FROM mon"))
def _(spark, sf):
    m = patterns.detect_monitors(table(spark, sf, "src")).filter("subtype = 'monitor'")
    return m.select("path", "line", (F.col("details")["has_generating_guard"] == "true").alias("guard"))


@register("pattern_summary", ON_LINES(_PAT + "SELECT kind, count(*) AS n FROM pat GROUP BY kind"))
def _(spark, sf):
    return patterns.pattern_summary(_patterns(spark, sf))


@register(
    "compare_corpora",
    ON_LINES(
        _PAT
        + """, n AS (SELECT kind, count(*) FILTER (corpus = 'corpus0') AS count_a, count(*) FILTER (corpus = 'corpus2') AS count_b FROM pat GROUP BY kind) SELECT *, count_a - count_b AS delta, count_a > 0 AS present_in_a, count_b > 0 AS present_in_b FROM n"""
    ),
)
def _(spark, sf):
    p = _patterns(spark, sf).withColumn("corpus", F.substring_index("path", "/", 1))
    return patterns.compare_corpora(p, "corpus0", "corpus2")


@register(
    "pattern_crossref",
    ON_LINES(
        _PAT
        + """, sd AS (SELECT path, line, regexp_extract_all(text, 'serdes\\((\\w+), (\\w+), (\\w+), (\\w+)\\)', 3)[1] AS ser, regexp_extract_all(text, 'serdes\\((\\w+), (\\w+), (\\w+), (\\w+)\\)', 4)[1] AS des FROM lines WHERE contains(text, ': serdes('))
SELECT 'unknown_serializer' AS finding, path, line, ser AS related FROM sd WHERE ser NOT IN (SELECT name FROM pat WHERE subtype = 'serializer')
UNION ALL SELECT 'unknown_deserializer', path, line, des FROM sd WHERE des NOT IN (SELECT name FROM pat WHERE subtype = 'deserializer')
UNION ALL SELECT DISTINCT 'export_without_monitor', NULL, CAST(NULL AS INT), regexp_extract(name, 'export.(\\w+)', 1) FROM pat WHERE subtype = 'export' AND regexp_extract(name, 'export.(\\w+)', 1) NOT IN (SELECT act FROM mon WHERE mixin <> 'implement')
UNION ALL SELECT DISTINCT 'module_without_instance', NULL, CAST(NULL AS INT), name FROM pat WHERE subtype = 'definition' AND name NOT IN (SELECT regexp_extract(text, ': ([\\w.]+)', 1) FROM lines WHERE starts_with(text, 'instance '))"""
    ),
)
def _(spark, sf):
    return patterns.pattern_crossref(_stored_patterns(spark, sf, "crossref", patterns.CROSSREF_KINDS)).select("finding", "path", "line", "related")


@register(
    "categorize_file",
    ON_LINES(
        _PAT
        + "SELECT path, CASE WHEN bool_or(kind = 'shim') THEN 'shim' WHEN bool_or(kind = 'entity') THEN 'entity' WHEN bool_or(kind = 'monitors') THEN 'behavior' WHEN contains(path, 'test') THEN 'test' ELSE 'other' END AS category FROM pat GROUP BY path"
    ),
)
def _(spark, sf):
    return patterns.categorize_file(_patterns(spark, sf))


_SERDES = """, sd AS (SELECT path AS instance_path, line AS instance_line, regexp_extract(text, 'instance (\\w+)', 1) AS instance, regexp_extract(text, 'serdes\\((\\w+)', 1) AS message_type, string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ', ') AS a FROM lines WHERE contains(text, ': serdes('))
, cl AS (SELECT name, min(path) AS path FROM pat WHERE subtype IN ('serializer', 'deserializer') GROUP BY name) """


@register(
    "serdes_correlation",
    ON_LINES(
        _PAT + _SERDES
        + """SELECT message_type, instance, instance_path, instance_line, a[3] AS ser_name, s.path AS ser_path, CASE WHEN s.path IS NOT NULL THEN 2 END AS ser_states, a[4] AS deser_name, d.path AS deser_path, CASE WHEN d.path IS NOT NULL THEN 2 END AS deser_states
FROM sd LEFT JOIN cl s ON s.name = a[3] LEFT JOIN cl d ON d.name = a[4]"""
    ),
)
def _(spark, sf):
    p = _patterns(spark, sf, ["serdes"])
    types = p.filter("subtype = 'instance'").select(F.col("details")["message_type"].alias("t")).distinct()
    return patterns.serdes_correlation(p, types)


_HOLD = """, st AS (SELECT o.path, o.line, regexp_extract(o.text, 'object (\\w+)', 1) AS name, s.text AS body FROM lines o JOIN lines s ON s.path = o.path AND s.line = CASE WHEN starts_with(o.text, 'object frame_') THEN o.line + 4 ELSE o.line + 1 END WHERE regexp_matches(o.text, '^object \\w+ = \\{')) """


@register(
    "containing_structs",
    ON_LINES(_HOLD + "SELECT DISTINCT regexp_extract(body, 'b : (\\w+)\\.arr', 1) AS type, name AS struct FROM st"),
)
def _(spark, sf):
    p = _patterns(spark, sf, ["variants"])
    types = p.filter("subtype = 'variant'").select(F.col("details")["parent"].alias("t")).distinct()
    return patterns.containing_structs(p, types)


_STEM = "regexp_extract(path, '([^/]+)[.][^./]*$', 1)"
_IMPACT = (
    _PAT + _SERDES + _HOLD
    + f""", ex AS (SELECT path, {_STEM} AS stem, regexp_extract(text, '^include\\s+(\\w+)', 1) AS used FROM lines WHERE regexp_matches(text, '^include\\s+\\w+'))
, ty AS (SELECT 'struct' AS k, 'add_field_to_struct' AS edit, min(path) AS path FROM st WHERE name = '{{type}}' HAVING count(*) > 0 UNION ALL SELECT 'variant', 'add_variant_case', min(path) FROM lines WHERE contains(text, 'variant this of {{type}} ') HAVING count(*) > 0)
, ho AS (SELECT '{{type}}' AS name, 0 AS way UNION SELECT name, 1 FROM st WHERE contains(body, ': {{type}}.'))
, ins AS (SELECT way, row_number() OVER (PARTITION BY way ORDER BY instance_path, instance_line) AS n, s.path AS sp, d.path AS dp FROM ho JOIN sd ON message_type = name LEFT JOIN cl s ON s.name = a[3] LEFT JOIN cl d ON d.name = a[4])
, prs AS (SELECT sp, dp FROM ins WHERE way = 0 UNION ALL SELECT sp, dp FROM ins WHERE way = 1 AND n = 1 AND sp IS NOT NULL AND 'variant' IN (SELECT k FROM ty) AND 0 NOT IN (SELECT way FROM ins))
, au AS (SELECT path, 'type_definition' AS category, edit FROM ty UNION SELECT sp, 'serializer', 'add_state_and_set_case' FROM prs WHERE sp IS NOT NULL UNION SELECT dp, 'deserializer', 'add_state_and_get_case' FROM prs WHERE dp IS NOT NULL)
, us AS (SELECT DISTINCT stem FROM ex WHERE used IN (SELECT {_STEM} FROM au) UNION SELECT ex.stem FROM us JOIN ex ON used = us.stem)
, cat AS (SELECT path, CASE WHEN bool_or(kind = 'shim') THEN 'shim' WHEN bool_or(kind = 'entity') THEN 'entity' WHEN bool_or(kind = 'monitors') THEN 'behavior' WHEN contains(path, 'test') THEN 'test' ELSE 'other' END AS category FROM pat GROUP BY path)
SELECT 'auto' AS bucket, path, category, edit FROM au UNION ALL
SELECT CASE WHEN hit THEN 'manual_review' ELSE 'unaffected' END, path, CASE WHEN hit THEN coalesce(category, 'other') END, NULL
FROM (SELECT DISTINCT path, stem IN (SELECT stem FROM us) AS hit FROM ex WHERE path NOT IN (SELECT path FROM au)) AS f LEFT JOIN cat USING (path)"""
)


def _impact(name, type_name, change):
    @register(name, cte("src", "RECURSIVE " + LINES + _IMPACT.replace("{type}", type_name)))
    def _(spark, sf):
        src = table(spark, sf, "src")
        return graph.change_impact(_stored_patterns(spark, sf, name), src, symbols.extract_includes(src), type_name, change)


_impact("change_impact", "box_5", "add_field")
_impact("change_impact_variant", "frame_2", "add_variant")


@register(
    "find_variants",
    ON_LINES(
        _PAT + _SERDES + _HOLD
        + """, s1 AS (SELECT name, min((path, line, body)) AS m FROM st GROUP BY name)
, ob AS (SELECT path, line, text, regexp_extract(text, 'variant this of (\\w+)', 1) AS parent, last_value(nullif(regexp_extract(text, 'object\\s+(\\w+)\\s*=\\s*\\{', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS name FROM lines)
, vs AS (SELECT path, line, parent, name FROM ob WHERE regexp_matches(text, 'variant this of \\w+ = struct') AND name <> parent AND parent NOT IN (SELECT name FROM st))
, vm AS (SELECT path, line, parent, name, CAST(row_number() OVER (PARTITION BY parent ORDER BY line, name) - 1 AS INT) AS tag FROM vs JOIN (SELECT parent, min(path) AS path FROM vs GROUP BY 1) AS f USING (parent, path))
, si AS (SELECT message_type AS struct, min((instance_path, instance_line, a[3])) AS m FROM sd GROUP BY 1)
, ts AS (SELECT regexp_extract(body, 'b : (\\w+)[.]arr', 1) AS parent, min((name, m)) AS h FROM st JOIN si ON struct = name GROUP BY 1)
, tm AS (SELECT path, CAST(regexp_extract(text, 'tag == (\\d+)', 1) AS INT) AS tag, regexp_extract(text, 'frame_type = (0x\\w+)', 1) AS wire_type FROM lines WHERE regexp_matches(text, 'tag == \\d+\\).*frame_type = 0x'))
, co AS (SELECT parent, tag, wire_type FROM ts JOIN cl ON cl.name = h[2][3] JOIN tm USING (path))
SELECT name AS type_name, 'struct' AS kind, m[1] AS path, m[2] AS line, f.tag AS tag, f.member AS member, CASE WHEN f.tag = 0 THEN 'idx' ELSE regexp_extract(m[3], 'b : ([\\w.]+)', 1) END AS member_type, f.tag = 1 AS is_array, '' AS wire_type FROM s1, (VALUES (0, 'a'), (1, 'b')) AS f(tag, member)
UNION ALL SELECT vm.parent, 'variant', vm.path, vm.line, vm.tag, vm.name, 'struct', false, coalesce(wire_type, '') FROM vm LEFT JOIN co ON co.parent = vm.parent AND co.tag = vm.tag"""
    ),
)
def _(spark, sf):
    src = table(spark, sf, "src")
    p = _stored_patterns(spark, sf, "find_variants", ["variants", "module", "serdes"])
    structs = p.filter("subtype = 'struct_object'").select(F.col("name").alias("t"))
    types = structs.unionByName(p.filter("subtype = 'variant'").select(F.col("details")["parent"].alias("t")))
    return patterns.find_variants(p, src, types)
