"""Input relations derived from the driver tables, written once in SQL that Spark and DuckDB both read.

``table(spark, sf, name)`` gives the Spark side, ``cte(names, body)`` the DuckDB side. Only inputs are
shared; what a query computes is written separately for the two engines.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.lineage import ensure_checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def stem(k: str) -> str:
    """File stem of part ``k``: tests, behaviors, shims, shared names, plain modules."""
    return (
        f"(CASE {k} % 11 WHEN 0 THEN 'm' || {k} || '_test' WHEN 1 THEN 'm' || {k} || '_server_behavior' "
        f"WHEN 2 THEN 'm' || {k} || '_client_behavior' WHEN 3 THEN 'm' || {k} || '_shim' "
        f"WHEN 4 THEN 'common_' || ({k} % 7) ELSE 'm' || {k} END)"
    )


def path(k: str) -> str:
    return (
        f"('corpus' || ({k} % 3) || '/layer' || ({k} % 5) || '/p' || CAST(floor({k} / 1000) AS BIGINT) || '/' || "
        f"{stem(k)} || '.spec')"
    )


def _line(text: str, when: str | None = None) -> str:
    return text if when is None else f"CASE WHEN {when} THEN {text} END"


_SOURCE_LINES = [
    _line("'#lang spec1.0'", "k % 13 <> 0"),
    "'# ' || ty || ' module text [r' || (k % 5) || ':' || (k % 7) || '.' || (k % 4) || ', r' || (k % 3) || ']'",
    _line("'#require legacy # [r1:1]'", "k % 6 = 0"),
    _line("'# TODO fix'", "k % 12 = 0"),
    _line("'include ' || " + stem("h"), "k >= 2"),
    _line("'include ' || " + stem("t"), "k >= 3"),
    _line("'include mising_' || (k % 4)", "k % 17 = 0"),
    _line("'  include indented'", "k % 19 = 0"),
    "''",
    "'type ' || nm || '_t = {' || br || ', b' || sz || '}'",
    "'type idx'",
    "'relation ' || nm || '_seen(X:' || nm || '_t, y:idx)'",
    "'function ' || nm || '_count(X:idx) : nat'",
    _line("'relation ' || nm || '_seen(X:idx)'", "k % 9 = 0"),
    "'individual cur_' || k || ' : idx'",
    _line("'object frame_' || (k % 4) || ' = {'", "k % 16 = 0"),
    _line("'  type this'", "k % 16 = 0"),
    _line("'}'", "k % 16 = 0"),
    "'object box_' || (k % 50) || ' = {'",
    "'  type this = struct { a : idx, b : frame_' || (k % 4) || '.arr }'",
    "'  object part_' || (k % 6) || ' = {'",
    "'    variant this of frame_' || (k % 4) || ' = struct { f : idx, g : nat }'",
    "'  }'",
    "'}'",
    "'module mod_' || (k % 20) || '(a, b) = {'",
    "'  relation open_' || (k % 8) || '(X:a)'",
    "'}'",
    "'instance i' || k || ' : mod_' || (k % 23) || '(x, y)'",
    "'action act_' || k || '(x:' || nm || '_t, n:idx) returns (r:nat) = {'",
    "'  require ' || nm || '_seen(x, n); # [r' || (k % 5) || ':' || (k % 7) || ', ' || (k % 9) || ']'",
    "'  call act_' || h || '(x);'",
    "'  ' || nm || '_count(n) := n + ' || sz || ';'",
    "'  if n > 1 {'",
    "'    cur_' || k || ' := n;'",
    "'  }'",
    "'}'",
    _line("'before act_' || h || ' {'", "k % 3 <> 0"),
    _line("'  ensure _generating -> cur_' || k || ' > 0;'", "k % 3 = 1"),
    _line("'  assume ' || nm || '_count(n) > ' || sz || ';'", "k % 3 = 2"),
    _line("'}'", "k % 3 <> 0"),
    _line("'after init {'", "k % 4 = 0"),
    _line("'  ' || nm || '_seen(X, Y) := false;'", "k % 4 = 0"),
    _line("'}'", "k % 4 = 0"),
    _line("'after init { }'", "k % 10 = 0"),
    _line("'action quick_' || k || ' = {'", "k % 7 = 0"),
    _line("'  cur_' || k || ' := 1;'", "k % 7 = 0"),
    _line("'}'", "k % 7 = 0"),
    "CASE WHEN k % 11 = 0 THEN 'export action act_' || k WHEN k % 5 = 0 THEN 'export act_' || k "
    "WHEN k % 5 = 1 THEN 'import act_' || h END",
    "'invariant [inv_' || k || '] ' || nm || '_seen(x, n) -> cur_' || k || ' > 0'",
    _line("'axiom [ax_' || k || '] ' || nm || '_count(x) >= 0'", "k % 8 = 0"),
    "'# tag = ' || (CASE WHEN k % 14 = 0 THEN 'x' || k ELSE '' || (k % 3) END)",
    "'# tag = ' || (k % 2)",
    _line("'implement net.recv(x:pkt) {'", "k % 11 = 3"),
    _line("'}'", "k % 11 = 3"),
    _line("'relation isup(X:idx)'", "k % 11 = 3"),
    _line("'using ip.udp'", "k % 11 = 3"),
    _line("'<<< impl'", "k % 11 = 5"),
    _line("'enum { s0, s' || (k % 4) || ' } state;'", "k % 11 = 5"),
    _line("'class ser_' || k || ' : public lib_binary_ser_128 { setn(1); send(2); }'", "k % 11 = 5"),
    _line("'if (tag == ' || (k % 3) || ') { frame_type = 0x0' || (k % 10) || '; }'", "k % 11 = 5"),
    _line("'>>>'", "k % 11 = 5"),
    _line("'<<< member class deser_' || k || ' : public lib_binary_deser_128 { getn(1); } >>>'", "k % 11 = 5"),
    _line(
        "'instance sd' || k || ' : serdes(box_' || (k % 50) || ', data, ser_' || (k - k % 2) || ', deser_' || k || ')'",
        "k % 11 = 5",
    ),
    _line("'attribute act_' || k || '.weight = \"' || (k % 9) || '\"'", "k % 15 = 0"),
    _line("'}'", "k % 29 = 0"),
    _line("'before never {'", "k % 31 = 0"),
]

_LOG_TEXT = """CASE sub WHEN 0 THEN 'Isolate iso_' || (l_suppkey % 7) || ':'
    WHEN 1 THEN CASE flag WHEN 'A' THEN 'The following properties are to be checked:' WHEN 'N' THEN 'The following program assertions are treated as guarantees:' ELSE 'The following initializers are present:' END
    WHEN 2 THEN '  in action act_' || l_partkey || ' when called from env:'
    WHEN 3 THEN '    f' || l_suppkey || '.spec: line ' || l_linenumber || ': check ... ' || (CASE st WHEN 'O' THEN 'PASS' ELSE 'FAIL' END)
    WHEN 4 THEN CASE l_linenumber % 4 WHEN 0 THEN 'f' || l_suppkey || '.spec: line ' || l_linenumber || ': error: bad ' || flag
       WHEN 1 THEN 'f' || l_suppkey || '.spec:' || l_linenumber || ': warning: odd ' || flag
       WHEN 2 THEN 'out' || l_suppkey || '.cpp:' || l_linenumber || ':7: fatal error: no ' || flag
       ELSE 'ValueError: bad ' || flag END
    WHEN 5 THEN 'isolate iso_' || (l_suppkey % 7) || ' : ' || (CASE st WHEN 'O' THEN 'OK' ELSE 'FAIL' END)
    ELSE '' END"""

DERIVED: dict[str, str] = {
    # one specification file per part, with text from the names and sizes of the part
    "src": f"""
SELECT {path('k')} AS path, 'corpus' || (k % 3) AS corpus, 'layer' || (k % 5) AS layer, k,
  concat_ws(chr(10), {', '.join(_SOURCE_LINES)}) AS content
FROM (SELECT {{spread}} p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS h, CAST(floor(p_partkey / 3) AS BIGINT) AS t,
  replace(p_name, ' ', '_') AS nm, lower(replace(p_brand, '#', '')) AS br, lower(p_type) AS ty, p_size AS sz
  FROM {{part}}) AS p""",
    # resolved includes of those files
    "includes": f"""
SELECT {path('k')} AS from_path, {path('h')} AS to_path, 1 AS line, {stem('h')} AS include_name
FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS h FROM {{part}} WHERE p_partkey >= 2) AS a
UNION ALL
SELECT {path('k')} AS from_path, {path('t')} AS to_path, 2 AS line, {stem('t')} AS include_name
FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 3) AS BIGINT) AS t FROM {{part}} WHERE p_partkey >= 3) AS b""",
    "files": f"""
SELECT {path('p_partkey')} AS path, 'corpus' || (p_partkey % 3) AS corpus, {stem('p_partkey')} AS stem,
  'layer' || (p_partkey % 5) AS layer, p_partkey AS k FROM {{part}}""",
    "file_layers": f"SELECT {path('p_partkey')} AS path, 'layer' || (p_partkey % 5) AS layer FROM {{part}}",
    # layer i depends on the layers given by the region keys of its nations
    "layer_edges": """
SELECT DISTINCT 'layer' || n_regionkey AS src, 'layer' || ((n_regionkey + 2) % 5) AS dst FROM {nation}
WHERE n_regionkey < 3""",
    "edges_cyclic": """
SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM {nation} WHERE n_nationkey % 3 <> 0
UNION SELECT n_nationkey AS src, CAST(floor(n_nationkey / 2) AS INT) AS dst FROM {nation} WHERE n_nationkey % 4 = 0""",
    "edges_dag": """
SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 1
UNION SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM {part} WHERE p_partkey > 2""",
    # requirement facts: a line item is a statement of a supplier's file on a part's action
    "reqs": """
SELECT path || ':' || line AS id, path, line, kind, mixin_kind, monitor_action, formula_text, split(tag_text, ',') AS tags
FROM (SELECT 'f' || l_suppkey || '.spec' AS path, CAST(l_orderkey * 8 + l_linenumber AS INT) AS line,
  CASE l_linenumber % 4 WHEN 0 THEN 'require' WHEN 1 THEN 'ensure' WHEN 2 THEN 'assume' ELSE 'assert' END AS kind,
  CASE max(l_returnflag) WHEN 'A' THEN 'before' WHEN 'N' THEN 'after' ELSE 'around' END AS mixin_kind,
  'act_' || max(l_partkey) AS monitor_action,
  CASE WHEN l_linenumber = 5 AND l_suppkey % 10 = 3 THEN 'false' ELSE
  (CASE WHEN l_linenumber = 3 THEN '_generating -> ' ELSE '' END) || 'm.x' || (l_orderkey % 2500) || ' > x' || (max(l_partkey) % 3000)
  || ' + ' || l_linenumber || ' & other.part.x' || l_suppkey END AS formula_text,
  'r' || (l_suppkey % 5) || ':' || (max(l_partkey) % 40) || (CASE WHEN l_linenumber = 1 THEN ',7' WHEN l_linenumber = 2 THEN ',41' ELSE '' END) AS tag_text
  FROM {lineitem} GROUP BY l_suppkey, l_orderkey, l_linenumber) AS q""",
    "actions": """
SELECT 'act_' || n AS id, 'act_' || n AS name, 'mod' || (p_partkey % 7) || '.act_' || n AS qualified_name,
  'f' || (p_partkey % 120) || '.spec' AS path, p_size AS line
FROM (SELECT p_partkey, p_size, CASE WHEN p_size <= 2 THEN -p_partkey ELSE p_partkey END AS n FROM {part}) AS p""",
    "vars": """
SELECT 'x' || c_custkey AS id, 'x' || c_custkey AS name, 'mod' || c_nationkey || '.x' || c_custkey AS qualified_name,
  'f' || (c_custkey % 130) || '.spec' AS path, CAST(c_custkey % 700 AS INT) AS line FROM {customer}""",
    # what the requirements read, as known from their formulas
    "reads": """
SELECT DISTINCT 'f' || l_suppkey || '.spec:' || CAST(l_orderkey * 8 + l_linenumber AS INT) AS id, 'x' || (2 * (l_orderkey % 1250)) AS var FROM {lineitem}
UNION SELECT 'f' || l_suppkey || '.spec:' || CAST(l_orderkey * 8 + l_linenumber AS INT) AS id, 'x' || l_suppkey AS var FROM {lineitem}""",
    "action_reads": "SELECT DISTINCT 'act_' || l_partkey AS action, 'x' || (l_orderkey % 2500) AS var FROM {lineitem}",
    "writes": """
SELECT 'f' || (o_custkey % 120) || '.spec' AS path, CAST(o_orderkey % 1000 AS INT) AS line, 'x' || (o_custkey % 1700) AS var FROM {orders}""",
    "action_writes": "SELECT DISTINCT 'act_' || (o_custkey % 1900) AS action, 'x' || (o_orderkey % 1700) AS var FROM {orders}",
    "props": """
SELECT 'p' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'axiom' ELSE 'invariant' END AS kind, s_name AS name,
  'x' || (s_suppkey * 7 % 500) || ' > 0' AS formula_text, 'f' || s_suppkey || '.spec' AS path, CAST(s_suppkey % 50 AS INT) AS line FROM {supplier}""",
    "prop_reads": """
SELECT 'p' || s_suppkey AS id, 'x' || (s_suppkey * 7 % 500) AS var FROM {supplier}
UNION SELECT 'p' || s_suppkey AS id, 'x' || s_nationkey AS var FROM {supplier}""",
    "manifest": """
SELECT 'r' || (c_custkey % 7) || ':' || (c_custkey % 40) || '.' || c_custkey AS req_id, 'r' || (c_custkey % 7) AS rfc,
  (c_custkey % 40) || '.' || c_custkey AS section, c_name || ' in ' || c_mktsegment AS text,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'MUST' WHEN 'MACHINERY' THEN 'SHOULD' WHEN 'HOUSEHOLD' THEN 'MAY' WHEN 'FURNITURE' THEN '' ELSE 'SHALL' END AS level,
  CASE c_nationkey % 3 WHEN 0 THEN 'frame' WHEN 1 THEN 'packet' ELSE '' END AS layer, true AS testable FROM {customer}""",
    "annotations": """
SELECT path || ':' || line || ':0' AS id, path, line, split(tag_text, ',') AS tags
FROM (SELECT 'f' || (o_custkey % 90) || '.spec' AS path, CAST(o_orderkey AS INT) AS line,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice < 150000
    THEN 'r' || (o_custkey % 7) || ':' || (o_custkey % 40) || '.' || o_custkey || ',zz:' || (o_orderkey % 9)
  WHEN o_orderkey % 1000 = 1 THEN 'r' || (o_custkey % 7) || ':' || (o_custkey % 40)
  WHEN o_orderkey % 1000 = 2 THEN (o_custkey % 40) || '.' || o_custkey || ',3'
  WHEN o_orderkey % 1000 = 3 THEN CAST(o_custkey % 40 AS STRING)
  ELSE 'none:' || (o_orderkey % 90) || ',r' || (o_orderkey % 5) || ':' || (100 + o_orderkey % 30) END AS tag_text
  FROM {orders}) AS q""",
    # the annotations there were at an earlier date
    "annotations_before": """
SELECT path || ':' || line || ':0' AS id, path, line, split(tag_text, ',') AS tags
FROM (SELECT 'f' || (o_custkey % 90) || '.spec' AS path, CAST(o_orderkey AS INT) AS line,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice < 150000
    THEN 'r' || (o_custkey % 7) || ':' || (o_custkey % 40) || '.' || o_custkey || ',zz:' || (o_orderkey % 9)
  WHEN o_orderkey % 1000 = 1 THEN 'r' || (o_custkey % 7) || ':' || (o_custkey % 40)
  WHEN o_orderkey % 1000 = 2 THEN (o_custkey % 40) || '.' || o_custkey || ',3'
  WHEN o_orderkey % 1000 = 3 THEN CAST(o_custkey % 40 AS STRING)
  ELSE 'none:' || (o_orderkey % 90) || ',r' || (o_orderkey % 5) || ':' || (100 + o_orderkey % 30) END AS tag_text
  FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01') AS q""",
    # exports of specification files, by part
    "exports": f"""
SELECT {path('k')} AS path, 'act_' || k AS name, 'export' AS direction, 40 AS line
FROM (SELECT p_partkey AS k FROM {{part}} WHERE p_partkey % 11 = 0) AS a
UNION ALL
SELECT {path('k')} AS path, 'act_' || CAST(floor(k / 2) AS BIGINT) AS name, 'import' AS direction, 41 AS line
FROM (SELECT p_partkey AS k FROM {{part}} WHERE p_partkey % 5 = 1) AS b""",
    # requirements of specification files: statements on the act_ of parts, one per line item part and flag
    "spec_reqs": f"""
SELECT path || ':' || line AS id, path, line, kind, mixin_kind, monitor_action, formula_text
FROM (SELECT {path('l_partkey')} AS path, CAST(l_orderkey * 8 + l_linenumber AS INT) AS line,
  CASE l_linenumber % 4 WHEN 0 THEN 'require' WHEN 1 THEN 'ensure' WHEN 2 THEN 'assume' ELSE 'assert' END AS kind,
  CASE max(l_returnflag) WHEN 'A' THEN 'before' WHEN 'N' THEN 'after' ELSE 'around' END AS mixin_kind,
  'act_' || (l_partkey - l_partkey % 3) AS monitor_action,
  CASE WHEN l_linenumber = 3 THEN '_generating -> a' ELSE 'a > ' || l_linenumber END AS formula_text
  FROM {{lineitem}} GROUP BY l_partkey, l_orderkey, l_linenumber) AS q""",
    # symbols with qualified names, for look-up and search
    "symbols": """
SELECT 'f' || (p_partkey % 120) || '.spec' AS path, 'corpus' || (p_partkey % 3) AS corpus,
  replace(p_name, ' ', '_') || '_' || (p_partkey % 4) AS name,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) || '.' ELSE 'top.' || lower(p_type) || '.' END || replace(p_name, ' ', '_') || '_' || (p_partkey % 4) AS qualified_name,
  CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'variable' END AS kind,
  CAST(p_partkey AS INT) AS line FROM {part}""",
    # documents with numbered sections around their text
    "docs": """
SELECT 'doc' || doc_id AS doc, concat_ws(chr(10), '1.  Intro to ' || source, '', 'The ' || lang || ' client MUST send text. It', '   SHOULD NOT wait, see Section 2.1 and [RFC' || (doc_id % 9) || '], Section ' || (doc_id % 4) || '. The ' || lang || ' client MUST send text.',
  '', '1.1.  Scope', '', text, '', '2.  Figure ' || doc_id, '', 'A server MAY reply. It is OPTIONAL as RFC ' || (doc_id % 13) || ' says.', '',
  '2.1.  Rules', '', 'Peers SHALL NOT reset.', CASE WHEN doc_id % 3 = 0 THEN '' END, CASE WHEN doc_id % 3 = 0 THEN '1.5.  Backwards' END, '', '3.  End', '', 'n/a') AS text
FROM (SELECT {spread} doc_id, source, lang, text FROM {documents}) AS d""",
    # logs of a checking tool, one per order, built from its line items' flags
    "log_rows": """
SELECT 'log' || l_orderkey AS log_id, l_linenumber, l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS flag, max(l_linestatus) AS st
FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber""",
    "log": """
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY l_linenumber, l_partkey, sub) - 1 AS INT) AS line_no, text FROM (
SELECT log_id, l_linenumber, l_partkey, sub,
  """ + _LOG_TEXT + """ AS text
FROM (SELECT 'log' || l_orderkey AS log_id, l_linenumber, l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS flag, max(l_linestatus) AS st, {numbers_to_6} AS sub
  FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber) AS li
) AS q""",
    # counterexample logs, one per order: assertion, steps from its line items
    "cex": """
SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY part, l_linenumber, l_partkey, sub) - 1 AS INT) AS line_no, text FROM (
SELECT log_id, 0 AS part, 0 AS l_linenumber, 0 AS l_partkey, sub,
  CASE sub WHEN 0 THEN 'checking' WHEN 1 THEN 'The following assertion at line ' || (o_custkey % 90) || ' is not always true:'
    WHEN 2 THEN '  require pkt > ' || (o_custkey % 7) ELSE 'Counterexample:' END AS text
FROM (SELECT 'log' || o_orderkey AS log_id, o_custkey, {numbers_to_3} AS sub FROM {orders}) AS o
UNION ALL
SELECT log_id, 1 AS part, l_linenumber, l_partkey, sub,
  CASE sub WHEN 0 THEN '  Step ' || l_linenumber || ':' WHEN 1 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'note' ELSE '    Action: act_' || l_partkey END
    WHEN 2 THEN '    size = ' || l_suppkey ELSE '    size = ' || flag || ' ' END AS text
FROM (SELECT 'log' || l_orderkey AS log_id, l_linenumber, l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS flag, {numbers_to_3} AS sub
  FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_linenumber) AS li
) AS q""",
    # tool events
    "ev": """
SELECT CAST(ts AS TIMESTAMP) AS ts, event_id, 's' || user_id AS session_id, event_type AS name,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value > 90 THEN 'timeout' ELSE 'ok' END AS status, value AS duration_ms, props FROM {events}""",
}


#: Spark's own form of a relation, with the same rows, where the shared one would shuffle and sort what is only made up of a few columns:
#: line items are dealt by log once and numbered there, and each then gives its lines.
SPARK_FORM = {
    # line numbers run from 1 to 7, so that an id stands for one supplier, order and number: each is dealt once, as numbers, and then gives its variables
    "reads": """
SELECT 'f' || l_suppkey || '.spec:' || CAST(l_orderkey * 8 + l_linenumber AS INT) AS id, 'x' || v AS var
FROM (SELECT *, explode(array_distinct(array(2 * (l_orderkey % 1250), l_suppkey))) AS v
FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber
FROM (SELECT /*+ {by_order} */ l_suppkey, l_orderkey, l_linenumber FROM {lineitem}) AS a) AS b) AS c""",
    "log": """
SELECT log_id, CAST(7 * place + sub AS INT) AS line_no, """ + _LOG_TEXT + """ AS text
FROM (SELECT *, {numbers_to_6} AS sub
FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY l_linenumber, l_partkey) - 1 AS place
FROM (SELECT log_id, l_linenumber, l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS flag, max(l_linestatus) AS st
FROM (SELECT /*+ REPARTITION(log_id) */ 'log' || l_orderkey AS log_id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM {lineitem}) AS a
GROUP BY log_id, l_partkey, l_linenumber) AS b) AS c) AS d""",
}


def _fill(sql: str, places: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: places.get(m.group(1), m.group(0)), sql)


#: Line items whose distinct keys a task holds.
TASK_ROWS = 1 << 20
#: Tables of text, whose rows are worth spreading over the cores.
TEXT_TABLES = ("documents", "pages", "conversations")


def _cores(spark: SparkSession, sf: str, name: str) -> int:
    """Number of cores to spread a table over; 0 when its files keep all cores busy anyway.

    The driver tables are single files with one row group, which one task would read and process.
    """
    cores = spark.sparkContext.defaultParallelism
    return cores if len(spark.read.parquet(f"{sf}/{name}.parquet").inputFiles()) < cores else 0


def _spark_sql(spark: SparkSession, name: str, sf: str) -> str:
    places = {t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}
    places.update({f"numbers_to_{n}": f"explode(sequence(0, {n}))" for n in (3, 6)})
    cores = _cores(spark, sf, "documents" if name == "docs" else "part") if name in ("src", "docs") else 0
    if name == "reads":  # more tasks than the session has, where one would hold too many rows
        tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // TASK_ROWS)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        places["by_order"] = f"REPARTITION({tasks}, l_orderkey)" if tasks > least else "REPARTITION(l_orderkey)"
    places["spread"] = f"/*+ REPARTITION({cores}) */" if cores else ""
    return _fill(SPARK_FORM.get(name, DERIVED[name]), places)


#: Derived relations are fact tables: written once per application, then read like any other table.
_MADE: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        cores = _cores(spark, sf, name) if name in TEXT_TABLES else 0
        return df.repartition(cores) if cores else df
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MADE:
        path = f"{ensure_checkpoint_dir(spark)}/derived/{key[0]}/{sf.strip('/').replace('/', '_')}/{name}"
        spark.sql(_spark_sql(spark, name, sf)).write.mode("overwrite").parquet(path)
        _MADE[key] = path
    return spark.read.parquet(_MADE[key])


def scratch(spark: SparkSession, name: str) -> str:
    """Folder for a query's own tables, in the shared checkpoint directory of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cte(names: str, body: str) -> str:
    """DuckDB statement with the named derived relations as common table expressions."""
    places = {t: t for t in TABLES} | {"spread": ""} | {f"numbers_to_{n}": f"unnest(range(0, {n + 1}))" for n in (3, 6)}
    parts = [f"{n} AS ({_fill(DERIVED[n], places)})" for n in names.split()]
    return f"WITH {', '.join(parts)} {body}" if not body.lstrip().startswith("RECURSIVE") else (
        f"WITH RECURSIVE {', '.join(parts)} {body.lstrip()[len('RECURSIVE'):]}"
    )


#: Flat lines of the specification files, for twins that look at one line at a time.
LINES = """, lines AS (SELECT path, corpus, CAST(i - 1 AS INT) AS line, l[i] AS text
FROM (SELECT path, corpus, string_split(content, chr(10)) AS l FROM src) AS s, unnest(range(1, len(l) + 1)) AS t(i))"""
