"""Queries over text: lines, declarations, blocks, tags, documents, logs, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import blocks, documents, logs, patterns, symbols
from factloom.plans.prefixes import dotted_prefixes
from factloom.sources import corpus
from workload.derived import LINES, cte, scratch, table
from workload.registry import register

ON_LINES = lambda body: cte("src", LINES + body)


@register(
    "scan_corpus",
    """SELECT 'block=' || b AS folder, content, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS sha256, 'ok' AS status FROM (
SELECT doc_id // 16 AS b, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY 1) AS d""",
)
def _(spark, sf):
    # files of sixteen documents each are written and read back
    root = scratch(spark, "scan_corpus")
    d = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 16).alias("block"))
    d.repartition("block").sortWithinPartitions("block", "doc_id").select("block", "text").write.partitionBy("block").text(root)
    files = corpus.scan_corpus(spark, root, ".txt")
    return files.select(F.substring_index("path", "/", 1).alias("folder"), "content", "size", "sha256", "status")


@register(
    "scan_filter_layers",
    cte(
        "files",
        """SELECT path, corpus, CASE WHEN starts_with(path, 'corpus0/layer1/') THEN 'deep' ELSE 'zero' END AS layer
FROM files WHERE starts_with(path, 'corpus0/')""",
    ),
)
def _(spark, sf):
    layers = spark.createDataFrame(
        [("zero", "corpus0"), ("deep", "corpus0/layer1"), ("other", "corpus1")], "layer string, include_root string"
    )
    files = table(spark, sf, "files").select("path", "corpus")
    return corpus.scan_filter_layers(files, layers, ["zero", "deep"])


@register(
    "scan_manifest",
    cte(
        "manifest",
        """SELECT req_id, rfc, section, CASE WHEN level = '' THEN 'MUST' ELSE level END AS level, layer, text, testable FROM manifest""",
    ),
)
def _(spark, sf):
    # the manifest rows are written as JSON documents, one per layer and document, and read back
    m = table(spark, sf, "manifest")
    fields = F.struct(
        "section", "text", F.when(F.col("level") != "", F.col("level")).alias("level"), "layer"
    )
    bucket = F.pmod(F.hash("req_id"), F.lit(64))
    docs = m.groupBy("rfc", bucket.alias("b")).agg(
        F.to_json(
            F.struct(
                F.first("rfc").alias("rfc"),
                F.map_from_entries(F.collect_list(F.struct("req_id", fields))).alias("requirements"),
            )
        ).alias("content")
    )
    files = docs.select(F.concat_ws("/", "rfc", "b").alias("path"), "content")
    return corpus.manifest_from_json(files).drop("path")


@register(
    "infer_corpus",
    cte(
        "files",
        """SELECT path, CASE WHEN string_split(path, '/')[2] = 'layer3' THEN string_split(path, '/')[3]
  WHEN starts_with(path, 'corpus1/') THEN 'corpus1' END AS inferred FROM files""",
    ),
)
def _(spark, sf):
    return table(spark, sf, "files").select(
        "path", corpus.infer_corpus(F.col("path"), "layer3", ["corpus1"]).alias("inferred")
    )


@register(
    "explode_lines",
    """SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS d,
unnest(range(1, len(l) + 1)) AS t(i)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return blocks.explode_lines(d)


@register(
    "explode_lines_context",
    """SELECT conv_id, turn, CAST(i - 1 AS INT) AS line_no, l[i] AS text, CASE WHEN i > 1 THEN l[i - 1] END AS prev1, l[i + 1] AS next1
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations) AS d, unnest(range(1, len(l) + 1)) AS t(i)""",
)
def _(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return blocks.explode_lines(d, before=1, after=1)


@register(
    "extract_symbols",
    ON_LINES(
        """, d AS (SELECT path, line, text, regexp_extract(text, '^\\s*(type|action|relation|function|individual|object|module|isolate)\\s+[\\w.]+', 1) AS keyword FROM lines)
, n AS (SELECT *, regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS name,
  regexp_extract(text, '^\\s*\\w+\\s+[\\w.]+\\s*\\(([^)]*)\\)', 1) AS params, regexp_extract(text, 'returns\\s*\\(([^)]*)\\)', 1) AS rets,
  regexp_extract(text, '^\\s*type\\s+[\\w.]+\\s*=\\s*\\{([^}]+)\\}', 1) AS variants, regexp_extract(text, ':\\s*(\\w+)\\s*$', 1) AS sort
  FROM d WHERE keyword <> '')
SELECT path, line, name, keyword, CASE keyword WHEN 'type' THEN 'class' WHEN 'individual' THEN 'variable' WHEN 'object' THEN 'module' WHEN 'module' THEN 'module'
  WHEN 'isolate' THEN 'namespace' ELSE 'function' END AS kind,
  CASE WHEN keyword = 'type' AND variants <> '' THEN 'enum: ' || regexp_replace(trim(variants), '\\s*,\\s*', ', ', 'g') WHEN keyword = 'type' THEN 'type'
    WHEN keyword = 'action' AND (params <> '' OR rets <> '') THEN concat_ws(' ', CASE WHEN params <> '' THEN '(' || regexp_replace(params, '\\s*,\\s*', ', ', 'g') || ')' END, CASE WHEN rets <> '' THEN 'returns (' || rets || ')' END)
    WHEN keyword = 'relation' AND params <> '' THEN '(' || trim(params) || ')'
    WHEN keyword IN ('function', 'individual') AND sort <> '' THEN ': ' || sort ELSE keyword END AS detail,
  CASE WHEN rets <> '' THEN rets WHEN keyword IN ('function', 'individual') AND sort <> '' THEN sort END AS return_sort,
  variants <> '' AS is_enum, CASE WHEN params = '' OR keyword IN ('type', 'module') THEN 0 ELSE len(string_split(params, ',')) END AS n_params FROM n"""
    ),
)
def _(spark, sf):
    s = symbols.extract_symbols(table(spark, sf, "src"))
    return s.select("path", "line", "name", "keyword", "kind", "detail", "return_sort", "is_enum", F.size("params").alias("n_params"))


# declarations with their scopes, from the indentation of the lines
NESTED = """, m AS (SELECT path, line, text, length(regexp_replace(text, '^\\s+', '')) AS body, length(text) AS full_len,
  regexp_extract(text, '^\\s*(type|object|action|relation|module|isolate|property|axiom|conjecture|alias|before|after|instantiate|function|individual|definition|var|invariant|parameter|implement|derived|interpret|schema|theorem|export|import|destructor|constructor|around|attribute|include)\\s+(?:\\[\\s*\\w+|[\\w.]+)', 1) AS keyword FROM lines WHERE NOT starts_with(text, '#') AND text NOT LIKE '%<<<%' AND text NOT LIKE 'class%')
, o AS (SELECT *, (full_len - body) // 2 AS ind, regexp_replace(regexp_extract(text, '^\\s*\\w+\\s+(\\[\\s*\\w+|[\\w.]+)', 1), '^\\[\\s*', '') AS name FROM m WHERE keyword <> '')
, p AS (SELECT path, line, keyword, name, ind, last_value(CASE WHEN ind = 0 AND keyword IN ('object', 'module') THEN name WHEN ind = 0 THEN '' END IGNORE NULLS) OVER w AS p0,
  last_value(CASE WHEN ind = 1 AND keyword IN ('object', 'module') THEN name WHEN ind <= 1 THEN '' END IGNORE NULLS) OVER w AS p1
  FROM o WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, r AS (SELECT path, line, keyword, name, CASE WHEN keyword = 'include' OR ind = 0 THEN NULL WHEN ind = 1 THEN nullif(p0, '') WHEN ind = 2 THEN nullif(concat_ws('.', nullif(p0, ''), nullif(p1, '')), '') END AS parent_qname,
  CASE WHEN keyword = 'include' OR ind = 0 THEN 0 ELSE CASE WHEN p0 <> '' THEN 1 ELSE 0 END + CASE WHEN ind = 2 AND p1 <> '' THEN 1 ELSE 0 END END AS depth FROM p)
, s AS (SELECT *, concat_ws('.', parent_qname, name) AS qualified_name FROM r)
"""


@register(
    "extract_nested_symbols",
    ON_LINES(
        NESTED
        + "SELECT path, line, keyword, name, parent_qname, qualified_name FROM s"
    ),
)
def _(spark, sf):
    s = symbols.extract_nested_symbols(table(spark, sf, "src"))
    return s.select("path", "line", "keyword", "name", "parent_qname", "qualified_name")


@register(
    "document_outline",
    ON_LINES(
        NESTED
        + """SELECT path, line, depth, name, qualified_name, CASE WHEN keyword = 'type' THEN 'class' WHEN keyword IN ('object', 'module') THEN 'module' WHEN keyword IN ('action', 'before', 'after', 'implement', 'around') THEN 'method'
  WHEN keyword IN ('relation', 'function', 'definition', 'derived') THEN 'function' WHEN keyword = 'isolate' THEN 'namespace' WHEN keyword IN ('property', 'axiom', 'conjecture', 'invariant', 'theorem') THEN 'property'
  WHEN keyword IN ('alias', 'instantiate', 'individual', 'var', 'parameter') THEN 'variable' WHEN keyword IN ('export', 'import') THEN 'event' WHEN keyword = 'include' THEN 'file' WHEN keyword = 'attribute' THEN 'constant'
  WHEN keyword = 'interpret' THEN 'type_parameter' WHEN keyword = 'schema' THEN 'interface' WHEN keyword = 'destructor' THEN 'field' WHEN keyword = 'constructor' THEN 'enum_member' END AS kind FROM s WHERE name <> ''"""
    ),
)
def _(spark, sf):
    o = symbols.document_outline(symbols.extract_nested_symbols(table(spark, sf, "src")))
    return o.select("path", "line", "depth", "name", "qualified_name", "kind")


@register(
    "symbols_to_nodes",
    ON_LINES(
        """, d AS (SELECT path, line, text, regexp_extract(text, '^\\s*(type|action|relation|function|individual|object|module|isolate)\\s+[\\w.]+', 1) AS node_type,
  regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS name FROM lines)
SELECT path || ':' || (line + 1) || ':' || name AS id, node_type, name, path, line + 1 AS line FROM d WHERE node_type <> ''"""
    ),
)
def _(spark, sf):
    n = symbols.symbols_to_nodes(symbols.extract_symbols(table(spark, sf, "src")))
    return n.select("id", "node_type", "name", "path", "line")


@register(
    "extract_includes",
    ON_LINES(
        "SELECT path AS from_path, line, regexp_extract(text, '^include\\s+(\\w+)', 1) AS include_name FROM lines WHERE regexp_matches(text, '^include\\s+\\w+')"
    ),
)
def _(spark, sf):
    return symbols.extract_includes(table(spark, sf, "src")).select("from_path", "line", "include_name")


@register(
    "extract_references",
    ON_LINES(
        """, f AS (SELECT path, line, regexp_extract(text, '^\\s*(?:action|relation|function)\\s+([\\w.]+)', 1) AS decl, regexp_extract(text, 'call\\s+([\\w.]+)\\s*(?:\\(|;|$)', 1) AS callee, text FROM lines)
, g AS (SELECT path, line, callee, last_value(nullif(decl, '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS src FROM f)
SELECT path, line, src AS source_name, callee AS target_name, 'call' AS kind FROM g WHERE callee <> '' AND src IS NOT NULL
UNION ALL SELECT path, line, regexp_extract(text, '^\\s*instance\\s+([\\w.]+)', 1), regexp_extract(text, '^\\s*instance\\s+[\\w.]+\\s*:\\s*([\\w.]+)', 1), 'instance' FROM lines WHERE regexp_matches(text, '^\\s*instance\\s+[\\w.]+\\s*:\\s*[\\w.]+')
UNION ALL SELECT path, line, regexp_extract(text, '^\\s*(before|after|around)', 1) || ' ' || regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1), regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1), 'monitor' FROM lines WHERE regexp_matches(text, '^\\s*(before|after|around)\\s+[\\w.]+')"""
    ),
)
def _(spark, sf):
    src = table(spark, sf, "src")
    return symbols.extract_references(src, symbols.extract_symbols(src))


@register(
    "extract_exports",
    ON_LINES(
        """SELECT path, line, regexp_extract(text, '^\\s*(?:action\\s+)?(?:export|import)\\s+([\\w.]+)', 1) AS name, regexp_extract(text, '^\\s*(?:action\\s+)?(export|import)', 1) AS direction
FROM lines WHERE regexp_matches(text, '^\\s*(?:action\\s+)?(?:export|import)\\s+[\\w.]+')"""
    ),
)
def _(spark, sf):
    return symbols.extract_exports(table(spark, sf, "src"))


# blocks of the derived files close at the next line that is a lone brace in the first column, or on their own line
_BLOCKS = """, b AS (SELECT path, line, text, regexp_extract(text, '^\\s*(before|after|around|implement|action)\\s+[\\w.]+\\s*(?:\\([^)]*\\))?\\s*(?:returns\\s*\\([^)]*\\))?\\s*=?\\s*\\{', 1) AS head,
  CASE WHEN text = '}' THEN line END AS closer FROM lines)
, c AS (SELECT *, first_value(closer IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_close FROM b)
, blk AS (SELECT path, CASE WHEN head = 'action' THEN 'direct' ELSE head END AS mixin_kind, regexp_extract(text, '^\\s*\\w+\\s+([\\w.]+)', 1) AS monitor_action, line AS start_line,
  CASE WHEN text LIKE '%}' THEN line ELSE next_close END AS end_line FROM c WHERE head <> '')
"""


@register(
    "extract_blocks",
    ON_LINES(_BLOCKS + "SELECT path, mixin_kind, monitor_action, start_line, end_line FROM blk WHERE end_line IS NOT NULL"),
)
def _(spark, sf):
    return blocks.extract_blocks(table(spark, sf, "src")).drop("has_generating_guard")


@register(
    "extract_requirements",
    ON_LINES(
        _BLOCKS
        + """SELECT l.path || ':' || l.line AS id, l.path, l.line, regexp_extract(text, '^\\s*(\\w+)', 1) AS kind, trim(regexp_extract(text, '^\\s*\\w+\\s+(.+?);', 1)) AS formula_text,
  blk.monitor_action, blk.mixin_kind, array_to_string(string_split(regexp_replace(regexp_extract(text, '#\\s*\\[([^\\]]+)\\]', 1), '\\s', '', 'g'), ','), ',') AS tags
FROM lines AS l ASOF JOIN blk ON blk.path = l.path AND l.line > blk.start_line WHERE l.line < blk.end_line AND regexp_matches(text, '^\\s*(require|ensure|assume|assert)\\s+.+;')"""
    ),
)
def _(spark, sf):
    r = blocks.extract_requirements(table(spark, sf, "src"))
    return r.withColumn("tags", F.array_join("tags", ","))


@register(
    "extract_writes",
    ON_LINES(
        _BLOCKS
        + """SELECT l.path, l.line, regexp_extract(text, '^\\s*([\\w.]+)', 1) AS var_name, blk.monitor_action, blk.mixin_kind FROM lines AS l
ASOF JOIN blk ON blk.path = l.path AND l.line > blk.start_line WHERE l.line < blk.end_line AND regexp_matches(text, '^\\s*[\\w.]+(\\([^)]*\\))?\\s*:=')"""
    ),
)
def _(spark, sf):
    return blocks.extract_writes(table(spark, sf, "src"))


@register(
    "extract_properties",
    ON_LINES(
        """SELECT path || ':' || line AS id, regexp_extract(text, '^\\s*(\\w+)', 1) AS kind, regexp_extract(text, '\\[(\\w+)\\]', 1) AS name, trim(regexp_replace(text, '^\\s*\\w+\\s+\\[\\w+\\]', '')) AS formula_text, path, line
FROM lines WHERE regexp_matches(text, '^\\s*(invariant|property|axiom|conjecture)\\s+')"""
    ),
)
def _(spark, sf):
    return symbols.extract_properties(table(spark, sf, "src"))


_TAGGED = """, t AS (SELECT path, line, trim(text) AS text FROM lines), u AS (SELECT path, line, text, CASE WHEN starts_with(text, '#')
  THEN CASE WHEN contains(substr(regexp_replace(text, '\\[[\\w:.,\\s]+\\]\\s*$', ''), 2), '#') THEN '' ELSE regexp_extract(text, '\\[([\\w:.,\\s]+)\\]\\s*$', 1) END
  ELSE regexp_extract(text, '#\\s*\\[([\\w:.,\\s]+)\\]\\s*$', 1) END AS raw FROM t)
, tags AS (SELECT path, line, [trim(x) FOR x IN string_split(raw, ',') IF regexp_matches(trim(x), '^\\w+(?:[.:]\\w+)*$')] AS tags FROM u WHERE raw <> '')
"""


@register("parse_tags", ON_LINES(_TAGGED + "SELECT path, line, array_to_string(tags, '|') AS tags FROM tags WHERE len(tags) > 0"))
def _(spark, sf):
    lines = blocks.explode_lines(table(spark, sf, "src").select("path", "content"))
    rows = lines.select("path", F.col("line_no").alias("line"), T.parse_tags(F.col("text")).alias("tags"))
    return rows.filter(F.size("tags") > 0).withColumn("tags", F.array_join("tags", "|"))


@register(
    "extract_annotations",
    ON_LINES(
        _TAGGED
        + """SELECT path || ':' || line || ':0' AS id, path, line, array_to_string(tags, '|') AS tags FROM tags
WHERE len([x FOR x IN tags IF NOT regexp_matches(x, '^\\d+$')]) > 0"""
    ),
)
def _(spark, sf):
    a = symbols.extract_annotations(table(spark, sf, "src"))
    return a.withColumn("tags", F.array_join("tags", "|"))


@register(
    "extract_native_blocks",
    cte(
        "src",
        """SELECT path, len(regexp_extract_all(content, '<<<\\s*impl')) AS impl_blocks, len(regexp_extract_all(content, '<<<\\s*member')) AS member_blocks,
  regexp_replace(trim(regexp_extract(content, 'enum \\{([^}]+)\\}', 1)), '\\s*,\\s*', ',', 'g') AS states,
  array_to_string(regexp_extract_all(content, 'class\\s+(\\w+)\\s*:\\s*public', 1), ',') AS classes, 'send' AS socket_ops,
  len(regexp_extract_all(content, 'setn\\(')) AS setn_calls, 0 AS getn_calls FROM src WHERE content LIKE '%<<<%'""",
    ),
)
def _(spark, sf):
    n = patterns.extract_native_blocks(table(spark, sf, "src"))
    return n.withColumns({c: F.array_join(c, ",") for c in ("states", "classes", "socket_ops")})


@register(
    "extract_variant_structs",
    ON_LINES(
        """, o AS (SELECT path, line, text, last_value(nullif(regexp_extract(text, 'object\\s+(\\w+)\\s*=\\s*\\{', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS name FROM lines)
SELECT path, line, regexp_extract(text, 'variant this of (\\w+)', 1) AS parent, name, regexp_replace(trim(regexp_extract(text, 'struct\\s*\\{([^}]+)\\}', 1)), '\\s*([:,])\\s*', '\\1', 'g') AS fields
FROM o WHERE regexp_matches(text, 'variant this of \\w+ = struct') AND name <> regexp_extract(text, 'variant this of (\\w+)', 1)"""
    ),
)
def _(spark, sf):
    v = patterns.extract_variant_structs(table(spark, sf, "src"))
    return v.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ","))


@register(
    "extract_tag_map",
    ON_LINES(
        """SELECT path, CAST(regexp_extract(text, 'tag == (\\d+)', 1) AS INT) AS tag, regexp_extract(text, 'frame_type = (0x\\w+)', 1) AS wire_type FROM lines WHERE regexp_matches(text, 'tag == \\d+\\).*frame_type = 0x')"""
    ),
)
def _(spark, sf):
    return patterns.extract_tag_map(table(spark, sf, "src"))


# ---- documents ------------------------------------------------------------------------------------

# accepted headers: candidates after a blank line with a real title, monotone against the last accepted one
_SECTIONS = """RECURSIVE , dl AS (SELECT doc, CAST(i - 1 AS INT) AS line, trim(l[i], chr(9) || chr(10) || chr(13) || ' ') AS t, CASE WHEN i > 1 THEN trim(l[i - 1]) END AS prev, l, len(l) AS n
  FROM (SELECT doc, string_split(text, chr(10)) AS l FROM docs) AS s, unnest(range(1, len(l) + 1)) AS u(i))
, cand AS (SELECT doc, line, l, n, regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\.\\s{2,}(\\S.*)$', 1) AS number, trim(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\.\\s{2,}(\\S.*)$', 2)) AS title
  FROM dl WHERE regexp_matches(t, '^(\\d+(?:\\.\\d+)*)\\.\\s{2,}(\\S.*)$') AND coalesce(prev, '') = '')
, ok AS (SELECT *, [CAST(p AS BIGINT) FOR p IN string_split(number, '.')] AS parts, row_number() OVER (PARTITION BY doc ORDER BY line) AS rn FROM cand
  WHERE length(title) >= 2 AND NOT regexp_matches(title, '^(\\d+$|Figure|Table)'))
, fold AS (SELECT doc, rn, parts AS prev, true AS accepted FROM ok WHERE rn = 1
  UNION ALL SELECT ok.doc, ok.rn, CASE WHEN fwd THEN ok.parts ELSE prev END, fwd FROM (SELECT ok.*, fold.prev, CASE WHEN len(ok.parts) < len(fold.prev) THEN true
    WHEN len(ok.parts) = len(fold.prev) THEN ok.parts > fold.prev ELSE ok.parts[1:len(fold.prev)] >= fold.prev END AS fwd FROM ok JOIN fold ON fold.doc = ok.doc AND ok.rn = fold.rn + 1) AS ok)
, acc AS (SELECT ok.*, coalesce(lead(ok.line) OVER (PARTITION BY ok.doc ORDER BY ok.line), n) AS stop FROM ok JOIN fold USING (doc, rn) WHERE accepted)
, sec AS (SELECT doc, number, title, line AS start_line, regexp_replace(regexp_replace(array_to_string(l[line + 2:stop], chr(10)), '^\\s+', ''), '\\s+$', '') AS text FROM acc)
"""


def _sections(spark, sf):
    return documents.parse_sections(table(spark, sf, "docs"))


@register("parse_sections", cte("docs", _SECTIONS + "SELECT doc, number, title, start_line, text FROM sec"))
def _(spark, sf):
    return _sections(spark, sf).drop("ordinal")


@register(
    "get_section_text",
    cte(
        "docs",
        _SECTIONS
        + """SELECT doc, '1' AS number, string_agg(text, chr(10) || chr(10) ORDER BY start_line) AS text, count(*) AS sections FROM sec
WHERE number = '1' OR starts_with(number, '1.') GROUP BY doc""",
    ),
)
def _(spark, sf):
    wanted = table(spark, sf, "docs").select("doc", F.lit("1").alias("number"))
    return documents.get_section_text(_sections(spark, sf), wanted)


_NORMATIVE = """, js AS (SELECT doc, number, trim(regexp_replace(text, '\\n\\s+', ' ', 'g')) AS j FROM sec)
, sn AS (SELECT DISTINCT doc, number, regexp_replace(trim(s) || '.', '\\s+', ' ', 'g') AS s FROM (SELECT doc, number, unnest(string_split(regexp_replace(regexp_replace(j, '\\.\\s+([A-Z])', '.' || chr(2) || '\\1', 'g'), '\\.\\s*$', ''), '.' || chr(2))) AS s FROM js) AS x WHERE trim(s) <> '')
, kw AS (SELECT * FROM (VALUES (1, 'MUST NOT'), (2, 'SHALL NOT'), (3, 'SHOULD NOT'), (4, 'MUST'), (5, 'SHALL'), (6, 'REQUIRED'), (7, 'SHOULD'), (8, 'RECOMMENDED'), (9, 'MAY'), (10, 'OPTIONAL')) AS v(p, k))
, norm AS (SELECT doc, number AS section, min_by(k, p) AS keyword, s AS text FROM sn JOIN kw ON regexp_matches(s, '\\b' || k || '\\b') GROUP BY doc, number, s)
"""


@register("extract_normative", cte("docs", _SECTIONS + _NORMATIVE + "SELECT doc, section, keyword, text FROM norm"))
def _(spark, sf):
    return documents.extract_normative(_sections(spark, sf))


_REFS = """, jj AS (SELECT doc, number, regexp_replace(text, '\\n\\s+', ' ', 'g') AS j FROM sec)
, r1 AS (SELECT DISTINCT doc, number, 'rfc' || regexp_extract(m, 'RFC\\s*(\\d+)', 1) AS target_doc, regexp_extract(m, '(\\d+(?:\\.\\d+)*)$', 1) AS target_section FROM (SELECT doc, number, unnest(regexp_extract_all(j, '(?i)\\[RFC\\s*\\d+\\]\\s*,?\\s*Section\\s+\\d+(?:\\.\\d+)*')) AS m FROM jj) AS x)
, r2 AS (SELECT DISTINCT doc, number, NULL AS target_doc, regexp_extract(m, '(\\d+(?:\\.\\d+)*)$', 1) AS target_section FROM (SELECT doc, number, unnest(regexp_extract_all(regexp_replace(j, '(?i)\\[RFC\\s*\\d+\\]\\s*,?\\s*Section\\s+\\d+(?:\\.\\d+)*', '', 'g'), '(?i)Section\\s+\\d+(?:\\.\\d+)*')) AS m FROM jj) AS x)
, r3 AS (SELECT DISTINCT doc, number, 'rfc' || regexp_extract(m, '(?i)RFC\\s*(\\d+)', 1) AS target_doc, NULL AS target_section FROM (SELECT doc, number, unnest(regexp_extract_all(j, '(?i)\\[RFC\\s*\\d+\\]|RFC\\s+\\d+')) AS m FROM jj) AS x)
, refs AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 ANTI JOIN r1 USING (doc, number, target_doc))
"""


@register(
    "extract_cross_refs",
    cte("docs", _SECTIONS + _REFS + "SELECT doc, number AS source_section, target_doc, target_section FROM refs"),
)
def _(spark, sf):
    return documents.extract_cross_refs(_sections(spark, sf)).select("doc", "source_section", "target_doc", "target_section")


@register(
    "section_report",
    cte(
        "docs",
        _SECTIONS + _NORMATIVE + _REFS
        + """SELECT doc, 'section' AS part, title AS label FROM sec WHERE number = '1' UNION ALL SELECT doc, 'statement', keyword FROM norm WHERE section = '1'
UNION ALL SELECT doc, 'reference', concat_ws(':', target_doc, target_section) FROM refs WHERE number = '1'""",
    ),
)
def _(spark, sf):
    return documents.section_report(_sections(spark, sf), "1").select("doc", "part", "label")


@register(
    "tag_sections",
    cte(
        "docs",
        _SECTIONS + """SELECT doc || ':' || number AS tag, doc, title FROM sec WHERE number IN ('1.1', '3')""",
    ),
)
def _(spark, sf):
    s = _sections(spark, sf)
    tags = s.select(F.explode(F.array(F.concat_ws(":", "doc", F.lit("1.1")), F.concat_ws(":", "doc", F.lit("3")), F.lit("4.1"))).alias("tag"))
    return documents.tag_sections(tags, s).select("tag", "doc", "title")


_SENTENCES = """, pc AS (SELECT doc, string_split(text, '.') AS p FROM docs), ps AS (SELECT doc, i, p[i] AS s, CAST(coalesce(list_sum([length(x) + 1 FOR x IN p[1:i - 1]]), 0) AS INT) AS off FROM pc, unnest(range(1, len(p))) AS u(i))
, rs AS (SELECT doc, i, regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '') || '.' AS text, off AS "offset", regexp_extract(s, '\\b(MUST NOT|MUST|SHALL NOT|SHALL|SHOULD NOT|SHOULD|MAY|REQUIRED|RECOMMENDED|OPTIONAL)\\b', 1) AS w FROM ps)
, lv AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) AS n, text, "offset", CASE w WHEN 'SHALL' THEN 'MUST' WHEN 'REQUIRED' THEN 'MUST' WHEN 'SHALL NOT' THEN 'MUST NOT' WHEN 'RECOMMENDED' THEN 'SHOULD' WHEN 'OPTIONAL' THEN 'MAY' ELSE w END AS level FROM rs WHERE w <> '')
"""


@register(
    "extract_requirement_sentences",
    cte("docs", _SENTENCES + """SELECT doc, text, level, "offset" FROM lv"""),
)
def _(spark, sf):
    return documents.extract_requirement_sentences(table(spark, sf, "docs")).drop("ordinal")


@register(
    "generate_manifest",
    cte(
        "docs",
        _SENTENCES + """SELECT doc || ':4.' || n AS req_id, doc AS rfc, '4.' || n AS section, text, level, '' AS layer, true AS testable FROM lv""",
    ),
)
def _(spark, sf):
    return documents.generate_manifest(table(spark, sf, "docs"), "4")


@register(
    "requirement_levels",
    cte("docs", _SENTENCES + "SELECT level, count(*) AS n FROM lv GROUP BY level"),
)
def _(spark, sf):
    return documents.extract_requirement_sentences(table(spark, sf, "docs")).groupBy("level").agg(F.count("*").alias("n"))


@register(
    "page_headings",
    """SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_extract(h[i], '<h[1-6][^>]*>(.*)', 1) AS heading FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*') AS h FROM pages) AS p,
unnest(range(1, len(h) + 1)) AS t(i)""",
)
def _(spark, sf):
    found = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(found).alias("pos", "heading"))


# ---- logs -----------------------------------------------------------------------------------------


@register(
    "scan_check_log",
    cte(
        "log",
        """, l AS (SELECT CAST(substr(log_id, 4) AS BIGINT) AS o, line_no, text FROM log)
, b AS (SELECT o // 256 AS block, CAST(row_number() OVER (PARTITION BY o // 256 ORDER BY o, line_no) - 1 AS INT) AS line_no, text FROM l)
SELECT * FROM b UNION ALL SELECT block, CAST(count(*) AS INT), '' FROM b GROUP BY block""",
    ),
)
def _(spark, sf):
    # the logs of 256 orders make one file, which ends with a line break; files are zipped, as logs that are kept mostly are
    root = scratch(spark, "scan_check_log")
    o = F.substring("log_id", 4, 20).cast("long")
    rows = table(spark, sf, "log").select(o.alias("o"), "line_no", "text", F.floor(o / 256).alias("block"))
    rows.repartition("block").sortWithinPartitions("block", "o", "line_no").select("block", "text").write.partitionBy("block").text(root, compression="gzip")
    block = F.regexp_extract("log_id", "block=([0-9]+)", 1).cast("long")
    return corpus.scan_check_log(spark, f"{root}/*/*.txt.gz").select(block.alias("block"), F.col("line_no").cast("int"), "text")


@register(
    "parse_diagnostics_log",
    cte(
        "log",
        """, d AS (SELECT log_id, line_no, text, CASE WHEN regexp_matches(text, '^.*?\\.\\w+:\\d+:\\d+:\\s*(error|warning|fatal error):') THEN 'compiler'
  WHEN regexp_matches(text, '^.*?:\\s*line\\s+\\d+:\\s*(error|warning):') OR regexp_matches(text, '^.*?:\\d+:\\s*(error|warning):') THEN 'checker'
  WHEN regexp_matches(text, '^\\w+Error\\s*:') THEN 'exception' END AS source FROM log)
, e AS (SELECT log_id, line_no, source, CASE WHEN source = 'exception' THEN '' ELSE regexp_extract(text, '^([^:]+):', 1) END AS file,
  CASE WHEN source = 'exception' THEN 0 ELSE CAST(regexp_extract(text, ':(?:\\s*line\\s+)?(\\d+):', 1) AS BIGINT) END AS line,
  CASE WHEN source = 'exception' THEN 'error' ELSE replace(regexp_extract(text, '(fatal error|error|warning):', 1), 'fatal ', '') END AS severity,
  CASE WHEN source = 'exception' THEN text ELSE regexp_extract(text, '(?:error|warning):\\s*(.*)$', 1) END AS message FROM d WHERE source IS NOT NULL)
SELECT log_id, min(line_no) AS line_no, file, line, min_by(severity, line_no) AS severity, message, min_by(source, line_no) AS source FROM e GROUP BY log_id, file, line, message""",
    ),
)
def _(spark, sf):
    return logs.parse_diagnostics_log(table(spark, sf, "log"))


_CHECKS = """, ctx AS (SELECT log_id, line_no, trim(text) AS t, last_value(nullif(regexp_extract(trim(text), '^Isolate\\s+(.+?)\\s*:$', 1), '') IGNORE NULLS) OVER w AS isolate,
  last_value(CASE WHEN starts_with(trim(text), 'Isolate ') THEN 'none' WHEN text LIKE 'The following properties%' THEN 'property' WHEN text LIKE 'The following program%' THEN 'guarantee' WHEN text LIKE 'The following%' THEN 'none' END IGNORE NULLS) OVER w AS check_type,
  last_value(CASE WHEN starts_with(trim(text), 'Isolate ') OR text LIKE 'The following%' THEN '' ELSE nullif(regexp_replace(regexp_extract(trim(text), '^in action (.+):$', 1), '\\s+$', ''), '') END IGNORE NULLS) OVER w AS action
  FROM log WINDOW w AS (PARTITION BY log_id ORDER BY line_no))
, checks AS (SELECT log_id, line_no, isolate, check_type, nullif(action, '') AS action, regexp_extract(t, '^([\\w./-]+\\.\\w+): line', 1) AS file, CAST(regexp_extract(t, 'line (\\d+):', 1) AS BIGINT) AS line, regexp_extract(t, '(PASS|FAIL)$', 1) AS result
  FROM ctx WHERE check_type <> 'none' AND isolate IS NOT NULL AND regexp_matches(t, '^[\\w./-]+\\.\\w+: line \\d+: .+ \\.\\.\\. (PASS|FAIL)$'))
"""


@register("parse_check_results", cte("log", _CHECKS + "SELECT * FROM checks"))
def _(spark, sf):
    return logs.parse_check_results(table(spark, sf, "log"))


@register(
    "check_summary",
    cte(
        "log",
        _CHECKS
        + """SELECT isolate, check_type, count(*) AS total, count(*) FILTER (result = 'PASS') AS passed, count(*) FILTER (result = 'FAIL') AS failed, CAST(grouping(isolate, check_type) AS BIGINT) AS grouping FROM checks GROUP BY ROLLUP (isolate, check_type)""",
    ),
)
def _(spark, sf):
    return logs.check_summary(logs.parse_check_results(table(spark, sf, "log")))


@register(
    "failed_checks",
    cte("log", _CHECKS + "SELECT isolate, action, count(*) AS failed, min(file) AS first_file FROM checks WHERE result = 'FAIL' GROUP BY isolate, action"),
)
def _(spark, sf):
    return logs.failed_checks(logs.parse_check_results(table(spark, sf, "log")))


@register(
    "check_headline",
    cte("log", _CHECKS + "SELECT log_id, count(*) AS total, count(*) FILTER (result = 'FAIL') AS failed FROM checks GROUP BY log_id"),
)
def _(spark, sf):
    return logs.check_headline(logs.parse_check_results(table(spark, sf, "log"))).select("log_id", "total", "failed")


@register(
    "parse_counterexamples",
    cte(
        "cex",
        """, s AS (SELECT log_id, line_no, text, last_value(CASE WHEN regexp_matches(text, '^\\s*Step \\d+:') THEN line_no END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no) AS step_at FROM cex)
, g AS (SELECT log_id, step_at, CAST(min(regexp_extract(text, 'Step (\\d+)', 1)) FILTER (line_no = step_at) AS BIGINT) AS step_number, min(trim(regexp_extract(text, 'Action: (.+)$', 1))) FILTER (text LIKE '%Action:%') AS action,
  'size=' || max_by(trim(regexp_extract(text, '= (.+)$', 1)), line_no) FILTER (text LIKE '%size = %') AS assignments FROM s WHERE step_at IS NOT NULL GROUP BY log_id, step_at)
, h AS (SELECT log_id, CAST(min(regexp_extract(text, 'at line (\\d+) is', 1)) FILTER (text LIKE 'The following%') AS BIGINT) AS assertion_line, min(trim(text)) FILTER (text LIKE '  require%') AS assertion FROM cex GROUP BY log_id HAVING count(*) FILTER (text = 'Counterexample:') > 0)
SELECT h.log_id, assertion_line, assertion, step_number, action, coalesce(assignments, '') AS assignments FROM h LEFT JOIN g USING (log_id)""",
    ),
)
def _(spark, sf):
    c = logs.parse_counterexamples(table(spark, sf, "cex"))
    shown = F.array_join(F.transform(F.map_entries("assignments"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return c.withColumn("assignments", shown)


@register(
    "parse_isolate_status",
    cte(
        "log",
        """SELECT log_id, line_no, regexp_extract(text, '^isolate (\\S+)', 1) AS isolate, regexp_extract(text, ': (\\w+)$', 1) AS status, regexp_extract(text, ': (\\w+)$', 1) <> 'FAIL' AS passed FROM log WHERE text LIKE 'isolate %'""",
    ),
)
def _(spark, sf):
    return logs.parse_isolate_status(table(spark, sf, "log"))


# ---- scalar rules -----------------------------------------------------------------------------------


@register(
    "name_parts",
    cte(
        "symbols",
        "SELECT qualified_name, string_split(qualified_name, '.')[-1] AS leaf, CASE WHEN contains(qualified_name, '.') THEN regexp_replace(qualified_name, '\\.[^.]*$', '') ELSE qualified_name END AS module, len(string_split(qualified_name, '.')) AS parts FROM symbols",
    ),
)
def _(spark, sf):
    q = F.col("qualified_name")
    return table(spark, sf, "symbols").select(
        q, T.last_component(q).alias("leaf"), T.module_of(q).alias("module"), F.size(dotted_prefixes(q)).alias("parts")
    )


@register("last_component", cte("symbols", "SELECT qualified_name, string_split(qualified_name, '.')[-1] AS leaf FROM symbols"))
def _(spark, sf):
    q = F.col("qualified_name")
    return table(spark, sf, "symbols").select(q, T.last_component(q).alias("leaf"))


@register(
    "module_of",
    cte("symbols", "SELECT qualified_name, CASE WHEN contains(qualified_name, '.') THEN regexp_replace(qualified_name, '\\.[^.]*$', '') ELSE qualified_name END AS module FROM symbols"),
)
def _(spark, sf):
    q = F.col("qualified_name")
    return table(spark, sf, "symbols").select(q, T.module_of(q).alias("module"))
