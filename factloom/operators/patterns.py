"""Structural patterns of a specification corpus.

Each detector is an array expression over the numbered text of one file, so that any choice of detectors
costs one scan and no shuffle: the arrays are concatenated in the row and exploded once. The guard flag of
monitors needs matched braces and comes from the block job; entities come from an ordered scan over a file's tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.blocks import extract_blocks
from factloom.plans.lineage import cut_lineage

KINDS = ["serdes", "variants", "monitors", "shim", "module", "entity", "include_chain"]
#: The kinds that ``pattern_crossref`` looks at.
CROSSREF_KINDS = ["serdes", "monitors", "shim", "module", "entity"]

# Base classes of serializers, socket calls, connection state names.
SERIALIZER_BASE = r"binary_ser_[0-9]+"
DESERIALIZER_BASE = r"binary_deser_[0-9]+"
SOCKET_CALL = r"\b(socket|send|recv|bind|listen|accept|connect)\b"
CONNECTION_RELATIONS = ["isup", "pend"]
TRANSPORTS = {"ip.udp": "udp", "ip.tcp": "tcp"}
#: A struct belongs to an object when it starts within this many characters of the object.
STRUCT_REACH = 200

_FIELD = "array<struct<name:string,type:string>>"
_ROW = (
    "array<struct<kind:string,subtype:string,line:int,name:string,details:map<string,string>,"
    f"fields:{_FIELD},args:array<string>,states:array<string>>>"
)



def _text() -> Column:
    """Numbered text of the file."""
    return F.col("_n")


_IMPL = r"<<<\s*impl\b([\s\S]*?)>>>"
_MEMBER = r"<<<\s*member\b([\s\S]*?)>>>"
_OBJECT = rf"{T.BOL}object[ \t]+[\w.]+{T.WS}={T.WS}\{{"
_STRUCT = rf"type[ \t]+this{T.WS}={T.WS}struct{T.WS}\{{[^}}]+\}}"
_MODULE = rf"{T.BOL}module[ \t]+[\w.]+{T.WS}\([^)]*\){T.WS}={T.WS}\{{"
_INSTANCE = rf"{T.BOL}instance[ \t]+[\w.]+{T.WS}:{T.WS}[\w.]+{T.WS}(?:\([^)]*\))?"
_IMPLEMENT = rf"{T.BOL}implement[ \t]+[\w.]+{T.WS}(?:\([^)]*\){T.WS})?\{{"
_VARIANT = rf"{T.BOL}variant[ \t]+this[ \t]+of[ \t]+\w+"


def _row(kind, subtype, line, name, details=None, fields=None, args=None, states=None) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), lit(v))]
    return F.struct(
        F.lit(kind).alias("kind"),
        lit(subtype).alias("subtype"),
        line.alias("line"),
        lit(name).alias("name"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("details"),
        (fields if fields is not None else F.array()).cast(_FIELD).alias("fields"),
        (args if args is not None else F.array()).cast("array<string>").alias("args"),
        (states if states is not None else F.array()).cast("array<string>").alias("states"),
    )


def _each(pattern: str, make) -> Column:
    return F.transform(T.hits(_text(), pattern), lambda h: make(F.trim(T.unnumbered(h)), T.first_line(h)))


def _once(condition: Column, row: Column) -> Column:
    return F.when(condition, F.array(row)).otherwise(F.array().cast(_ROW))


def _native(pattern: str) -> Column:
    raw = F.regexp_extract_all(_text(), F.lit(pattern), F.lit(1))
    return F.transform(raw, lambda b: T.unnumbered(b))


def _native_text(pattern: str) -> Column:
    return F.array_join(_native(pattern), " ")


def _first_impl_line() -> Column:
    """Line of the first implementation block: the last line mark before it."""
    before = F.regexp_extract(_text(), r"^([\s\S]*?)<<<\s*impl\b", 1)
    return F.coalesce(T.last_line(before), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("string")


def serdes_rows() -> Column:
    impl, member = F.col("_impl"), F.col("_member")
    states = T.trimmed_list(
        F.regexp_extract(impl, r"enum\s*\{([^}]+)\}\s*\w+\s*;", 1)
    )
    cls = r"class\s+`?\w+`?\s*:\s*public\s+\w+"

    def class_row(h: Column) -> Column:
        base = F.regexp_extract(h, r"public\s+(\w+)$", 1)
        ser = base.rlike(SERIALIZER_BASE)
        return _row(
            "serdes",
            F.when(ser, "serializer").otherwise("deserializer"),
            F.col("_impl_line"),
            F.regexp_extract(h, r"class\s+`?(\w+)", 1),
            {
                "base_class": base,
                "calls": F.when(ser, _count(impl, r"\bsetn\s*\([^)]+\)")).otherwise(
                    _count(impl, r"\bgetn\s*\([^)]+\)")
                ),
            },
            states=states,
        )

    classes = F.filter(
        F.regexp_extract_all(F.concat_ws(" ", impl, member), F.lit(cls), F.lit(0)),
        lambda h: h.rlike(f"public\\s+\\w*(?:{SERIALIZER_BASE}|{DESERIALIZER_BASE})"),
    )
    inst = rf"{T.BOL}instance[ \t]+[\w.]+{T.WS}:{T.WS}serdes{T.WS}\([^)]+\)"

    def instance_row(h: Column, line: Column) -> Column:
        args = F.transform(F.split(F.regexp_extract(h, r"(?s)\(([^)]+)\)$", 1), ","), lambda a: F.trim(a))
        return _row(
            "serdes", "instance", line, F.regexp_extract(h, r"^instance\s+([\w.]+)", 1),
            {
                "message_type": F.get(args, F.lit(0)),
                "ser_name": F.get(args, F.lit(2)),
                "deser_name": F.get(args, F.lit(3)),
            },
            args=args,
        )

    return F.concat(F.transform(classes, class_row).cast(_ROW), _each(inst, instance_row).cast(_ROW))


def variants_rows() -> Column:
    # the object with its text up to the struct, to check the distance without line marks; found once, then cut after the object
    near = rf"(?=({_OBJECT}[\s\S]{{0,{STRUCT_REACH * 10}}}?{T.BOL}{_STRUCT})){_OBJECT}"

    def cut(h: Column) -> Column:
        head = F.regexp_extract(h, rf"^{_OBJECT}", 0)
        return F.struct(head.alias("head"), F.substr(h, F.length(head) + 1).alias("tail"))

    zipped = F.transform(F.regexp_extract_all(_text(), F.lit(near), F.lit(1)), cut)
    between = lambda z: F.regexp_replace(
        T.unnumbered(z["tail"]), r"(?s)\s*type[ \t]+this\s*=\s*struct\s*\{[^}]+\}$", ""
    )
    distance = lambda z: F.length(T.unnumbered(z["head"])) + F.length(between(z)) + 1
    objects = F.transform(
        F.filter(zipped, lambda z: distance(z) < STRUCT_REACH),
        lambda z: _row(
            "variants", "struct_object", T.first_line(z["head"]),
            F.regexp_extract(T.unnumbered(z["head"]), r"object[ \t]+([\w.]+)", 1),
            fields=T.typed_fields(
                F.regexp_extract(T.unnumbered(z["tail"]), r"(?s)struct\s*\{([^}]+)\}$", 1)
            ),
        ),
    )
    parent = lambda h: F.regexp_extract(h, r"(\w+)$", 1)
    variants = _each(
        _VARIANT,
        lambda h, line: _row(
            "variants", "variant", line, F.concat(F.lit("variant_of_"), parent(h)), {"parent": parent(h)}
        ),
    )
    enums = _each(
        rf"{T.BOL}type[ \t]+this{T.WS}={T.WS}\{{[^}}]+\}}",
        lambda h, line: _row(
            "variants", "enum", line, "type_enum",
            states=T.trimmed_list(F.regexp_extract(h, r"(?s)\{([^}]+)\}", 1)),
        ),
    )
    return F.concat(objects.cast(_ROW), variants.cast(_ROW), enums.cast(_ROW))


def monitor_marks() -> Column:
    """Finalize marker, exported actions and weights (the monitors themselves come from blocks)."""
    final = _once(
        _text().rlike(r"\b_finalize\b"), _row("monitors", "finalize", F.lit(0), "_finalize")
    )
    action = lambda h: F.regexp_extract(h, r"([\w.]+)$", 1)
    exports = _each(
        rf"{T.BOL}export[ \t]+action[ \t]+[\w.]+",
        lambda h, line: _row(
            "monitors", "export", line, F.concat(F.lit("export."), action(h)), {"action": action(h)}
        ),
    )
    weight = r'^attribute\s+([\w.]+)\.weight\s*=\s*"([0-9]+)"'
    weights = _each(
        rf'{T.BOL}attribute[ \t]+[\w.]+\.weight{T.WS}={T.WS}"[0-9]+"',
        lambda h, line: _row(
            "monitors", "weight", line, F.concat(F.lit("weight."), F.regexp_extract(h, weight, 1)),
            {"target": F.regexp_extract(h, weight, 1), "value": F.regexp_extract(h, weight, 2)},
        ),
    )
    return F.concat(final.cast(_ROW), exports.cast(_ROW), weights.cast(_ROW))


def shim_rows() -> Column:
    handler = r"\.(recv|connected|accept)"
    action = lambda h: F.regexp_extract(h, r"^implement\s+([\w.]+)", 1)
    handled = F.filter(
        T.hits(_text(), _IMPLEMENT),
        lambda h: F.regexp_extract(T.unnumbered(h), r"implement\s+([\w.]+)", 1).rlike(handler),
    )

    def handler_row(raw: Column) -> Column:
        h = F.trim(T.unnumbered(raw))
        name = action(h)
        subtype = (
            F.when(F.contains(name, F.lit(".recv")), "recv_handler")
            .when(F.contains(name, F.lit(".connected")), "connected_handler")
            .otherwise("accept_handler")
        )
        return _row("shim", subtype, T.first_line(raw), name, {"action": name})

    names = lambda word: F.regexp_extract_all(
        _text(), F.lit(rf"{T.BOL}{word}[ \t]+([\w.]+)"), F.lit(1)
    )
    state = F.filter(names("relation"), lambda r: r.isin(CONNECTION_RELATIONS))
    sockets = F.filter(names("function"), lambda f: F.contains(F.lower(f), F.lit("sock")))
    tracking = _once(
        (F.size(state) > 0) | (F.size(sockets) > 0),
        _row(
            "shim", "state_tracking", F.lit(0), "connection_state", args=state, states=sockets
        ),
    )
    calls = F.array_sort(
        F.array_distinct(F.regexp_extract_all(F.col("_impl"), F.lit(SOCKET_CALL), F.lit(1)))
    )
    ops = _once(
        F.size(calls) > 0, _row("shim", "socket_operations", F.col("_impl_line"), "socket_ops", args=calls)
    )
    protocol = F.coalesce(
        *[F.when(F.contains(F.col("content"), F.lit(k)), F.lit(v)) for k, v in TRANSPORTS.items()]
    )
    transport = _once(
        protocol.isNotNull(),
        _row("shim", "transport", F.lit(0), F.concat(F.lit("transport_"), protocol), {"protocol": protocol}),
    )
    return F.concat(
        F.transform(handled, handler_row).cast(_ROW), tracking.cast(_ROW), ops.cast(_ROW), transport.cast(_ROW)
    )


def module_rows() -> Column:
    args = lambda h: T.trimmed_list(F.regexp_extract(h, r"(?s)\(([^)]*)\)", 1))
    definitions = _each(
        _MODULE,
        lambda h, line: _row(
            "module", "definition", line, F.regexp_extract(h, r"^module\s+([\w.]+)", 1), args=args(h)
        ),
    )
    instances = _each(
        _INSTANCE,
        lambda h, line: _row(
            "module", "instance", line, F.regexp_extract(h, r"^instance\s+([\w.]+)", 1),
            {"module": F.regexp_extract(h, r"^instance\s+[\w.]+\s*:\s*([\w.]+)", 1)}, args=args(h),
        ),
    )
    return F.concat(definitions.cast(_ROW), instances.cast(_ROW))


def include_rows() -> Column:
    names = F.regexp_extract_all(_text(), F.lit(rf"{T.BOL}include[ \t]+(\w+)"), F.lit(1))
    return _once(
        F.size(names) > 0,
        _row(
            "include_chain", "include_chain", F.lit(0), "includes",
            {"count": F.size(names).cast("string")}, args=names,
        ),
    ).cast(_ROW)


def _entities(files: DataFrame) -> DataFrame:
    """Objects with a later variant of their own name; modules declared after the object are its roles.

    The last variant of a name and the number of modules so far are carried along the tokens of a file, so the work
    grows with the tokens; only the lists of roles may be longer.
    """
    text = files.filter(F.contains("content", F.lit("variant"))).select("path", T.numbered(F.col("content")).alias("_n"))
    behaviour = _text().rlike(rf"{T.BOL}action[ \t]+[\w.]*behavior").alias("behaviour")
    toks = T.exploded(text, ["path", behaviour], T.hits(_text(), rf"(?:{_OBJECT})|(?:{_MODULE})|(?:{_VARIANT})"), "h", "i")
    bare = T.unnumbered(F.col("h"))
    word = F.regexp_extract(bare, r"^[ \t]*(\w+)", 1)
    name = F.regexp_extract(bare, r"^[ \t]*(?:object|module)[ \t]+([\w.]+)", 1)
    toks = toks.select(
        "path", "behaviour", "i", T.first_line(F.col("h")).alias("line"), word.alias("word"),
        F.when(word == "variant", F.regexp_extract(bare, r"of[ \t]+(\w+)$", 1)).otherwise(name).alias("name"),
    )
    upto = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = toks.withColumn("before", F.count_if(F.col("word") == "module").over(upto)).withColumn(
        "last", F.max(F.when(F.col("word") == "variant", F.col("i"))).over(Window.partitionBy("path", "name"))
    )
    owners = placed.filter("word = 'object' AND last > i")
    # a file's modules lie in its one text row, which bounds the list
    modules = toks.filter("word = 'module'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("modules"))
    roles = F.coalesce(F.slice(F.col("modules.name"), F.col("before").cast("int") + 1, F.size("modules")), F.array().cast("array<string>"))
    owners = owners.join(modules, "path", "left").withColumn("roles", roles)
    details = {"role_type": F.when(F.size("roles") <= 1, "symmetric").otherwise("asymmetric"), "has_behavior": F.col("behaviour").cast("string")}
    row = _row("entity", "entity", F.col("line"), F.col("name"), details, args=F.col("roles"))
    return owners.select("path", row.alias("r")).select("r.kind", "r.subtype", "path", "r.line", "r.name", "r.details", "r.fields", "r.args", "r.states")


_IN_ROW = {
    "serdes": serdes_rows,
    "variants": variants_rows,
    "monitors": monitor_marks,
    "shim": shim_rows,
    "module": module_rows,
    "include_chain": include_rows,
}


def _prepare(files: DataFrame) -> DataFrame:
    return (
        files.select("path", "content")
        .withColumn("_n", T.numbered(F.col("content")))
        .withColumn("_impl", _native_text(_IMPL))
        .withColumn("_member", _native_text(_MEMBER))
        .withColumn("_impl_line", F.when(F.col("_impl") != "", _first_impl_line()).otherwise(0))
    )


def _monitor_blocks(files: DataFrame) -> DataFrame:
    b = extract_blocks(files).filter("mixin_kind <> 'direct'")
    return b.select(
        F.lit("monitors").alias("kind"),
        F.lit("monitor").alias("subtype"),
        "path",
        F.col("start_line").alias("line"),
        F.concat_ws(".", "mixin_kind", "monitor_action").alias("name"),
        F.create_map(
            F.lit("mixin_kind"), F.col("mixin_kind"),
            F.lit("action"), F.col("monitor_action"),
            F.lit("has_generating_guard"), F.col("has_generating_guard").cast("string"),
        ).alias("details"),
        F.array().cast(_FIELD).alias("fields"),
        F.array().cast("array<string>").alias("args"),
        F.array().cast("array<string>").alias("states"),
    )


def detect_patterns(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Pattern instances of the chosen kinds (all seven by default), one row each."""
    kinds = kinds or KINDS
    arrays = [_IN_ROW[k]() for k in kinds if k in _IN_ROW]
    parts = []
    if arrays:
        parts.append(
            T.exploded(_prepare(files), ["path"], F.concat(*arrays), "r").select(
                "r.kind", "r.subtype", "path", "r.line", "r.name", "r.details", "r.fields", "r.args", "r.states"
            )
        )
    if "entity" in kinds:
        parts.append(_entities(files))
    if "monitors" in kinds:
        parts.append(_monitor_blocks(files))
    return reduce(DataFrame.unionByName, parts)


def detect_serdes(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["serdes"])


def detect_variants(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["variants"])


def detect_monitors(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["monitors"])


def detect_shims(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["shim"])


def detect_modules(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["module"])


def detect_entities(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["entity"])


def detect_include_chain(files: DataFrame) -> DataFrame:
    return detect_patterns(files, ["include_chain"])


def extract_native_blocks(files: DataFrame) -> DataFrame:
    """Quoted native code per file: block counts, enum states, socket calls, field call counts."""
    impl = F.col("_impl")
    base = (
        files.select("path", "content")
        .withColumn("_n", F.col("content"))
        .withColumn("_blocks", F.size(_native(_IMPL)))
        .withColumn("_members", F.size(_native(_MEMBER)))
        .withColumn("_impl", _native_text(_IMPL))
        .withColumn("_member", _native_text(_MEMBER))
    )
    return base.filter("_blocks + _members > 0").select(
        "path",
        F.col("_blocks").alias("impl_blocks"),
        F.col("_members").alias("member_blocks"),
        T.trimmed_list(F.regexp_extract(impl, r"enum\s*\{([^}]+)\}\s*\w+\s*;", 1)).alias("states"),
        F.regexp_extract_all(
            F.concat_ws(" ", impl, "_member"), F.lit(r"class\s+`?(\w+)`?\s*:\s*public\s+\w+"), F.lit(1)
        ).alias("classes"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(impl, F.lit(SOCKET_CALL), F.lit(1)))).alias("socket_ops"),
        F.size(F.regexp_extract_all(impl, F.lit(r"\bsetn\s*\([^)]+\)"), F.lit(0))).alias("setn_calls"),
        F.size(F.regexp_extract_all(impl, F.lit(r"\bgetn\s*\([^)]+\)"), F.lit(0))).alias("getn_calls"),
    )


def extract_variant_structs(files: DataFrame, parent: str | None = None) -> DataFrame:
    """Members of variant types: the object declared last before each ``variant this of P = struct``.

    A member whose object is the parent itself, or that has no object above it, is left out.
    """
    obj = rf"object[ \t]+\w+{T.WS}={T.WS}\{{"
    var = rf"variant[ \t]+this[ \t]+of[ \t]+\w+{T.WS}={T.WS}struct{T.WS}\{{[^}}]+\}}"
    found = T.hits(T.numbered(F.col("content")), f"{T.LINE}(?=[^\\n]*variant)|{obj}|{var}")
    toks = T.exploded(files, ["path"], found, "tok", "pos")
    t = F.col("tok")
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    toks = (
        toks.withColumn("mark", T.last_line(t))
        .withColumn("object", T.or_null(F.regexp_extract(t, r"^object[ \t]+(\w+)", 1)))
        .withColumn("line", F.last("mark", True).over(w))
        .withColumn("member", F.last("object", True).over(w))
    )
    rows = toks.filter(F.startswith(t, F.lit("variant"))).select(
        "path",
        "line",
        F.regexp_extract(t, r"of[ \t]+(\w+)", 1).alias("parent"),
        F.col("member").alias("name"),
        T.typed_fields(F.regexp_extract(T.unnumbered(t), r"(?s)struct\s*\{([^}]+)\}$", 1)).alias("fields"),
    ).filter("name IS NOT NULL AND name <> parent")
    return rows if parent is None else rows.filter(F.col("parent") == parent)


def extract_tag_map(files: DataFrame) -> DataFrame:
    """``(path, tag, wire_type)`` pairs in native blocks; a tag seen again keeps its last code."""
    pattern = r"(?s)tag\s*==\s*([0-9]+)\s*\).*?frame_type\s*=\s*(0x[0-9a-fA-F]+)"
    impl = F.col("_impl")
    pairs = F.arrays_zip(
        F.regexp_extract_all(impl, F.lit(pattern), F.lit(1)).alias("tag"),
        F.regexp_extract_all(impl, F.lit(pattern), F.lit(2)).alias("wire_type"),
    )
    base = files.select("path", F.col("content").alias("_n")).withColumn("_impl", _native_text(_IMPL))
    rows = T.exploded(base, ["path"], pairs, "p", "pos")
    return rows.groupBy("path", F.col("p.tag").cast("int").alias("tag")).agg(
        F.max_by("p.wire_type", "pos").alias("wire_type")
    )


# ---- queries over the pattern table ---------------------------------------------------------------


def pattern_summary(patterns: DataFrame) -> DataFrame:
    """Instances per kind, all seven kinds, zeros kept."""
    kinds = patterns.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = patterns.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def compare_corpora(patterns: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per kind in two corpora, their difference and presence."""
    kinds = patterns.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = patterns.groupBy("kind").agg(
        F.count_if(F.col("corpus") == a).alias("count_a"), F.count_if(F.col("corpus") == b).alias("count_b")
    )
    zero = F.lit(0).cast("long")
    return (
        kinds.join(counts, "kind", "left")
        .withColumns({"count_a": F.coalesce("count_a", zero), "count_b": F.coalesce("count_b", zero)})
        .withColumn("delta", F.col("count_a") - F.col("count_b"))
        .withColumn("present_in_a", F.col("count_a") > 0)
        .withColumn("present_in_b", F.col("count_b") > 0)
    )


def pattern_crossref(patterns: DataFrame) -> DataFrame:
    """Findings of four checks: unknown (de)serializer, exported action without monitor, roles without a
    receiving handler, module that is never instantiated.

    Every pattern says which names it offers and which it needs; one aggregate per name finds the needs
    that nothing offers. Patterns of other kinds than ``CROSSREF_KINDS`` say nothing here.
    """
    d, name, sub = F.col("details"), F.col("name"), F.col("subtype")

    def entry(when: Column, space: str, value: Column, offers: bool) -> Column:
        return F.when(
            when & value.isNotNull(),
            F.struct(F.lit(space).alias("space"), value.alias("related"), F.lit(offers).alias("offers")),
        )

    serdes = (F.col("kind") == "serdes") & (sub == "instance")
    module = F.col("kind") == "module"
    watched = (sub == "monitor") & d["mixin_kind"].isin("before", "after", "around")
    nothing = F.lit("")
    entries = F.filter(
        F.array(
            entry(sub == "serializer", "serializer", name, True),
            entry(serdes & (d["ser_name"] != ""), "serializer", d["ser_name"], False),
            entry(sub == "deserializer", "deserializer", name, True),
            entry(serdes & (d["deser_name"] != ""), "deserializer", d["deser_name"], False),
            entry(watched, "monitor", d["action"], True),
            entry((sub == "export") & (d["action"] != "_finalize"), "monitor", d["action"], False),
            entry(module & (sub == "instance"), "module", d["module"], True),
            entry(module & (sub == "definition"), "module", name, False),
            entry(sub == "recv_handler", "shim", nothing, True),
            entry((F.col("kind") == "entity") & (F.size("args") > 0), "shim", nothing, False),
        ),
        lambda e: e.isNotNull(),
    )
    open_names = (
        T.exploded(patterns, [], entries, "e")
        .groupBy("e.space", "e.related")
        .agg(F.max("e.offers").alias("offered"))
        .filter("NOT offered")
        .select("space", "related")
    )
    uses = patterns.filter(serdes).select(
        "path", "line",
        F.explode(
            F.array(
                F.struct(F.lit("serializer").alias("space"), d["ser_name"].alias("related")),
                F.struct(F.lit("deserializer").alias("space"), d["deser_name"].alias("related")),
            )
        ).alias("u"),
    ).select("path", "line", "u.space", "u.related")
    placed = uses.join(open_names, ["space", "related"]).select(
        F.lit("info").alias("severity"), F.lit("serdes").alias("kind"),
        F.concat(F.lit("unknown_"), F.col("space")).alias("finding"), "path", "line", "related",
    )
    # fixed values: severity, kind and finding of the checks that concern a name, not a place
    whole = {
        "monitor": ("warning", "monitors", "export_without_monitor"),
        "module": ("info", "module", "module_without_instance"),
        "shim": ("warning", "shim", "roles_without_recv"),
    }
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in whole.items() for x in (k, v[i])])[F.col("space")]
    return placed.unionByName(
        open_names.filter(F.col("space").isin(list(whole))).select(
            pick(0).alias("severity"), pick(1).alias("kind"), pick(2).alias("finding"),
            F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"),
            F.when(F.col("related") != "", F.col("related")).alias("related"),
        )
    )


def categorize_file(patterns: DataFrame) -> DataFrame:
    """Category per file: shim, else entity, else behavior, else test (by name), else other."""
    has = lambda kind: F.max(F.col("kind") == kind)
    flags = patterns.groupBy("path").agg(
        has("shim").alias("shim"), has("entity").alias("entity"), has("monitors").alias("behavior")
    )
    return flags.select(
        "path",
        F.when(F.col("shim"), "shim")
        .when(F.col("entity"), "entity")
        .when(F.col("behavior"), "behavior")
        .when(F.contains("path", F.lit("test")), "test")
        .otherwise("other")
        .alias("category"),
    )


def _class_index(patterns: DataFrame, prefix: str) -> DataFrame:
    """Serializer and deserializer classes by name, the first by path."""
    classes = patterns.filter("kind = 'serdes' AND subtype <> 'instance'")
    return classes.groupBy(F.col("name").alias(f"{prefix}_name")).agg(
        F.min_by(
            F.struct("path", F.size("states").alias("states"), F.col("details")["base_class"].alias("base")),
            F.struct("path", "line"),
        ).alias(prefix)
    )


def serdes_correlation(patterns: DataFrame, types: DataFrame) -> DataFrame:
    """Serdes instances of message types with their serializer and deserializer classes, if found."""
    d = F.col("details")
    wanted = types.select(F.col(types.columns[0]).alias("message_type")).distinct()
    inst = (
        patterns.filter("kind = 'serdes' AND subtype = 'instance'")
        .select(
            d["message_type"].alias("message_type"), F.col("name").alias("instance"),
            F.col("path").alias("instance_path"), F.col("line").alias("instance_line"),
            d["ser_name"].alias("ser_name"), d["deser_name"].alias("deser_name"),
        )
        .join(wanted, "message_type", "left_semi")
    )
    return (
        inst.join(_class_index(patterns, "ser"), "ser_name", "left")
        .join(_class_index(patterns, "deser"), "deser_name", "left")
        .select(
            "message_type", "instance", "instance_path", "instance_line", "ser_name",
            F.col("ser.path").alias("ser_path"), F.col("ser.states").alias("ser_states"), "deser_name",
            F.col("deser.path").alias("deser_path"), F.col("deser.states").alias("deser_states"),
        )
    )


def containing_structs(patterns: DataFrame, types: DataFrame) -> DataFrame:
    """``(type, struct)``: structs with a field typed ``type.…``."""
    wanted = types.select(F.col(types.columns[0]).alias("type")).distinct()
    fields = (
        patterns.filter("subtype = 'struct_object'")
        .select(F.col("name").alias("struct"), F.explode("fields").alias("f"))
        .filter(F.contains("f.type", F.lit(".")))
        .select("struct", F.explode(F.expr("transform(sequence(1, size(split(f.type, '[.]')) - 1), n -> substring_index(f.type, '.', n))")).alias("type"))
        .distinct()
    )
    return fields.join(wanted, "type", "left_semi").select("type", "struct")


def find_variants(patterns: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """Shape of types: one row per struct field (``is_array``) or per variant member (ordinal tag, code).

    A name that is a struct is described as one; otherwise its variant members are numbered in the order
    of the first file that declares some, and the wire codes come from the serializer of a struct that
    holds the type.
    """
    wanted = types.select(F.col(types.columns[0]).alias("type_name")).distinct()
    structs = (
        patterns.filter("subtype = 'struct_object'")
        .join(wanted.withColumnRenamed("type_name", "name"), "name", "left_semi")
        .groupBy("name")
        .agg(F.min_by(F.struct("path", "line", "fields"), F.struct("path", "line")).alias("s"))
    )
    arrays = patterns.filter("kind = 'module' AND subtype = 'instance' AND details['module'] = 'array'").select(
        "path", F.col("name").alias("member")
    ).distinct().withColumn("declared_array", F.lit(True))
    fields = (
        structs.select("name", "s.path", "s.line", F.posexplode("s.fields").alias("tag", "f"))
        .select("name", "path", "line", "tag", F.col("f.name").alias("member"), F.col("f.type").alias("member_type"))
        .join(arrays, ["path", "member"], "left")
        .select(
            F.col("name").alias("type_name"), F.lit("struct").alias("kind"), "path", "line", "tag", "member",
            "member_type",
            (F.endswith("member_type", F.lit(".arr")) | F.coalesce("declared_array", F.lit(False))).alias("is_array"),
            F.lit("").alias("wire_type"),
        )
    )
    members = extract_variant_structs(files).join(
        wanted.withColumnRenamed("type_name", "parent"), "parent", "left_semi"
    ).join(structs.select(F.col("name").alias("parent")), "parent", "left_anti")
    members = cut_lineage(members.select("parent", "path", "line", "name"))  # read twice; the texts once
    first = members.groupBy("parent").agg(F.min("path").alias("path"))
    members = members.join(first, ["parent", "path"])
    order = Window.partitionBy("parent", "path").orderBy("line", "name")
    members = members.withColumn("tag", F.row_number().over(order) - 1)
    holders = containing_structs(patterns, wanted.withColumnRenamed("type_name", "type"))
    d = F.col("details")
    inst = patterns.filter("kind = 'serdes' AND subtype = 'instance'").groupBy(
        d["message_type"].alias("struct")
    ).agg(F.min_by(d["ser_name"], F.struct("path", "line")).alias("ser_name"))
    ser = _class_index(patterns, "ser").select("ser_name", F.col("ser.path").alias("ser_path"))
    codes = (
        holders.join(inst, "struct").groupBy("type").agg(F.min_by("ser_name", "struct").alias("ser_name"))
        .join(ser, "ser_name")
        .join(extract_tag_map(files).withColumnRenamed("path", "ser_path"), "ser_path")
        .select(F.col("type").alias("parent"), "tag", "wire_type")
    )
    variants = members.join(codes, ["parent", "tag"], "left").select(
        F.col("parent").alias("type_name"), F.lit("variant").alias("kind"), "path", "line", "tag",
        F.col("name").alias("member"), F.lit("struct").alias("member_type"), F.lit(False).alias("is_array"),
        F.coalesce("wire_type", F.lit("")).alias("wire_type"),
    )
    return fields.unionByName(variants)
