"""Resolving include names to files.

Every rule is an equi-join against one row per key (the first file by path), so that a file name shared by
very many files never multiplies with the includes that use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import dir_of, exploded, let, stem_of
from factloom.plans.keyed import top_per_key


def _first_path(files: DataFrame, keys: list[str], out: str) -> DataFrame:
    return files.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(
        F.min("path").alias(out)
    )


def resolve_includes(
    includes_raw: DataFrame,
    files: DataFrame,
    file_layers: DataFrame | None = None,
    layers: DataFrame | None = None,
    stdlib: DataFrame | None = None,
    active: list[str] | None = None,
) -> DataFrame:
    """Each include with the file it means, ``to_path`` null when there is none.

    Order: the same directory; the includer's own layer; the layers its layer depends on, in declared
    order (inactive ones skipped); any file, only where the tree has no layers; the standard library.
    """
    inc = includes_raw.withColumns(
        {"_dir": dir_of(F.col("from_path")), "_stem": F.col("include_name")}
    )
    f = files.select("path").distinct().withColumns({"_stem": stem_of(F.col("path")), "_dir": dir_of(F.col("path"))})
    out = inc.join(_first_path(f, ["_dir", "_stem"], "_same_dir"), ["_dir", "_stem"], "left")
    found = [F.struct(F.col("_same_dir").alias("path"), F.lit("same_dir").alias("rule"))]
    if file_layers is not None:
        fl = f.join(file_layers.select("path", F.col("layer").alias("_layer")).distinct(), "path")
        by_layer = _first_path(fl, ["_layer", "_stem"], "_in_layer")
        own = file_layers.groupBy(F.col("path").alias("from_path")).agg(F.min("layer").alias("_layer"))
        out = out.join(own, "from_path", "left").join(by_layer, ["_layer", "_stem"], "left")
        found.append(F.struct(F.col("_in_layer").alias("path"), F.lit("own_layer").alias("rule")))
        if layers is not None:
            deps = layers.select(
                F.col("layer").alias("_layer"), F.posexplode("depends_on").alias("_rank", "_dep")
            )
            if active is not None:
                deps = deps.filter(F.col("_dep").isin(active))
            via = (
                deps.join(
                    by_layer.select(
                        F.col("_layer").alias("_dep"), "_stem", F.col("_in_layer").alias("_via")
                    ),
                    "_dep",
                )
                .groupBy("_layer", "_stem")
                .agg(F.min_by("_via", "_rank").alias("_via_layer"))
            )
            out = out.join(via, ["_layer", "_stem"], "left")
            found.append(F.struct(F.col("_via_layer").alias("path"), F.lit("dependency").alias("rule")))
    else:
        out = out.join(_first_path(f, ["_stem"], "_flat"), "_stem", "left")
        found.append(F.struct(F.col("_flat").alias("path"), F.lit("flat").alias("rule")))
    if stdlib is not None:
        std = stdlib.groupBy(F.col("name").alias("_stem")).agg(F.min("path").alias("_std"))
        out = out.join(std, "_stem", "left")
        found.append(F.struct(F.col("_std").alias("path"), F.lit("stdlib").alias("rule")))
    hit = F.coalesce(*[F.when(s["path"].isNotNull(), s) for s in found])
    return out.withColumn("_hit", hit).select(
        *includes_raw.columns, F.col("_hit.path").alias("to_path"), F.col("_hit.rule").alias("rule")
    )


def _ancestors(directory: Column) -> Column:
    """``a/b`` -> ``['', 'a', 'a/b']``."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def resolve_closest(includes_raw: DataFrame, files: DataFrame) -> DataFrame:
    """Each include with the candidate that shares the longest directory path with the includer.

    The first path wins a tie. Files are indexed by every directory above them, so that the includer's
    own directories, deepest first, find the closest candidate by equality. Sides are merged, never broadcast: the
    index holds a row for each directory above a file, which Spark cannot tell from the size of the file table.
    """
    index = (
        files.select("path")
        .distinct()
        .select(
            "path", stem_of(F.col("path")).alias("include_name"),
            F.explode(_ancestors(dir_of(F.col("path")))).alias("_dir"),
        )
        .groupBy("include_name", "_dir")
        .agg(F.min("path").alias("_path"))
    )
    places = (
        includes_raw.select("include_name", dir_of(F.col("from_path")).alias("_from")).distinct()
        .withColumn("_dir", F.explode(_ancestors(F.col("_from"))))
    )
    best = (
        places.join(index.hint("merge"), ["include_name", "_dir"])
        .groupBy("include_name", "_from")
        .agg(F.max_by("_path", F.length("_dir")).alias("to_path"))
    )
    return (
        includes_raw.withColumn("_from", dir_of(F.col("from_path")))
        .join(best.hint("merge"), ["include_name", "_from"], "left")
        .select(*includes_raw.columns, "to_path")
    )


def resolve_by_index(names: DataFrame, includes: DataFrame, files: DataFrame) -> DataFrame:
    """A name -> an include target of that stem, else any indexed file, over all corpora."""
    corpus = F.col("corpus") if "corpus" in files.columns else F.lit("")
    targets = includes.select(F.col("to_path").alias("path"), F.lit("").alias("corpus"), F.lit(0).alias("rank"))
    known = files.select("path", corpus.alias("corpus"), F.lit(1).alias("rank"))
    best = (
        targets.unionByName(known)
        .filter("path IS NOT NULL")
        .groupBy(stem_of(F.col("path")).alias("name"))
        .agg(F.min(F.struct("rank", "corpus", "path")).alias("b"))
    )
    return names.join(best, "name", "left").select(*names.columns, F.col("b.path").alias("path"), F.col("b.rank").alias("rank"))


def unresolved_includes(
    includes_raw: DataFrame, files: DataFrame, stdlib: DataFrame | None = None
) -> DataFrame:
    """Includes whose name is no file stem and no standard module."""
    known = files.select(stem_of(F.col("path")).alias("include_name"))
    if stdlib is not None:
        known = known.unionByName(stdlib.select(F.col("name").alias("include_name")))
    return includes_raw.join(known.distinct(), "include_name", "left_anti").select(*includes_raw.columns)


def _edit_variants(name: Column) -> Column:
    """Array of ``<deletions><variant>``: the name after at most two steps, each deleting a character or
    replacing it by a wildcard, from left to right."""
    wild = F.lit("\u0001")

    def steps(text: Column, start: Column, deleted: Column) -> Column:
        last = F.length(text)
        at = F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
        drop = F.transform(
            at,
            lambda i: F.struct(
                F.concat(text.substr(F.lit(1), i - 1), text.substr(i + 1, last)).alias("v"),
                (deleted + 1).alias("d"), i.alias("next"),
            ),
        )
        wilds = F.transform(
            at,
            lambda i: F.struct(
                F.concat(text.substr(F.lit(1), i - 1), wild, text.substr(i + 1, last)).alias("v"),
                deleted.alias("d"), (i + 1).alias("next"),
            ),
        )
        return F.concat(drop, wilds)

    none = F.array(F.struct(name.alias("v"), F.lit(0).alias("d"), F.lit(1).alias("next")))
    one = steps(name, F.lit(1), F.lit(0))
    two = let(one, lambda all_: F.concat(all_, F.flatten(F.transform(all_, lambda o: steps(o["v"], o["next"], o["d"])))))
    # written as text, because distinct is only fast on plain values
    return F.array_distinct(
        F.transform(F.concat(none, two), lambda o: F.concat(o["d"].cast("string"), o["v"]))
    )


def _piece_key(length: Column, piece: int, text: Column) -> Column:
    return F.concat_ws("\u0001", length.cast("string"), F.lit(str(piece)), text)


def _cut(length: Column, piece: int) -> tuple[Column, Column]:
    """Offset and length of one of the three pieces of a text."""
    first = F.floor(length / 3)
    second = F.floor((length - first) / 2)
    at = (F.lit(0), first, first + second)[piece]
    return at.cast("int"), (first, second, length - first - second)[piece].cast("int")


def _stem_pieces(stem: Column) -> Column:
    """The three pieces of a stem as keys."""
    def key(piece: int) -> Column:
        at, size = _cut(F.length(stem), piece)
        return _piece_key(F.length(stem), piece, F.substr(stem, at + 1, size))

    return F.array(*[key(piece) for piece in range(3)])


def _name_pieces(name: Column) -> Column:
    """Keys of all pieces that a stem at most two edits away can have kept whole in this name."""
    def keys(more: int, piece: int) -> Column:
        length = F.length(name) + more
        at, size = _cut(length, piece)
        moved = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda shift: at + shift)
        fits = F.filter(moved, lambda start: (start >= 0) & (start + size <= F.length(name)))
        texts = F.transform(fits, lambda start: _piece_key(length, piece, F.substr(name, start + 1, size)))
        return F.when(length >= 0, texts).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[keys(more, piece) for more in range(-2, 3) for piece in range(3)]))


#: Stems of a piece up to which the names that hold it are compared with each of them.
FEW = 32


def near_miss(names: DataFrame, stems: DataFrame, few: int = FEW) -> DataFrame:
    """The likely meaning of an unresolved name: a stem with the same set of ``_`` segments, else one at
    edit distance two or less; the first by name. Null when there is none.

    Two edits leave one of a stem's three pieces whole, so an index of pieces, three rows a stem, finds the
    candidates. Pieces of at most ``few`` stems are compared directly. Stems and names that meet in a piece of
    more stems are matched by an equi-join on edit variants instead: two names are at most two edits apart
    exactly when some choice of deletions on either side and wildcards on both, two steps in all, makes them
    equal. Per variant only the first stem is kept, so common beginnings don't multiply. The result does not
    depend on ``few``.
    """
    asked = names.select(F.col(names.columns[0]).alias("name")).distinct()
    known = stems.select(F.col(stems.columns[0]).alias("stem")).distinct()
    segments = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(c, "_"))), "_")
    same = (
        top_per_key(known.withColumn("k", segments(F.col("stem"))), ["k"], [F.col("stem")], 2)
        .join(asked.withColumn("k", segments(F.col("name"))), "k")
        .filter("stem <> name")
        .groupBy("name")
        .agg(F.min("stem").alias("suggestion"))
    )
    left = asked.join(same, "name", "left_anti")
    index = exploded(known, ["stem"], _stem_pieces(F.col("stem")), "key").select("key", "stem")
    probes = exploded(left, ["name"], _name_pieces(F.col("name")), "key").select("key", "name")
    crowded = index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("key")
    direct = (
        probes.join(index.join(crowded, "key", "left_anti"), "key")
        .filter((F.col("stem") != F.col("name")) & (F.levenshtein("name", "stem", 2) >= 0))
        .groupBy("name")
        .agg(F.min("stem").alias("suggestion"))
    )
    crowded = crowded.join(probes, "key", "left_semi")
    left = left.join(probes.join(crowded, "key", "left_semi"), "name", "left_semi")
    known = known.join(index.join(crowded, "key", "left_semi"), "stem", "left_semi")
    wild_count = F.length("v") - F.length(F.translate("v", "\u0001", ""))
    digit, rest = F.substring("e", 1, 1).cast("int"), F.substring("e", 2, 1 << 20)
    stem_side = exploded(known, ["stem"], _edit_variants(F.col("stem")), "e").select(
        rest.alias("v"), digit.alias("stem_d"), "stem"
    )
    name_side = exploded(left, ["name"], _edit_variants(F.col("name")), "e").select(
        "name", rest.alias("v"), digit.alias("name_d")
    )
    firsts = top_per_key(stem_side, ["v", "stem_d"], [F.col("stem")], 2).drop("rank")
    fuzzy = name_side.join(firsts, "v").filter(
        (F.col("name_d") + F.col("stem_d") + wild_count <= 2) & (F.col("stem") != F.col("name"))
    ).select("name", F.col("stem").alias("suggestion"))
    near = direct.unionByName(fuzzy).groupBy("name").agg(F.min("suggestion").alias("suggestion"))
    return asked.join(same.unionByName(near), "name", "left")


def collisions(files: DataFrame, file_layers: DataFrame | None = None, active: list[str] | None = None) -> DataFrame:
    """Stems shared by several files, with the class and severity of the clash, errors first."""
    f = files.select("path").distinct().withColumn("stem", stem_of(F.col("path")))
    if file_layers is not None:
        f = f.join(file_layers.groupBy("path").agg(F.min("layer").alias("layer")), "path", "left")
    else:
        f = f.withColumn("layer", F.lit(None).cast("string"))
    f = f.withColumn("layer", F.coalesce("layer", F.lit("unknown")))
    in_scope = F.col("layer").isin(active) if active else F.lit(False)
    grouped = (
        f.groupBy("stem")
        .agg(
            F.count("*").alias("files"), F.count_distinct("layer").alias("layers"),
            F.max(in_scope).alias("active"), F.min("path").alias("first_path"),
        )
        .filter("files > 1")
    )
    kind = (
        F.when(F.col("layers") <= 1, "intra-layer")
        .when(F.col("active"), "cross-layer-in-scope")
        .otherwise("cross-boundary")
    )
    severity = F.when(F.col("layers") <= 1, "error").when(F.col("active"), "warning").otherwise("info")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return (
        grouped.withColumn("classification", kind)
        .withColumn("severity", severity)
        .orderBy(rank, "stem")
        .drop("active")
    )


def entry_points(files: DataFrame, includes_raw: DataFrame) -> DataFrame:
    """Files whose stem nobody includes."""
    used = includes_raw.select(F.col("include_name").alias("stem")).distinct()
    return (
        files.select("path").distinct().withColumn("stem", stem_of(F.col("path")))
        .join(used, "stem", "left_anti").select("path")
    )


def most_included(includes_raw: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` names included most often."""
    n = includes_raw.groupBy("include_name").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "include_name").limit(k)
