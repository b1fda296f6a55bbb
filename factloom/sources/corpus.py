"""Reading corpora, manifests, logs and session events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import exploded, stem_of

# Directories a scan leaves out.
EXCLUDE_DIRS = [
    ".git",
    ".hg",
    ".svn",
    ".venv",
    "venv",
    "node_modules",
    "__pycache__",
    "build",
    "dist",
    "submodules",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
]
#: One file is one row, and a binary value holds no more bytes than this.
MAX_FILE_BYTES = 2**31 - 1 - 16


def _relative(path: Column, root: str) -> Column:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1}, 1000000)") if base else path


def _listing(
    spark: SparkSession, root: str, suffix: str, exclude_dirs: list[str], skip_unreadable: bool = False
) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .option("ignoreCorruptFiles", skip_unreadable)
        .option("ignoreMissingFiles", skip_unreadable)
        .load(root)
    )
    files = files.withColumn("rel", _relative(F.col("path"), root))
    if exclude_dirs:
        files = files.filter(~F.arrays_overlap(F.split("rel", "/"), F.lit(list(exclude_dirs))))
    return files


def scan_corpus(
    spark: SparkSession,
    root: str,
    suffix: str,
    exclude_dirs: list[str] = EXCLUDE_DIRS,
    corpus: str = "",
    max_bytes: int = MAX_FILE_BYTES,
    report_unreadable: bool = False,
) -> DataFrame:
    """``source_files`` under a root: path relative to it, text, size, time, hash and status.

    Excluded directories are pruned by their name; bytes that are no UTF-8 become replacement characters. No file
    is left out: one above ``max_bytes`` (by default what one value can hold) comes as a row of status
    ``oversized`` with null text and hash. A file that cannot be read fails the job, or, with
    ``report_unreadable``, comes as such a row of status ``unreadable``; finding those reads the files once more.
    """
    listed = _listing(spark, root, suffix, exclude_dirs)
    small = F.col("length") <= max_bytes
    read = _listing(spark, root, suffix, exclude_dirs, report_unreadable).filter(small)

    def rows(files: DataFrame, status: str, content: Column) -> DataFrame:
        return files.select(
            F.lit(corpus).alias("corpus"),
            F.col("rel").alias("path"),
            stem_of(F.col("rel")).alias("stem"),
            F.make_valid_utf8(content.cast("string")).alias("content"),
            F.col("length").alias("size"),
            F.col("modificationTime").cast("double").alias("mtime"),
            F.sha2(content, 256).alias("sha256"),
            F.lit(status).alias("status"),
        )

    nothing = F.lit(None).cast("binary")
    out = rows(read, "ok", F.col("content")).unionByName(rows(listed.filter(~small), "oversized", nothing))
    if not report_unreadable:
        return out
    held = read.filter(F.length("content") >= 0).select("path")
    return out.unionByName(rows(listed.filter(small).join(held, "path", "left_anti"), "unreadable", nothing))


def scan_filter_layers(files: DataFrame, layers: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Files under the roots of the wanted layers, each tagged with the layer of its longest root.

    When no file is left, all files come back with their layer. Roots match as directories: every
    directory above a file is looked up by equality.
    """
    roots = layers.select("layer", F.col("include_root").alias("_root"))
    if wanted:
        roots = roots.filter(F.col("layer").isin(wanted))
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    tagged = (
        files.select("path").distinct()
        .withColumn("_root", F.explode(above))
        .join(roots, "_root")
        .groupBy("path")
        .agg(F.max_by("layer", F.struct(F.length("_root"), "layer")).alias("layer"))
    )
    untagged = files.withColumn("layer", F.lit(None).cast("string")).filter(~tagged.exists())
    return files.join(tagged, "path").unionByName(untagged)


MANIFEST_SCHEMA = (
    "path string, req_id string, rfc string, section string, text string, level string, layer string, testable boolean, "
    "error string"
)


def _manifest_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    names = ["path", "req_id", "rfc", "section", "text", "level", "layer", "testable", "error"]
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                data = yaml.safe_load(content or "")
            except yaml.YAMLError as e:
                rows.append((path, *[None] * 7, str(e)))
                continue
            reqs = data.get("requirements") if isinstance(data, dict) else None
            if not isinstance(reqs, dict):
                rows.append((path, *[None] * 7, "no requirements"))
                continue
            doc = str(data.get("rfc", ""))
            for key, r in reqs.items():
                if isinstance(r, dict):
                    rows.append(
                        (
                            path, str(key), doc, str(r.get("section", "")), str(r.get("text", "")),
                            str(r.get("level", "MUST")), str(r.get("layer", "")), bool(r.get("testable", True)),
                            None,
                        )
                    )
        yield pd.DataFrame(rows, columns=names)


def parse_manifests(files: DataFrame) -> DataFrame:
    """Requirement rows of YAML manifests ``files(path, content)``; entries that are no map are skipped.

    Files that hold no manifest give no rows here; ``manifest_errors`` names them.
    """
    return files.select("path", "content").mapInPandas(_manifest_rows, MANIFEST_SCHEMA).filter("error IS NULL").drop("error")


def manifest_errors(files: DataFrame) -> DataFrame:
    """``(path, error)`` of the files that ``parse_manifests`` finds no manifest in."""
    return files.select("path", "content").mapInPandas(_manifest_rows, MANIFEST_SCHEMA).filter("error IS NOT NULL").select(
        "path", "error"
    )


def manifest_from_json(files: DataFrame) -> DataFrame:
    """As ``parse_manifests`` for JSON manifests, with native functions only."""
    schema = (
        "rfc string, requirements map<string, struct<section:string,text:string,level:string,layer:string,testable:boolean>>"
    )
    doc = files.select("path", F.from_json("content", schema).alias("d"))
    rows = doc.select("path", F.coalesce("d.rfc", F.lit("")).alias("rfc"), F.explode("d.requirements").alias("req_id", "r"))
    return rows.filter("r IS NOT NULL").select(
        "path", "req_id", "rfc",
        F.coalesce("r.section", F.lit("")).alias("section"),
        F.coalesce("r.text", F.lit("")).alias("text"),
        F.coalesce("r.level", F.lit("MUST")).alias("level"),
        F.coalesce("r.layer", F.lit("")).alias("layer"),
        F.coalesce("r.testable", F.lit(True)).alias("testable"),
    )


def scan_manifest(spark: SparkSession, root: str, corpus: str | None = None, suffix: str = "_requirements.yaml") -> DataFrame:
    """Manifests under a root; with ``corpus`` only those below a directory of that name."""
    files = scan_corpus(spark, root, suffix)
    if corpus:
        files = files.filter(F.array_contains(F.split("path", "/"), corpus))
    return parse_manifests(files)


def scan_check_log(spark: SparkSession, path: str) -> DataFrame:
    """``(log_id, line_no, text)`` of tool logs, line order kept."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("value")
    )
    return exploded(text, ["log_id"], F.split("value", r"\r?\n", -1), "text", "line_no")


SESSION_SCHEMA = (
    "timestamp timestamp, session_id string, channel string, event_type string, name string, status string, "
    "duration_ms double, call_id string, payload string"
)


def scan_session_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines session events, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SESSION_SCHEMA).json(path)


def infer_corpus(path: Column, marker: str, known: list[str]) -> Column:
    """Corpus of a path: the part after the marker directory, else a known first part, else null."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, marker)
    first = F.get(parts, 0)
    return F.when(at > 0, F.get(parts, at.cast("int"))).when(first.isin(known), first)
