"""Registered queries of the operators in this package, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import decode, encode
from factloom.llm.embedding_dups import near_vectors
from factloom.llm.line_templates import drop_recurring_lines
from factloom.llm.near_dups import near_duplicates
from factloom.llm.ngram import score_held_out
from factloom.llm.packing import pack
from factloom.llm.quality import quality
from factloom.llm.spelling import group_variants, letter_runs, vocabulary
from factloom.llm.storage import shared_folder
from factloom.llm.topk import top_k
from factloom.llm.toxicity import toxicity
from factloom.llm.url_lists import verdicts
from factloom.llm.warc import read_records, write_archives
from factloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_minhash_near_dups")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "documents"))


_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


@_query(
    "op2_dated_url_lists",
    f"""
WITH page AS (
  SELECT DISTINCT page_id, url, DATE '2022-01-01' + CAST((page_id * 7919) % 1096 AS INTEGER) AS day,
    lower(regexp_extract(url, '{_URL}', 1)) AS host, regexp_extract(url, '{_URL}', 2) AS path
  FROM pages
),
entry AS (
  SELECT CASE WHEN page_id % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
    CASE page_id % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'host' WHEN 2 THEN 'segment' ELSE 'url' END AS kind,
    CASE page_id % 4 WHEN 0 THEN regexp_extract(host, '[.]([^.]+[.][^.]+[.][^.]+)$', 1) WHEN 1 THEN host
      WHEN 2 THEN host || regexp_extract(path, '^(/[^/]*)', 1) ELSE host || path END AS value,
    DATE '2021-12-01' + CAST((page_id * 104729) % 1096 AS INTEGER) AS day, (page_id // 4) % 3 <> 0 AS added
  FROM page
),
daily AS (
  SELECT list, kind, value, day, min(added) AS added FROM entry WHERE list || kind || value IS NOT NULL AND day IS NOT NULL GROUP BY ALL
),
named AS (
  SELECT page_id, url, day, 'url' AS kind, host || path AS value FROM page WHERE host <> ''
  UNION SELECT page_id, url, day, 'segment', host || regexp_extract(path, '^(/[^/]*)', 1) FROM page WHERE host <> ''
  UNION SELECT page_id, url, day, 'host', host FROM page WHERE host <> ''
  UNION SELECT page_id, url, day, 'domain', array_to_string(string_split(host, '.')[unnest(range(1, len(string_split(host, '.')) + 1)):], '.')
  FROM page WHERE host <> ''
),
latest AS (
  SELECT n.page_id, n.url, n.day, d.list, d.kind, d.value, arg_max(d.added, d.day) AS active
  FROM named n JOIN daily d ON n.kind = d.kind AND n.value = d.value AND d.day <= n.day
  GROUP BY ALL
),
held AS (
  SELECT page_id, url, day, count(*) FILTER (list = 'block') AS blocked_by, count(*) FILTER (list = 'allow') AS allowed_by
  FROM latest WHERE active GROUP BY ALL
)
SELECT p.page_id, p.url, p.day, coalesce(blocked_by, 0) AS blocked_by, coalesce(allowed_by, 0) AS allowed_by,
  CASE WHEN allowed_by > 0 THEN 'allowed' WHEN blocked_by > 0 THEN 'blocked' ELSE 'unlisted' END AS verdict
FROM page p LEFT JOIN held h ON p.page_id IS NOT DISTINCT FROM h.page_id AND p.url IS NOT DISTINCT FROM h.url
  AND p.day IS NOT DISTINCT FROM h.day
""",
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Pages have no fetch day and there are no lists, so both are derived from the pages: every page gives a capture, and an
    entry that adds or removes its URL, segment, host or domain on another day."""
    pages = _table(spark, sf, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.expr("date_add(DATE '2022-01-01', CAST((page_id * 7919) % 1096 AS INT))"))
    host, path = F.lower(F.regexp_extract("url", _URL, 1)), F.regexp_extract("url", _URL, 2)
    kind = F.when(F.expr("page_id % 4 = 0"), "domain").when(F.expr("page_id % 4 = 1"), "host")
    value = F.when(F.expr("page_id % 4 = 0"), F.regexp_extract(host, r"[.]([^.]+[.][^.]+[.][^.]+)$", 1)).when(F.expr("page_id % 4 = 1"), host)
    entries = pages.select(
        F.expr("IF(page_id % 5 = 0, 'allow', 'block')").alias("list"),
        kind.when(F.expr("page_id % 4 = 2"), "segment").otherwise("url").alias("kind"),
        value.when(F.expr("page_id % 4 = 2"), F.concat(host, F.regexp_extract(path, "^(/[^/]*)", 1)))
        .otherwise(F.concat(host, path))
        .alias("value"),
        F.expr("date_add(DATE '2021-12-01', CAST((page_id * 104729) % 1096 AS INT))").alias("day"),
        F.expr("(page_id DIV 4) % 3 <> 0").alias("added"),
    )
    return verdicts(captures, entries)


@_query("op3_length_buckets")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_table(spark, sf, "documents"))


@_query("op4_byte_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(_table(spark, sf, "documents"), path, public_tokenizers.PATTERN)
    return decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query("op5_line_templates")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return drop_recurring_lines(_table(spark, sf, "documents"))


@_query(
    "op6_threshold_top_k",
    """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
component AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM usable),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM component q JOIN component c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@_query("op7_kneser_ney")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return score_held_out(_table(spark, sf, "documents"))


@_query(
    "op8_cross_polytope_near_dups",
    """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(reach.b) AS component_id, min(reach.b) = e.vec_id AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
GROUP BY e.vec_id
""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


@_query("op9_rule_ensemble")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@_query("op10_string_kernel")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@_query("op11_spelling_variants")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """One run in 97 loses a code point, by a checksum of its document and itself; so rows hold misspellings whose words are known."""
    runs = letter_runs(_table(spark, sf, "documents"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.withColumn("h", F.crc32(name.cast("binary"))).withColumn("at", F.expr("CAST(h % length(run) AS INT)"))
    return group_variants(vocabulary(runs.select(F.expr("IF(h % 97 = 0, concat(left(run, at), substr(run, at + 2)), run)").alias("word"))))


@_query(
    "op12_warc_index",
    """
WITH page AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
earliest AS (SELECT digest, min(page_id) AS first FROM page WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, page.digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM page LEFT JOIN earliest ON page.digest = earliest.digest
""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Every page is archived, with the fetch day that ``op2`` derives, and every record is read back by the index."""
    captures = _table(spark, sf, "pages").select(
        "page_id", "url", F.expr("date_add(DATE '2022-01-01', CAST((page_id * 7919) % 1096 AS INT))").alias("day"), F.col("html").cast("binary").alias("payload")
    )
    index = write_archives(captures, shared_folder(spark, "archives"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@_query("op13_chebyshev_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(_table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
