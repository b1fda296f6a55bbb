"""URL filters over dated lists: what was listed when a page was fetched.

A list entry says that from a day on a value is added to, or removed from, a block or allow list. Entries of one (list, kind, value)
become validity intervals: an addition holds until the next removal. A capture asks for its URL without query and fragment, its first
path segment, its host, and every domain above the host; an as-of join finds the entries whose interval holds its day.

Intervals are cut at month ends, and the join is an equality of (kind, value, month) with the day inside the interval. A value
has at most one change a day, so a capture meets at most 31 pieces of an interval chain however long a list's history is; captures
of a hot host are many rows against few, which Spark can split. Neither side is collected or broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def _path(url) -> F.Column:
    return F.regexp_extract(url, URL, 2)


def asked_values(captures: DataFrame) -> DataFrame:
    """``(page_id, url, day, kind, value)``: all values by which a list may name a capture, each once."""
    host, path = _host(F.col("url")), _path(F.col("url"))
    rows = captures.select("page_id", "url", "day", host.alias("host"), path.alias("path")).filter("host <> '' AND day IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    segment = F.regexp_extract("path", "^(/[^/]*)", 1)
    own = F.array(
        F.struct(F.lit("url").alias("kind"), F.concat("host", "path").alias("value")),
        F.struct(F.lit("segment").alias("kind"), F.concat("host", segment).alias("value")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
    )
    return rows.select("page_id", "url", "day", F.explode(F.concat(own, domains)).alias("k")).select("page_id", "url", "day", "k.kind", "k.value")


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, value, start, end)`` of ``entries(list, kind, value, day, added)``: ``end`` is the day of removal, or null.

    Of several entries of a day a removal wins; an addition while a value is listed changes nothing.
    """
    key = ["list", "kind", "value"]
    daily = entries.dropna(subset=[*key, "day", "added"]).groupBy(*key, "day").agg(F.min("added").alias("added"))
    order = Window.partitionBy(*key).orderBy("day")
    changes = daily.withColumn("before", F.lag("added").over(order)).filter(
        (F.col("added") & ~F.coalesce("before", F.lit(False))) | (~F.col("added") & F.col("before"))
    )
    spans = changes.withColumn("end", F.lead("day").over(order)).filter("added")
    return spans.select(*key, F.col("day").alias("start"), "end")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(page_id, url, day, blocked_by, allowed_by, verdict)`` for every different row of ``captures(page_id, url, day)``.

    ``blocked_by`` and ``allowed_by`` count the entries that hold on the day. The verdict is ``allowed`` if an allow list names the
    capture, else ``blocked`` if a block list does, else ``unlisted``; so is a capture without a host or a day. Other columns are not read.
    """
    captures = captures.select("page_id", "url", "day")
    last = captures.agg(F.max("day")).first()[0]
    month = F.trunc("day", "month")
    asked = asked_values(captures).withColumn("month", month)
    spans = intervals(entries).filter(F.col("start") <= F.lit(last))
    until = F.least(F.coalesce(F.date_sub("end", 1), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("start", "month"), F.trunc(until, "month"), F.expr("INTERVAL 1 MONTH"))
    pieces = spans.withColumn("month", F.explode(months))
    held = (
        asked.join(pieces, ["kind", "value", "month"])
        .filter((F.col("day") >= F.col("start")) & (F.col("end").isNull() | (F.col("day") < F.col("end"))))
        .groupBy("page_id", "url", "day")
        .agg(F.count_if(F.col("list") == "block").alias("blocked_by"), F.count_if(F.col("list") == "allow").alias("allowed_by"))
    )
    a, b = captures.distinct().alias("a"), held.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in captures.columns]
    blocked, allowed = (F.coalesce(f"b.{c}", F.lit(0)) for c in ("blocked_by", "allowed_by"))
    verdict = F.when(allowed > 0, "allowed").when(blocked > 0, "blocked").otherwise("unlisted")
    return a.join(b, same, "left").select("a.*", blocked.alias("blocked_by"), allowed.alias("allowed_by"), verdict.alias("verdict"))
