import datetime
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyarrow import fs

from factloom.llm import queries, storage, warc

SCHEMA = "page_id long, url string, day date, payload binary, digest string, file string, size int"
DAY = datetime.date(2023, 5, 6)


def captures(spark, rows):
    return spark.createDataFrame([(i, u, DAY, p, "d", "f", 1) for i, u, p in rows], SCHEMA)


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://host{i % 7}.org/{i}", rng.randbytes(rng.randrange(0, 400))) for i in range(200)]
    common, other = b"<p>" + b"x" * 500, b"y" * 100
    rows += [(300 + i, "http://copies.org/", common) for i in range(120)] + [(40, "http://copies.org/first", common)]
    rows += [(500 + i, None, other) for i in range(5)] + [(510 + i, "http://short.org", b"y" * 99) for i in range(3)]
    rows += [(600, "http://none.org/ä b\r\nX: y", None), (601, "", b""), (None, "http://noid.org", common), (None, "http://noid.org", b"k")]
    rows += [(40, "http://copies.org/first", common), (300, "http://copies.org/", common), (700, "http://long.org", b"\r\n\r\n" + bytes(range(256)) * 20000)]
    return rows


def want(rows, least=100):
    first = defaultdict(list)
    for i, _, p in rows:
        if i is not None and len(p or b"") >= least:
            first[p].append(i)
    out = []
    for i, _, p in rows:
        p = p or b""
        lead = min(first[p]) if i is not None and first.get(p) else None
        refers = lead if lead != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def of(df):
    return sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("heavy", [0.001, 2.0])
def test_round_trip(spark, monkeypatch, heavy):
    """Whether copies meet their first capture in the broadcast or in the shuffled join."""
    monkeypatch.setattr(warc, "HEAVY", heavy)
    rows = pages()
    index = warc.write_archives(captures(spark, rows), storage.shared_folder(spark, "warc"))
    assert of(index) == want(rows)
    got = warc.read_records(index)
    assert of(got) == want(rows)
    held = {(r.page_id, bytes(r.payload)) for r in got.collect() if r.record_type == "response"}
    assert held == {(i, p or b"") for i, _, p in rows if (i, len(p or b""), hashlib.sha256(p or b"").hexdigest(), "response", None) in want(rows)}
    assert got.filter("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    some = index.filter("page_id % 10 = 3")
    assert of(warc.read_records(some, payloads=False, gap=0)) == [r for r in want(rows) if r[0] is not None and r[0] % 10 == 3]


def test_archives_are_plain_warc_and_index_again(spark):
    rows = pages()
    folder = storage.shared_folder(spark, "warc")
    index = warc.write_archives(captures(spark, rows).coalesce(1), folder, most=20000)
    files = [r.file for r in index.select("file").distinct().collect()]
    assert len(files) > 3
    text = b"".join(gzip.decompress(open(f.removeprefix("file:"), "rb").read()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    assert b"WARC-Target-URI: http://none.org/%C3%A4%20b%0D%0AX:%20y\r\n" in text
    assert b"WARC-Date: 2023-05-06T00:00:00Z\r\n" in text and b"WARC-Refers-To: <urn:x-capture:40>\r\n" in text
    again = warc.index_archives(spark, index.select("file"))
    place = ["file", "offset", "length", "page_id", "digest", "record_type", "refers_to", "payload_bytes"]
    assert sorted(map(repr, again.select(place).collect())) == sorted(map(repr, index.select(place).collect()))


def test_ranges():
    assert warc.ranges([0, 10, 30, 200], [10, 10, 5, 1], gap=10, most=100) == [(0, 35, 0, 2), (200, 201, 3, 3)]
    assert warc.ranges([0, 10, 20], [10, 10, 10], gap=0, most=20) == [(0, 20, 0, 1), (20, 30, 2, 2)]
    assert warc.ranges([5, 5], [9000, 9000], gap=0, most=20) == [(5, 9005, 0, 0), (5, 9005, 1, 1)]
    assert warc.ranges([], []) == []


def test_damage_and_missing_places_are_errors(spark):
    index = warc.write_archives(captures(spark, [(1, "http://a.org", b"a" * 300)]), storage.shared_folder(spark, "warc"))
    row = index.first()
    path = row.file.removeprefix("file:")
    fake = warc._compressed(warc.record(1, "http://a.org", None, b"b" * 300, hashlib.sha256(b"a" * 300).hexdigest(), 300, None))
    with open(path, "wb") as out:
        out.write(fake)
    one = spark.createDataFrame([(row.file, 0, len(fake))], "file string, offset long, length long")
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_records(one).collect()
    with pytest.raises(Exception, match="ends before"):
        warc.read_records(spark.createDataFrame([(row.file, 0, len(fake) + 5)], "file string, offset long, length long")).collect()
    assert warc.read_records(spark.createDataFrame([(None, 0, 5)], "file string, offset long, length long")).collect() == []


def test_empty_table_and_query(spark, tmp_path):
    index = warc.write_archives(captures(spark, []), storage.shared_folder(spark, "warc"))
    assert index.collect() == [] and warc.read_records(index).collect() == []
    rows = [(i, u, None if p is None else p.hex()) for i, u, p in pages()]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op12_warc_index"](spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert of(got.withColumnRenamed("payload_digest", "digest")) == want([(i, u, (p or "").encode()) for i, u, p in rows])


def test_store_names():
    assert storage.open_store("file:///a/b") == (fs.LocalFileSystem(), "/a/b")
    assert storage.open_store("/a/b")[1] == "/a/b"
    assert storage.open_store("s3a://bucket/x?region=eu-west-1")[1] == "bucket/x"
