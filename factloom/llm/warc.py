"""WARC archives by an index: write it first, then read selected records by byte ranges.

``write_archives`` writes every capture as a record of its own gzip member and returns the index: file, offset, length, URL and digest
of each record. ``read_records`` takes any selection of index rows, sorts them by file and offset, joins neighbours to one read
where little lies between them, and checks every payload against its digest. ``index_archives`` indexes archives written elsewhere.

Captures with equal payloads (by SHA-256) of at least ``LEAST`` bytes are archived once: the one with the smallest id is a response,
the others are revisit records that name it and hold no payload. First captures are found by an aggregate over digests; rows meet them in a join whose small side
has only digests that occur twice. A digest with a thousandth of all repeated rows or more is joined by a broadcast, of at most ``1 / HEAVY`` rows,
and its rows don't go into the shuffle under their digest.

Every task writes archives of its own under a new name, so an attempt that is lost leaves a file that no index row names. Archives lie
on any store that Arrow opens; nothing but index rows and sums passes the driver.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.storage import open_store, stored

LEAST, HEAVY = 100, 0.001
ARCHIVE, CHUNK, READ, GAP = 1 << 30, 16 << 20, 8 << 20, 64 << 10
INDEX = (
    "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long, payload_bytes long"
)
#: Fixed values of the format.
VERSION, SCHEME = "WARC/1.1", "urn:x-capture:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def _name(page_id: int | None) -> str:
    return f"<{SCHEME}{'' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    inner = name.strip("<>").removeprefix(SCHEME)
    return int(inner) if inner.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, day, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A record without compression: a response with its payload, or a revisit of ``refers_to`` without one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"") if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", f"{day or '1970-01-01'}T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe=_URL_SAFE)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", None if refers_to is None else REVISIT),
        ("WARC-Refers-To", None if refers_to is None else _name(refers_to)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _compressed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _parts(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record fields, HTTP fields and payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError("no WARC record at this place")
    block = block[: int(fields["content-length"])]
    if "application/http" not in fields.get("content-type", ""):
        return fields, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    return fields, http, payload


def _entry(fields: dict[str, str], http: dict[str, str], payload: bytes) -> dict:
    """What a record says about itself; the payload of a response is checked against its digest, that of a revisit is with its response."""
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower()
    if kind == "revisit":
        size = int(http.get("content-length", 0))
    else:
        size, own = len(payload), hashlib.sha256(payload).hexdigest()
        if digest and own != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
        digest = own
    refers = fields.get("warc-refers-to")
    return {
        "page_id": _page_id(fields.get("warc-record-id", "")),
        "url": fields.get("warc-target-uri"),
        "digest": digest,
        "record_type": kind,
        "refers_to": None if refers is None else _page_id(refers),
        "payload_bytes": size,
    }


def first_captures(captures: DataFrame, least: int = LEAST) -> DataFrame:
    """``captures(page_id, url, day, payload)`` with ``digest``, ``size`` and ``refers_to``, the id of the capture to revisit, or null.

    A capture with a null id is never revisited and revisits nothing; captures that repeat the smallest id are responses, all of them.
    """
    rows = captures.select("page_id", "url", "day", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    repeated = (
        rows.filter((F.col("size") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    repeated = stored(repeated, "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    heavy = repeated.filter(F.col("n") >= F.lit(HEAVY * total)).select("digest", F.col("first").alias("heavy_first"))
    light = repeated.filter(F.col("n") < F.lit(HEAVY * total)).select(F.col("digest").alias("key"), F.col("first").alias("light_first"))
    rows = rows.join(F.broadcast(heavy), "digest", "left")  # at most 1 / HEAVY digests have that many rows
    # a row whose role is known keeps no payload that it won't need, and a key that spreads it
    known = F.col("heavy_first").isNotNull()
    rows = rows.withColumn("payload", F.when(known & (F.col("heavy_first") != F.col("page_id")), None).otherwise(F.col("payload")))
    rows = rows.withColumn("key", F.when(known, F.concat(F.lit("id "), F.col("page_id").cast("string"))).otherwise(F.col("digest")))
    rows = rows.join(light, "key", "left")
    first = F.coalesce("heavy_first", "light_first")
    return rows.withColumn("refers_to", F.when(first != F.col("page_id"), first)).drop("key", "heavy_first", "light_first")


def _write(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(folder)
        out, path, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    refers = r["refers_to"]
                    payload = r["payload"] if refers is None else None
                    data = _compressed(record(r["page_id"], r["url"], r["day"], payload, r["digest"], r["size"], refers))
                    if out is None or at >= most:
                        if out is not None:
                            out.close()
                        path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{inner}/{path}", compression=None)
                    out.write(data)
                    kind = "response" if refers is None else "revisit"
                    rows.append((r["page_id"], f"{folder}/{path}", at, len(data), r["url"], r["digest"], kind, refers, r["size"]))
                    at += len(data)
                if rows:
                    yield _index_batch(rows)
        finally:
            if out is not None:
                out.close()

    return run


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def write_archives(captures: DataFrame, folder: str, least: int = LEAST, most: int = ARCHIVE) -> DataFrame:
    """Write ``captures(page_id, url, day, payload)`` into archives below ``folder``; returns their index, which is stored.

    A null payload is an empty one, a null day the first day of 1970, a null URL no field. An empty table writes nothing.
    An archive is closed at the first record that ends beyond ``most`` bytes. Other columns are not read.
    """
    store, inner = open_store(folder)
    store.create_dir(inner, recursive=True)
    rows = first_captures(captures, least).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return stored(rows.mapInArrow(_write(folder, most), INDEX), "archive_index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """Reads ``(from, to, first, last)`` for records sorted by offset: neighbours are joined over gaps of up to ``gap`` bytes, to ``most`` bytes."""
    out: list[tuple[int, int, int, int]] = []
    for i, (at, length) in enumerate(zip(offsets, lengths, strict=True)):
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= most:
            start, stop, first, _ = out[-1]
            out[-1] = (start, max(stop, at + length), first, i)
        else:
            out.append((at, at + length, i, i))
    return out


def _read(payloads: bool, gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            begin = 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin]:
                    end += 1
                if files[begin] != path:
                    path = files[begin]
                    store, inner = open_store(path)
                    source = store.open_input_file(inner)
                for start, stop, first, last in ranges(offsets[begin:end], lengths[begin:end], gap, most):
                    data = source.read_at(stop - start, start)
                    rows, own = [], []
                    for i in range(begin + first, begin + last + 1):
                        member = data[offsets[i] - start : offsets[i] - start + lengths[i]]
                        if len(member) != lengths[i]:
                            raise ValueError(f"{path} ends before the record at {offsets[i]}")
                        fields, http, payload = _parts(zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member)
                        e = _entry(fields, http, payload)
                        rows.append((e["page_id"], path, offsets[i], lengths[i], e["url"], e["digest"], e["record_type"], e["refers_to"], e["payload_bytes"]))
                        own.append(payload if payloads and e["record_type"] != "revisit" else None)
                    found = _index_batch(rows)
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(own, pa.binary())], names=[*found.schema.names, "payload"])
                begin = end

    return run


def read_records(index: DataFrame, payloads: bool = True, gap: int = GAP, most: int = READ) -> DataFrame:
    """The records that rows of an index name, as the archives hold them: the columns of the index and ``payload``.

    Records are dealt to tasks by file and stretches of ``CHUNK`` bytes, and read in the order of their offsets. ``payload`` is null for a
    revisit, whose payload its response holds, and throughout if ``payloads`` is false; ``payload_bytes`` and ``digest`` are those of the full payload.
    A row named twice is read twice; rows without a place are left out. A payload that doesn't have its digest, a short file and a place
    without a record are errors. URLs come as the archives write them, with characters beyond ASCII escaped. Other columns are not read.
    """
    places = index.select("file", "offset", "length").dropna()
    total = places.agg(F.sum("length")).first()[0] or 0
    dealt = places.repartition(max(1, -(-total // CHUNK)), F.col("file"), F.expr(f"offset DIV {CHUNK}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(payloads, gap, most), INDEX + ", payload binary")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("file").to_pylist():
            store, inner = open_store(path)
            with store.open_input_stream(inner, compression=None) as stream:
                rest, at = stream.read(READ), 0
                while rest:
                    if rest[:2] != b"\x1f\x8b":
                        raise ValueError(f"{path} holds no gzip member at {at}")
                    member, parts, length = zlib.decompressobj(31), [], 0
                    while True:
                        parts.append(member.decompress(rest))
                        length += len(rest) - len(member.unused_data)
                        rest = member.unused_data
                        if member.eof:
                            break
                        rest = stream.read(READ)
                        if not rest:
                            raise ValueError(f"{path} ends inside the record at {at}")
                    e = _entry(*_parts(b"".join(parts)))
                    yield _index_batch([(e["page_id"], path, at, length, e["url"], e["digest"], e["record_type"], e["refers_to"], e["payload_bytes"])])
                    at += length
                    rest = rest or stream.read(READ)


def index_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The index of the archives that ``files(file)`` names, each of gzip members of a record; an archive is one task's stream."""
    return files.select("file").dropna().distinct().mapInArrow(_scan, INDEX)
