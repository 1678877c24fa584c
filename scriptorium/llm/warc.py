"""WARC archives: write captures as records, read archives back, put segmented records together.

Writing: each capture is a response record with a chunked HTTP message, or, where its payload equals that of a capture with a
smaller key, a revisit record that names it. Blocks above a size are cut into a first segment and continuation records, which
may end up in any archive. Spark's text writer lays the records out, with the records' own terminator between them, so an
archive can be written to whatever file system Spark can.

Reading: archives are parsed record by record; continuation records are grouped by the identifier of their origin, put in
order of their segment numbers, held against the stated total length, and the chunked transfer framing is decoded.
A reader task holds one archive at a time, so write them small (``records_per_file``).

Defined results: a null or empty payload is an empty message; captures with a null key are not archived; rows equal in key and
payload are one capture, rows of one key and several payloads are several; a null address is left out of the record. A record whose segments are missing, differ under one
number, or don't add up to the total length keeps its row with a ``status`` other than ``complete`` and a null payload; so does
one with a broken chunk frame. Archives that break off inside a record raise ``ValueError``.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import runtime

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. Broken framing raises ``ValueError``."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("the message has no end of its header")
    fields = [x.partition(b":") for x in head.split(b"\r\n")[1:]]
    coding = b",".join(v for k, _, v in fields if k.strip().lower() == b"transfer-encoding")
    return unchunked(body) if b"chunked" in coding.lower() else body


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()


def response_records(identity: str, url: str | None, date: str, payload: bytes, digest: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The record of a response, or its segments, without the terminator."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        fields: list[tuple[str, object]] = [("WARC-Type", "response" if n == 1 else "continuation")]
        fields += [("WARC-Record-ID", f"<{identity}>" if n == 1 else f"<{identity}:{n}>"), ("WARC-Date", date), ("WARC-Target-URI", url or None)]
        fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")] * (n == 1)
        fields += [("WARC-Segment-Number", n)] * (len(parts) > 1) + [("WARC-Segment-Origin-ID", f"<{identity}>")] * (n > 1)
        fields += [("WARC-Segment-Total-Length", len(block))] * (n > 1 and n == len(parts))
        yield header([*fields, ("Content-Length", len(part))]) + part


def revisit_record(identity: str, url: str | None, date: str, refers_to: str, digest: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{identity}>"), ("WARC-Date", date), ("WARC-Target-URI", url or None), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return header(fields) + block


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, plain or of gzip members."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, view = 0, memoryview(content)
    while True:
        while content[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(content):
            return
        end = content.find(END, at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in " \t" and last:  # a folded line
                fields[last] += " " + line.strip()
                continue
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
        at = end + 4 + int(fields.get("content-length", -1))
        if at < end + 4 or at > len(content):
            raise ValueError(f"the record before byte {at} breaks off or lacks its length")
        yield fields, bytes(view[end + 4 : at])


def revisits(captures: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """``key, digest, refers_to`` of the captures whose payload a capture of smaller key has too."""
    seen = captures.where(F.col(key).isNotNull() & (F.length(payload) >= least_bytes)).select(key, F.sha2(payload, 256).alias("digest"))
    first = seen.groupBy("digest").agg(F.min(key).alias("refers_to"), F.max(key).alias("last")).where("refers_to < last").drop("last")
    return seen.join(first, "digest").where(F.col(key) > F.col("refers_to")).distinct()


def write(captures: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "payload", date: str = "2000-01-01T00:00:00Z", least_bytes: int = 100, segment_bytes: int = 32768, chunk_bytes: int = 8192, records_per_file: int = 2000, compression: str = "none") -> None:
    """Writes captures (``payload`` binary) as archives under ``path``; see the module for what becomes a revisit."""
    rows = captures.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(payload, F.lit(b"")).alias("p"))
    again = runtime.stored(revisits(rows, "k", "p", least_bytes), "revisits")
    # the revisits are a stored table, so Spark knows its size and broadcasts it only if it is small
    joined = rows.where("k is not null").withColumn("digest", F.sha2("p", 256)).join(again, ["k", "digest"], "left")
    joined = joined.select("k", "u", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("p")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for k, u, digest, refers, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if refers is None:
                    out += response_records(f"urn:page:{k}:{digest}", u, date, p, digest, segment_bytes, chunk_bytes)
                else:
                    out.append(revisit_record(f"urn:page:{k}:{digest}", u, date, f"urn:page:{refers}:{digest}", digest))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "record_id string, type string, uri string, payload_digest string, refers_to string, segment int, origin string, total long, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, segments as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [*[pa.string()] * 5, pa.int32(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    number = lambda name, f=f: int(f[name]) if name in f else None
                    bare = lambda name, f=f: f[name].strip("<>") if name in f else None
                    rows.append((bare("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest"), bare("warc-refers-to"), number("warc-segment-number"), bare("warc-segment-origin-id"), number("warc-segment-total-length"), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per record: its ``parts`` (blocks in order), and ``status``: complete, or what is wrong with its segments."""
    fields = ["record_id", "type", "uri", "payload_digest", "refers_to"]
    whole = records.where("segment is null").select(*fields, F.array("block").alias("parts"), F.lit("complete").alias("status"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    segments = records.where("segment is not null").withColumn("record_id", F.coalesce("origin", "record_id"))
    grouped = segments.groupBy("record_id").agg(*map(first, fields[1:]), F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"))
    numbers, lengths = F.transform("s", lambda x: x["segment"]), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    status = (
        F.when(F.size(F.array_distinct(numbers)) < F.size("s"), "segments differ")
        .when(F.col("total").isNull() | (numbers != F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)))), "segments missing")
        .when(lengths != F.col("total"), "length differs")
        .otherwise("complete")
    )
    return whole.unionByName(grouped.select(*fields, F.transform("s", lambda x: x["block"]).alias("parts"), status.alias("status")))


def payloads(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reassembled records with ``payload`` (decoded; null for revisits and incomplete records), its bytes and SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, parts, states = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("type", "parts", "status"))
            out, said = [], []
            for kind, blocks, state in zip(kinds, parts, states, strict=True):
                payload = None
                if state == "complete" and kind == "response":
                    try:
                        payload = http_payload(b"".join(blocks))
                    except ValueError as e:
                        state = f"framing: {e}"
                out.append(payload)
                said.append(state)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("record_id", "type", "uri", "payload_digest", "refers_to")]
            columns += [pa.array(said, pa.string()), pa.array([None if x is None else len(x) for x in out], pa.int64()), pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in out], pa.string())]
            names = ["record_id", "type", "uri", "payload_digest", "refers_to", "status", "payload_bytes", "found_digest"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())][: len(names) + with_payload], names + ["payload"] * with_payload)

    schema = "record_id string, type string, uri string, payload_digest string, refers_to string, status string, payload_bytes long, found_digest string"
    return reassembled(records).mapInArrow(run, schema + ", payload binary" * with_payload)


def page_id(column: str) -> Column:
    """The key in a record's identifier, ``urn:page:<key>:<digest>``; payloads that clash under one key have records of their own."""
    return F.get(F.split(column, ":"), F.lit(2)).cast("long")


def round_trip(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:
    """Writes pages to archives and reads them back: per page its payload's size and digest, record type, and what it refers to.

    Both figures of a response come from the payload as read; those of a revisit from the response that it refers to. A page
    whose record doesn't come back whole has null figures.
    """
    captures = pages.select(key, url, F.encode(F.col(html), "UTF-8").alias("payload"))
    write(captures, path, key, url, **options)
    found = payloads(read(pages.sparkSession, path), with_payload=False)
    found = runtime.stored(found.select(page_id("record_id").alias(key), "type", page_id("refers_to").alias("refers_to"), F.coalesce("refers_to", "record_id").alias("of"), "payload_bytes", F.col("found_digest").alias("payload_digest")).distinct(), "captures")
    responses = found.where("type = 'response'")
    target = responses.select("of", "payload_bytes", "payload_digest")
    again = found.where("type = 'revisit'").select(key, "type", "refers_to", "of").join(target, "of", "left")
    columns = [key, "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return responses.select(*columns).unionByName(again.select(*columns))
