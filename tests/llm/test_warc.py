import gzip
import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import warc


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_chunk_extensions_and_faults():
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nX: y\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def expected(rows):
    pages = {(i, (h or "").encode()) for i, _, h in rows if i is not None}
    out = set()
    for i, p in pages:
        first = min(j for j, q in pages if q == p)
        again = len(p) >= 100 and first < i
        out.add((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_round_trip(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate([None, "", "short", "short", "x" * 100, "x" * 100, long, long, "y" * 99, "y" * 99, "x" * 100])]
    rows += [(None, "u", "z" * 200), (20, None, "a\r\nb" * 50), (21, "http://a\r\nb", "q"), (6, "http://h/6", long), (7, "again", long), (22, "one", "v" * 150), (22, "two", "w" * 150), (23, "three", "w" * 150)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = [tuple(r) for r in warc.round_trip(pages, f"file://{tmp_path}/w", segment_bytes=1000, chunk_bytes=64, records_per_file=3).collect()]
    assert set(got) == expected(rows) and len(got) == len(expected(rows))
    segments = warc.read(spark, f"file://{tmp_path}/w").where("type = 'continuation'").count()
    assert segments > 50


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, f"file://{tmp_path}/w").count() == 0


def test_broken_segments_and_gzip(spark, tmp_path):
    def archive(name, identity, drop=None, repeat=None, total=None):
        parts = list(warc.response_records(identity, "u", "2000-01-01T00:00:00Z", b"abcdefgh" * 40, "d", 100, 16))
        if total:
            parts[-1] = parts[-1].replace(b"Total-Length: ", b"Total-Length: 1")
        parts = [x for i, x in enumerate(parts) if i != drop] + ([parts[repeat]] if repeat is not None else [])
        Path(tmp_path, name).write_bytes(b"".join(gzip.compress(x + warc.END) for x in reversed(parts)))

    archive("a.warc.gz", "urn:page:1")
    archive("b.warc.gz", "urn:page:2", drop=1)
    archive("c.warc.gz", "urn:page:3", repeat=2)
    archive("d.warc.gz", "urn:page:4", total=True)
    rows = {r.record_id: r for r in warc.payloads(warc.read(spark, str(tmp_path))).collect()}
    assert rows["urn:page:1"].payload == rows["urn:page:3"].payload == b"abcdefgh" * 40
    assert (rows["urn:page:2"].status, rows["urn:page:2"].payload) == ("segments missing", None)
    assert (rows["urn:page:4"].status, rows["urn:page:4"].payload) == ("length differs", None)


def test_cut_archive_raises():
    whole = warc.revisit_record("urn:page:1", None, "d", "urn:page:0", "x")
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-3]))
