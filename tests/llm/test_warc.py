"""Archives: round trips, revisits, and what the reader refuses."""

import base64
import hashlib
import struct

import pytest
import zstandard

from volfuse.llm import warc

ROWS = [
    (1, "http://a/", b"same"), (5, "http://b/", b"same"), (3, None, b"same"), (2, "http://c/\r\nX: y z", b"\x00\xff\r\n\r\nWARC/1.1"),
    (7, "http://d/", None), (8, "http://e/", b""), (9, "http://f/", b"x" * 3_000_000), (None, "http://g/", b"same"),
]


def digest(data):
    return base64.b32encode(hashlib.sha1(data or b"").digest()).decode()


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, least):
    records = spark.createDataFrame(ROWS, "page_id long, url string, payload binary").withColumn("response", warc.F.lit(1))
    out = {r.page_id: r for r in warc.archived(records, least, archive_bytes=1000).collect()}
    assert len(out) == len(ROWS)
    for page_id, url, payload in ROWS:
        r, data = out[page_id], payload or b""
        same = [p for p, _, x in ROWS if (x or b"") == data and p is not None]
        top = max(same) if page_id is not None and len(data) >= least else page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == top else ("revisit", top))
        assert r.payload == (data if page_id == top else None)
        assert r.url == (url and url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, payload binary")).collect() == []


def archive(records, words=b"some words", packed=False):
    held = zstandard.ZstdCompressor().compress(words) if packed else words
    coder = zstandard.ZstdCompressor(dict_data=warc._dict(words))
    return struct.pack("<II", warc.DICTIONARY_FRAME, len(held)) + held + b"".join(map(coder.compress, records)) + warc.END.encode()


def whole(payload=b"payload"):
    return warc.record(4, "http://a/", payload, digest(payload), len(payload), None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("packed", [False, True])
def test_frames(packed):
    records = [whole(b"x" * n) for n in (0, 1, 70_000, 200_000)]
    assert list(warc.frames(archive(records, packed=packed), chunk=777)) == records
    assert [warc.checked(x)[2] for x in records] == [0, 1, 70_000, 200_000]
    assert list(warc.frames(b"")) == []


def test_damage():
    data = archive([whole(), whole()])
    for bad in (data[:-9], data[:5], b"abcdefghij"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))
    good = whole()
    for a, b in ((b"payload", b"paylOad"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dato"), (b"\r\n\r\n", b"\r\n")):
        with pytest.raises(ValueError):
            warc.checked(good.replace(a, b, 1) if a != b"payload" else good.replace(a, b))
    with pytest.raises(ValueError):
        warc.checked(good + b"\r\n")
