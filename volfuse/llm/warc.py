"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Records of equal payloads, of ``least`` bytes or more, are written once: the one of the largest id is the
response, the others are revisits that refer to it and keep its HTTP header without a body. Archives are cut
at about ``archive_bytes``; Spark writes each to a file of the shared folder, ended by an empty skippable frame.

The reader takes the dictionary from the leading skippable frame (plain or compressed), decodes frame by
frame, and raises ValueError where a record isn't whole: version line, mandatory headers, block length,
closing lines, HTTP length and, for responses, the payload's digest.

Null payloads are empty. Rows without an id are never revisits and come back with a null id; null URLs are
left out of the record, control characters and blanks in URLs are percent-encoded. An empty table gives no
archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.llm.staging import is_empty, shared_path, stage
from volfuse.llm.texts import bounded_sample

#: Magic numbers of the formats: a dictionary's frame in an archive, any skippable frame, a trained dictionary, a frame.
DICTIONARY_FRAME, SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0x184D2A50, 0xEC30A437, 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so Spark's text writer can end a file with it.
END = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:x-page:%s>"
SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in base 32: five hexadecimal digits are four of base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Adds digest, length and, for revisits, the id of the response."""
    whole = records.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    whole = whole.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.length("payload").cast("long")})
    same = whole.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    same = stage(same.where("n > 1").drop("n"), "payloads")
    out = whole.join(same, "payload_digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") != F.col("response"), F.col("response"))).drop("response")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Record-ID: " + ID % ("" if page_id is None else page_id),
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url))
    if refers_to is not None:
        lines += ["WARC-Refers-To: " + ID % refers_to, f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: DataFrame, rows: int = 400, size: int = 64 << 10) -> bytes:
    """A dictionary from a bounded sample of records; the sample itself where it is too small to train one."""
    sample = bounded_sample(records.where("page_id is not null"), "page_id", rows)
    # Of a payload in the sample its first bytes are enough, as every record is decoded from its beginning.
    rows_ = sample.select("page_id", "url", F.substring("payload", 1, 8192).alias("payload"), F.length("payload").alias("n")).collect()
    samples = [record(r[0], r[1], bytes(r[2] or b""), "A" * 32, r[3] or 0, None, "1970-01-01T00:00:00Z") for r in sorted(rows_)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\nWARC-Type: "


def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = len(data) >= 4 and struct.unpack("<I", data[:4])[0] == DICTIONARY
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write(records: DataFrame, folder: str, shared: bytes, archive_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Archives of records (page_id, url, payload, digest, length, refers_to), one file each, in ``folder``."""
    box = records.sparkSession.sparkContext.broadcast(shared)
    names = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = box.value
        head = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words
        coder = zstandard.ZstdCompressor(level=level, dict_data=_dict(words), write_checksum=True)
        held, size = [head], 0
        for batch in batches:
            for page_id, url, payload, digest, n, refers_to in zip(*(batch.column(c) for c in names), strict=True):
                frame = coder.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), n.as_py(), refers_to.as_py(), date))
                held.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [head], 0
        if size:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], ["archive"])

    archives = records.select(names).mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", END).text(folder)


def frames(data: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The contents of an archive's frames, one after the other."""
    view, at, decoder = memoryview(data), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends within a frame's header")
        magic, size = struct.unpack("<II", view[at : at + 8])
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("the archive ends within a skippable frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                words = bytes(view[8 : 8 + size])
                if words[:4] == struct.pack("<I", FRAME):
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
                decoder = zstandard.ZstdDecompressor(dict_data=_dict(words))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame begins at byte {at}")
        one, out = (decoder or zstandard.ZstdDecompressor()).decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a frame")
            part = view[at : at + chunk]
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of the one record in ``data``."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record begins here")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.strip().lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't as stated")
    return headers, rest[:size]


def page_of(text: str | None) -> int | None:
    """The number in a record's id."""
    number = text.removeprefix(ID.partition("%s")[0]).rstrip(">") if text else ""
    return int(number) if number else None


def checked(data: bytes) -> tuple:
    """A row of the reader's table for one record."""
    headers, block = parse(data)
    kind = headers["warc-type"]
    http, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    size, digest = int(fields[b"Content-Length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("a payload isn't as stated")
    elif kind != "revisit" or not gap or payload or "warc-refers-to" not in headers:
        raise ValueError("a revisit isn't whole")
    refers_to = page_of(headers.get("warc-refers-to"))
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), size, digest, kind, refers_to, payload if kind == "response" else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data in frames(content.as_py()):
                    rows.append(checked(data))
                    size += len(data)
                    if size >= 8 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, SCHEMA)


def archived(records: DataFrame, least: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """The records (page_id, url, payload), written to archives in the shared folder and read again."""
    spark = records.sparkSession
    if is_empty(records):
        return spark.createDataFrame([], SCHEMA)
    folder = shared_path(spark, "warc")
    write(with_revisits(records, least), folder, dictionary(records), archive_bytes)
    return read(spark, folder)
