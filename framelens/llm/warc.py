"""Operator 6: dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records
(``SAMPLE_RECORDS``), put into a leading skippable frame of every archive, and
every record is compressed on its own with it, so any record can be read by
its offset. Each task writes its rows to archives of about ``ARCHIVE_BYTES`` in
a folder that all executors share, under names of its own, and returns the
finished ones; the manifest of returned names is what counts, so files of a
lost or repeated attempt are never read. Reading streams archive by archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

SAMPLE_RECORDS = 1000
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 25
SKIPPABLE = 0x184D2A5D
MANIFEST = "archive string, records bigint, bytes bigint"
RECORD = ("archive string, offset bigint, record_type string, page_id bigint, url string, refers_to bigint, "
          "payload_bytes bigint, payload_digest string, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, kind: str, digest: str, size: int, refers_to, payload: bytes, date: str) -> bytes:
    """One WARC record; a revisit has headers only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {size}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a record, its payload, and the digest and size of a payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("truncated record")
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if kind == "response" and (base32_sha1(payload), len(payload)) != (digest, size):
        raise ValueError("payload does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"record_type": kind, "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"),
            "refers_to": number("X-Refers-To-Page"), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if kind == "response" else None}


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add digest (hex SHA-1), size, kind and refers_to; html becomes a non-null string."""
    df = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                      F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn(
        "size", F.octet_length("html").cast("bigint"))
    first = df.groupBy("digest").agg(F.min("page_id").alias("_first"))
    df = df.join(first, "digest")
    again = (F.col("size") >= least_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")))
    again = F.coalesce(again & F.col("_first").isNotNull(), F.lit(False))
    return (df.withColumn("kind", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("_first"))).drop("_first"))


def build_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of a bounded sample of payloads (by a hash of the payload); small tables give raw content."""
    n = pages.count()
    share = int(1_000_000 * min(1.0, records / max(n, 1))) + 1
    pick = pages.filter(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share).filter("html <> ''")
    rows = pick.select("html").dropDuplicates().limit(records).collect()
    payloads = sorted(r["html"].encode() for r in rows)
    if not payloads:
        return b""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(payloads)[:size]


def _filesystem(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0,
                   date: str = "2024-01-01T00:00:00Z", level: int = 6,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of (page_id, url, html); returns the manifest.

    Of rows with equal payloads of ``least_bytes`` or more, those with the
    smallest page_id are responses, others revisit it; smaller payloads are all
    responses. Repeated rows of that smallest id are responses each. A null
    html is empty; null urls and ids are left out of the record; a null id
    counts as larger than any. An empty table writes nothing.
    """
    spark = pages.sparkSession
    decided = decide(pages, least_bytes)
    shared = spark.sparkContext.broadcast(build_dictionary(
        pages.select(F.coalesce("html", F.lit("")).alias("html"))))
    folder = folder or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches):
        words = shared.value
        table = zstandard.ZstdCompressionDict(words) if words else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=table, write_checksum=True)
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, records = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [name], "records": [records], "bytes": [size]},
                schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, records = fs.open_output_stream(f"{root}/{name}"), 0
                    size = out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                payload = row["html"].encode() if row["html"] is not None else b""
                size += out.write(packer.compress(record(
                    row["page_id"], row["url"], row["kind"], digest, row["size"], row["refers_to"], payload, date)))
                records += 1
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    rows = decided.select("page_id", "url", "digest", "size", "kind", "refers_to",
                          F.when(F.col("kind") == "response", F.col("html")).alias("html"))
    return cut_lineage(rows.mapInArrow(write, MANIFEST).withColumn("folder", F.lit(folder)))


def frames(stream, step: int = 1 << 15):
    """``(offset, content)`` of every compressed frame after the leading skippable one."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    words = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    left, at = b"", 8 + size
    while True:
        left = left or stream.read(step)
        if not left:
            return
        frame, start, out = unpacker.decompressobj(), at, []
        while not frame.eof:
            if not left:
                left = stream.read(step)
                if not left:
                    raise ValueError("truncated frame")
            out.append(frame.decompress(left))
            rest = frame.unused_data if frame.eof else b""
            at += len(left) - len(rest)
            left = rest
        yield start, b"".join(out)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives that a manifest names; digests are checked while reading."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                        ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = _filesystem(row["folder"])
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{row['archive']}") as stream:
                    for offset, data in frames(stream):
                        found = parse(data)
                        if not payloads:
                            found["payload"] = None
                        rows.append({"archive": row["archive"], "offset": offset, **found})
                        held += len(found["payload"] or b"") + 200
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("folder", "archive").mapInArrow(read, RECORD)
