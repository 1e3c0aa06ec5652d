"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC
records, and a last, skippable frame with a seek table: for every frame its
compressed and decompressed size, in the public seekable format, so that
any zstd tool can read the file from the start. An index maps record identifiers
to bundle, frame and the record's offset within the decompressed frame.

Payload bytes are stored once: of records with equal payloads of at least
``min_bytes`` bytes the one with the smallest page id is a response, and the others
are revisits that refer to it.

Tasks write bundles straight into a folder that driver and executors share,
under a name that no other attempt has, and list them in a table that Spark
commits; bundles of lost or repeated attempts aren't listed and aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MIN_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEVEL = 3
#: Of the seekable format: the skippable frame's magic number, and the one that ends the file.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122


def record_id(page_id: int | None, digest: str, ordinal: int = 0) -> str:
    """A record's identifier follows from its page's id and payload digest, and for rows that repeat from an ordinal."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}:{ordinal}')}>"


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One WARC/1.1 record. Line ends in header values become spaces."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in [*headers, ("Content-Length", str(len(payload)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode("utf-8", "replace") + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and where the next one starts."""
    head_end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} doesn't end where its length says")
    return headers, data[start:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The last frame: (compressed, decompressed) sizes, their number, no checksums, and the magic number."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file has no seek table")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * entry)
    raw, out, at = f.read(n * entry), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, i * entry)
        out.append((at, c, d))
        at += c
    return out


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Bundle:
    """A bundle that is being written."""

    def __init__(self, folder: str):
        files, base = _files(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        files.create_dir(base, recursive=True)
        self.out = files.open_output_stream(f"{base}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames, self.entries, self.parts, self.size, self.written = [], [], [], 0, 0

    def add(self, rid: str, data: bytes) -> None:
        self.entries.append((rid, len(self.frames), self.size))
        self.parts.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            frame = self.zstd.compress(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.parts, self.size = [], 0

    def close(self):
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        rows = self.entries
        return pa.RecordBatch.from_arrays([pa.array([self.name] * len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["bundle", "record_id", "frame", "offset"])


_INDEX = "bundle string, record_id string, frame int, offset long"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> str:
    """Writes a record for each row of pages to path, a new folder that executors share; returns path.

    The payload is the html in UTF-8 (null: empty). Null urls are left out of
    the record. Repeated ids each have a record, told apart by an ordinal; of
    equal payloads under the smallest id one row is the response. Pages with a
    null id sort last. Other columns are ignored; an empty table makes no bundles.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    # Which page holds the payload, and which rows repeat: ids and digests alone are shuffled for it, after a partial aggregation.
    keys = rows.groupBy("id", "digest", "size").agg(F.count("*").alias("times"))
    firsts = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.sum("times").alias("n"))
    slim = keys.join(firsts.where("n > 1").drop("n"), "digest", "left").where("times > 1 OR first IS NOT NULL")
    page = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("page")
    # Rows that repeat come together, whatever files they are in and however Spark joins; a sort-merge join needs no other shuffle.
    apart = rows.select(page, *rows.columns).repartition("page", "digest")
    joined = apart.join(slim.select(page, "digest", "first"), ["page", "digest"], "left").select("id", "url", "body", "digest", "first")
    folder = f"{path}/bundles"

    def store(batches):
        bundle, last, ordinal = None, None, 0
        for b in batches:
            for id_, url, body, digest, first in zip(b["id"].to_pylist(), b["url"].to_pylist(), b["body"].to_pylist(), b["digest"].to_pylist(), b["first"].to_pylist(), strict=True):
                ordinal = ordinal + 1 if last == (id_, digest) else 0
                # Rows that repeat lie next to each other, so all but the first one are revisits.
                again = first is not None and (id_ != first or last == (id_, digest))
                last = (id_, digest)
                rid = record_id(id_, digest, ordinal)
                headers = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", rid)]
                headers += [("WARC-Target-URI", url)] if url is not None else []
                headers += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Page-ID", "" if id_ is None else str(id_)), ("Payload-Length", str(len(body)))]
                if again:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Page-ID", str(first))]
                bundle = bundle or _Bundle(folder)
                bundle.add(rid, record(headers, b"" if again else body))
                if bundle.written >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    joined.sortWithinPartitions(F.col("id").asc_nulls_last(), "digest", "url").mapInArrow(store, _INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return path


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles that path's index lists, frame by frame through the seek tables.

    Columns: page_id, payload_bytes and payload_digest (of the full payload),
    record_type, refers_to (the response's page), record_id, url and, if asked
    for, payload (null for revisits). A response whose digest isn't the one in
    its header fails the read, and so does an index entry that points elsewhere.
    """
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    # One row a frame; a frame holds about FRAME_BYTES, so the list of its records is short.
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list(F.struct("offset", "record_id"))).alias("entries"))
    frames = frames.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame")
    folder = f"{path}/bundles"

    def load(batches):
        files, base = _files(folder)
        name, f, table, unzip = None, None, [], zstandard.ZstdDecompressor()
        for b in batches:
            for bundle, frame, entries in zip(b["bundle"].to_pylist(), b["frame"].to_pylist(), b["entries"].to_pylist(), strict=True):
                if bundle != name:
                    name, f = bundle, files.open_input_file(f"{base}/{bundle}")
                    table = read_seek_table(f)
                at, size, whole = table[frame]
                f.seek(at)
                data = unzip.decompress(f.read(size), max_output_size=whole)
                rows = []
                for e in entries:
                    h, payload, _ = parse(data, e["offset"])
                    if h["WARC-Record-ID"] != e["record_id"]:
                        raise ValueError(f"the index points from {e['record_id']} to {h['WARC-Record-ID']}")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    response = h["WARC-Type"] == "response"
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {e['record_id']} has another digest")
                    rows.append((int(h["Page-ID"]) if h["Page-ID"] else None, len(payload) if response else int(h["Payload-Length"]), digest, h["WARC-Type"], int(h["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in h else None, e["record_id"], h.get("WARC-Target-URI"), payload if response and with_payload else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_RECORD)], schema=_RECORD)

    out = frames.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, payload binary")
    return out if with_payload else out.drop("payload")


def lookup(spark: SparkSession, path: str, ids: list[str]) -> list[tuple[dict, bytes]]:
    """Headers and payloads of a few records, each by one seek and one frame."""
    files, base = _files(f"{path}/bundles")
    out = []
    for e in spark.read.schema(_INDEX).parquet(f"{path}/index").where(F.col("record_id").isin(ids)).collect():
        with files.open_input_file(f"{base}/{e.bundle}") as f:
            at, size, whole = read_seek_table(f)[e.frame]
            f.seek(at)
            out.append(parse(zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=whole), e.offset)[:2])
    return out


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
