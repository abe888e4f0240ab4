"""WARC archives as seekable Zstandard bundles.

Bundle: frames of whole records, each an independent zstandard frame; a skippable frame with the record index (record
identifier to frame number, and offset and length in that frame's content); a skippable frame with the seek table
of the public seekable format (sizes of every frame, then a footer that is found from the file's end). Any record is read
by its frame alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, shared_dir, written
from .token_ids import slices

#: Fixed values of the formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILES = "path string, n_records long, n_frames long, n_bytes long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    name = uri.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of read_archives of one record; a response's digest and length are those of its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    page, sha1 = _page(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        return page, url, "revisit", _page(fields["WARC-Refers-To"]), sha1, n, None
    if digest32(payload) != sha1:
        raise ValueError(f"page {page}: the payload doesn't have its digest")
    return page, url, "response", None, sha1, len(payload), payload


class Bundle:
    """Writes one bundle."""

    def __init__(self, out, frame_bytes: int, level: int) -> None:
        self.out, self.frame_bytes, self.pack = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.index, self.held, self.n_held, self.n_bytes = [], [], [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name, len(self.frames), self.n_held, len(data)))
        self.held.append(data)
        self.n_held += len(data)
        if self.n_held >= self.frame_bytes:
            self._flush()

    def _write(self, data: bytes, size: int) -> None:
        self.out.write(data)
        self.frames.append((len(data), size))
        self.n_bytes += len(data)

    def _flush(self) -> None:
        if self.held:
            data = b"".join(self.held)
            self._write(self.pack.compress(data), len(data))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        names = self.pack.compress(json.dumps(self.index).encode())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(names)) + names, 0)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)


class Reader:
    """Reads an open bundle by its seek table and record index."""

    def __init__(self, f) -> None:
        self.f = f
        f.seek(f.size() - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        f.seek(f.size() - 9 - 8 * n)
        sizes = [struct.unpack("<II", f.read(8)) for _ in range(n)]
        self.at = [0]
        for packed, _ in sizes:
            self.at.append(self.at[-1] + packed)
        f.seek(self.at[n - 1] + 8)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(f.read(sizes[-1][0] - 8)))
        self.places: dict = {}
        for name, *place in self.index:
            self.places.setdefault(name, []).append(place)

    def frame(self, k: int) -> bytes:
        self.f.seek(self.at[k])
        return zstandard.ZstdDecompressor().decompress(self.f.read(self.at[k + 1] - self.at[k]))

    def get(self, name: str) -> bytes | None:
        """The record of that identifier, from its frame alone; of several the first."""
        return next(self.get_all(name), None)

    def get_all(self, name: str) -> Iterator[bytes]:
        """The records of that identifier: pages that repeat a page_id share theirs."""
        for k, start, length in self.places.get(name, ()):
            yield self.frame(k)[start : start + length]

    def records(self) -> Iterator[bytes]:
        now, data = -1, b""
        for _, k, start, length in self.index:
            if k != now:
                now, data = k, self.frame(k)
            yield data[start : start + length]


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (binary), sha1 and refers_to (null for a response) of every row.

    Payloads are equal when their length and SHA-256 are. Of equal payloads of at least `least` bytes the largest page_id
    is the response. Only the largest page_id of a payload is gathered, before the join.
    """
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    key = [F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256")]
    top = written(body.select("page_id", *key).groupBy("size", "sha256").agg(F.max("page_id").alias("top")), "tops")
    top = top.select(F.col("size").alias("of_size"), F.col("sha256").alias("of"), "top")
    joined = body.select("*", *key, F.sha1("html").alias("sha1")).join(top, (F.col("sha256") == F.col("of")) & (F.col("size") == F.col("of_size")))
    again = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "html", "sha1", F.when(again, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Bundles with a record for every row of pages; returns path, n_records, n_frames, n_bytes.

    pages needs page_id, url and html; other columns are ignored. Null html is an empty payload, null url leaves its header
    out. Rows that repeat the largest page_id of a payload are all responses; if all its page_ids are null, so are all
    of those. An empty table makes no bundle. Bundles are named by the task attempt that wrote them: only those
    returned count.
    """
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task, n = TaskContext.get(), 0
        made: list[tuple] = []
        out = bundle = None
        name = ""

        def close() -> None:
            bundle.close()
            out.close()
            made.append((f"{folder}/{name}", len(bundle.index), len(bundle.frames) - 1, bundle.n_bytes))

        for b in slices(batches, name="html"):
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")), strict=True)
            for page_id, url, html, sha1, refers_to in rows:
                if out is None:
                    store.create_dir(root)
                    name = f"{task.partitionId():08d}-{task.taskAttemptId()}-{n}.warc.zst"
                    out, n = store.open_output_stream(f"{root}/{name}", compression=None), n + 1
                    bundle = Bundle(out, frame_bytes, level)
                bundle.add(_uri(page_id), record(page_id, url, html, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date))
                if bundle.n_bytes >= bundle_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "n_records", "n_frames", "n_bytes"), map(list, zip(*made, strict=True)), strict=True)))

    return written(decide(pages, least).mapInArrow(run, _FILES), "bundles")


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for a revisit) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for path in b.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    rows, held = [], 0
                    for data in Reader(f).records():
                        rows.append(parse(data))
                        held += len(data)
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return files.select("path").repartition(partitions(files.sparkSession)).mapInArrow(run, _RECORDS)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
x AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((five[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM x
"""
