"""Token-id files: blocks of ids transposed into byte or bit planes, each plane compressed, with a chunk index.

File: chunks one behind another, then the index, its length (8 bytes, little-endian) and MAGIC. A chunk holds up to
`block` ids as unsigned 32-bit numbers; its planes (4 of bytes, or 32 of bits) are zstandard frames one behind
another. The index is a zstandard frame of JSON: the layout, per chunk its offset, ids and plane sizes, and per document
its id and number of ids. A chunk, or one plane of it, can be read alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, shared_dir, written
from .token_ids import as_bytes, encoder, slices

MAGIC = b"IDPLANE1"
_FILES = "part long, path string, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, ids binary"


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of ids (uint32), low ones first, each uncompressed."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        rows = np.packbits(np.unpackbits(rows[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1)
    return [np.ascontiguousarray(r).tobytes() for r in rows]


def unplanes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    if bits:
        rows = np.unpackbits(rows, axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1)
        rows = np.packbits(rows, axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


class Writer:
    """Writes one file; add() takes documents in order."""

    def __init__(self, out, block: int, bits: bool, level: int) -> None:
        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level)
        self.chunks, self.docs, self.held, self.n_held, self.at, self.n_ids = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            parts = [self.pack.compress(p) for p in planes(ids[i : i + self.block], self.bits)]
            self.chunks.append([self.at, min(self.block, stop - i), [len(p) for p in parts]])
            self.out.write(b"".join(parts))
            self.at += sum(map(len, parts))
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        index = self.pack.compress(json.dumps({"bits": self.bits, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


def read_index(f) -> dict:
    f.seek(f.size() - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token-id file")
    n = int.from_bytes(tail[:8], "little")
    f.seek(f.size() - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(f.read(n)))


def read_chunk(f, index: dict, k: int) -> np.ndarray:
    at, n, sizes = index["chunks"][k]
    f.seek(at)
    data, parts = f.read(sum(sizes)), []
    for size in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(data[:size]))
        data = data[size:]
    return unplanes(parts, n, index["bits"])


def read_docs(f) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each document; no more than a document and a chunk are held."""
    index, k, held = read_index(f), 0, np.zeros(0, "<u4")
    for doc_id, n in index["docs"]:
        if n > len(held):
            got, more = [held], len(held)
            while more < n:
                got.append(read_chunk(f, index, k))
                more, k = more + len(got[-1]), k + 1
            held = np.concatenate(got)
        yield doc_id, held[:n].tobytes()
        held = held[n:]


def write_corpus(docs: DataFrame, tokenizer: str, units: str, end_id: int, block: int = 1 << 16, bits: bool = False, level: int = 3, file_ids: int = 1 << 27, file_docs: int = 1 << 20) -> DataFrame:
    """Files of the ids of every text, each text followed by end_id, in order of doc_id; returns part, path, n_docs, n_ids.

    A file ends behind the document that brings it to file_ids ids or file_docs documents, which bounds the index that is held.

    docs needs doc_id and text; other columns are ignored. Null text is empty (end_id alone). Rows are dealt by ranges
    of doc_id, null first; rows that repeat a doc_id follow one another in order of their text. An empty table makes
    no file. A file gets its name from the task attempt that wrote it: only the files returned count.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, units), end_id.to_bytes(4, "little")
        store, root = fs.FileSystem.from_uri(folder)
        task, number = TaskContext.get(), 0
        out = to = path = None

        def ended() -> pa.RecordBatch:
            out.close()
            to.close()
            name = f"{folder}/{path.rpartition('/')[2]}"
            return pa.RecordBatch.from_pydict({"part": [(task.partitionId() << 24) + number], "path": [name], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                if out is None:
                    store.create_dir(root)
                    path = f"{root}/{task.partitionId():08d}-{number:06d}-{task.taskAttemptId()}.ids"
                    to = store.open_output_stream(path)
                    out = Writer(to, block, bits, level)
                out.add(doc_id, ids + end)
                if out.n_ids >= file_ids or len(out.docs) >= file_docs:
                    yield ended()
                    out, number = None, number + 1
        if out is not None:
            yield ended()

    ordered = as_bytes(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, _FILES), "id_files")


def read_corpus(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document) and ids (binary, little-endian unsigned 32-bit) from write_corpus's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    rows, held = [], 0
                    for doc_id, ids in read_docs(f):
                        rows.append((doc_id, base, ids))
                        base, held = base + len(ids) // 4, held + len(ids)
                        if held >= 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return placed.repartition(partitions(spark)).mapInArrow(run, _DOCS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, starts, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
