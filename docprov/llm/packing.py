"""Packing token ids into sequences: first-fit decreasing in random groups of pieces.

A document is cut every `size` ids into pieces. Pieces go to random groups of bounded size with their ids, which move this once;
a group is packed on its own by first-fit decreasing, with a tournament tree over the bins' free space to find the first that
fits, and its sequences are built where it is packed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import as_bytes, encoder, slices

_PIECES = "piece_id long, doc_id long, start long, length long, doc_tokens long, width int, ids binary"
_OWN = ["offset", "piece_id", "doc_id", "start", "length", "doc_tokens"]
_SEQUENCES = f"sequence_id long, length long, ids binary, pieces array<struct<{', '.join(f'{c}:long' for c in _OWN)}>>"


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; no item is longer than size. Equal lengths are taken in the order given.

    The tree's leaves are the free space of bins, an inner node is the most of its two: the walk from the root goes
    left wherever the left half has room.
    """
    n = len(lengths)
    leaves = 1 << max(1, math.ceil(math.log2(max(2, n))))
    tree = [size] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        need, at = int(lengths[item]), 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[item], offsets[item] = at - leaves, size - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, units: str, end_id: int, size: int = 4096) -> DataFrame:
    """The pieces of all documents: piece_id (a number of its own), doc_id, start, length, doc_tokens, width and ids (binary,
    little-endian, `width` bytes each: 2 where the file has no id of 65,536 or more, else 4).

    docs needs doc_id and text; other columns are ignored. Null text is empty and gives end_id alone. Rows that repeat another,
    or a doc_id, have pieces of their own. A text is held whole by one task, with its ids: 15 to 25 times its bytes. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, units), end_id.to_bytes(4, "little")
        width = 2 if max(end_id, encode.largest) < 1 << 16 else 4
        number = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                if width == 2:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                for start in range(0, n, size):
                    part = ids[width * start : width * (start + size)]
                    rows.append((number, doc_id, start, len(part) // width, n, width, part))
                    number += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["piece_id", "doc_id", "start", "length", "doc_tokens", "width", "ids"])

    return as_bytes(docs).mapInArrow(run, _PIECES)


def groups_for(docs: DataFrame, size: int = 4096, group_rows: int = 4096) -> int:
    """How many groups of about group_rows pieces hold all pieces of docs: a text has no more ids than bytes, so there are no more
    pieces than texts and `size` bytes' parts of all texts."""
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return max(1, math.ceil((n + (total or 0) / size) / group_rows))


def pack(cut: DataFrame, groups: int, size: int = 4096, pad: int = 0, seed: int = 7) -> DataFrame:
    """The sequences of pieces(): sequence_id, length (without padding), ids (binary, little-endian unsigned 32-bit, padded to size
    with pad, but for a length that is a power of two) and pieces (array of offset, piece_id, doc_id, start, length, doc_tokens, by
    offset, gapless from 0).

    A piece's group is a hash of its piece_id, so that groups are about equal whatever they hold, repeated rows too; a task holds
    one, 2 or 4 bytes for each id. Pieces of equal length are taken by piece_id. An empty table gives no rows.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece_id")
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), size)
        first = t.column("grp")[0].as_py() << 32 if t.num_rows else 0
        order = np.lexsort((offsets, bins))
        numbers = np.stack([offsets, *(t.column(c).to_numpy() for c in ("piece_id", "start", "length", "doc_tokens"))], 1)[order].tolist()
        doc_ids, parts = t.column("doc_id").to_pylist(), t.column("ids").to_pylist()
        width = t.column("width")[0].as_py() if t.num_rows else 4
        starts = np.flatnonzero(np.diff(bins[order], prepend=-1)).tolist()
        out: tuple = ([], [], [], [])
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            ids = b"".join(parts[i] for i in order[a:b])
            n = len(ids) // width
            if width == 2:
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            if n.bit_count() != 1:
                ids += pad.to_bytes(4, "little") * (size - n)
            held = [dict(zip(_OWN, (o, p, doc_ids[i], *rest), strict=True)) for i, (o, p, *rest) in zip(order[a:b].tolist(), numbers[a:b], strict=True)]
            for c, x in zip(out, (int(bins[order[a]]) + first, n, ids, held), strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([(c, pa.int64()) for c in _OWN])))
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["sequence_id", "length", "ids", "pieces"])

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "piece_id"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(run, _SEQUENCES)


def placed(built: DataFrame) -> DataFrame:
    """A row for each piece of pack(), with the crc32 of its ids as they stand there: ids_crc32 (long)."""
    each = F.transform("pieces", lambda x: x.withField("ids_crc32", F.crc32(F.substring(F.col("ids"), (x["offset"] * 4 + 1).cast("int"), (x["length"] * 4).cast("int")))))
    return built.select("sequence_id", F.inline(each))
