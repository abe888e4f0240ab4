"""Removal of repeated byte strings by a distributed sparse suffix array.

A byte is removed if a string of `length` bytes that covers it also starts earlier (in a smaller doc_id, or earlier in its
document). Of all suffixes, only those at anchors are sorted: the anchor of a string is the place of its least hash among
its `gram`-byte substrings, so equal strings have their anchors at equal places and no string is without one.

1. Texts are stored in blocks, a long text in several: each has the strings that start in its part, and so ends `length` - 1
   bytes later. A block's different anchor hashes go to buckets, which answer with those that another block (or another
   place) has too. Other anchors can't be part of a repeat.
2. Each remaining anchor becomes one suffix: the bytes from it on, then the bytes before it, backwards. Equal suffixes of
   a block are one. Splitters sampled from the suffixes deal them out by ranges.
3. A bucket sorts its suffixes by multikey quicksort, forwards and backwards, and common prefixes of neighbours say
   which strings are equal. Where a bucket's border cuts a run of equal prefixes, its first strings are compared with
   those of the other buckets.
4. Each block marks its bytes; the parts of a long text meet again by their row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, written
from .token_ids import as_bytes, slices

#: Blocks below zero are part of one text: that of row `row`, from byte `base` on.
_BLOCK = "block long, n_bytes long, row long, base long, doc_ids binary, nulls binary, sizes binary, data binary"
_KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
_PARTS = "row long, base long, doc_id long, spans array<struct<start:long,stop:long>>, own binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_NOTE = "block long, kind int, bucket int, payload binary"
_DEALT = "block long, n int, bucket int, payload binary"
_MATCHED = "block long, n int, payload binary, o int, string binary, id long, start long"
_POS_BITS = 31
_TILE = 1 << 15


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, n_at: int, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of n_at rows each, of (dtype, columns)."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for dtype, columns in kinds:
        size = n_at * columns * np.dtype(dtype).itemsize
        a = np.frombuffer(raw, dtype, n_at * columns, at)
        out.append(a.reshape(n_at, columns) if columns > 1 else a)
        at += size
    return out


@dataclass(frozen=True)
class Shape:
    """length of the strings, gram of an anchor; a suffix has `length` bytes forwards and `back` backwards."""

    length: int
    gram: int

    @property
    def back(self) -> int:
        return self.length - self.gram


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each place on; the last gram - 1 places are left out."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(31)
    step, factor = 1, 0xD6E8FEB86659FD93
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
        step, factor = 2 * step, (factor * factor + 2) % 2**64 | 1
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(place, low, high, hash, document) of each anchor; it stands `low` to `high` bytes behind its strings' starts."""
    n, none = len(data), (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    docs = np.flatnonzero(sizes >= shape.length)
    if not len(docs):
        return none
    low_bits, width = np.uint64((1 << _POS_BITS) - 1), shape.back + 1
    place, h = np.empty(n - shape.length + 1, np.int64), np.empty(n - shape.gram + 1, np.uint64)
    for lo in range(0, len(place), _TILE):  # of string starts; arrays of a tile stay in the processor's cache
        hi = min(lo + _TILE, len(place))
        own = gram_hashes(data[lo : hi + shape.length - 1], shape.gram)
        h[lo : lo + len(own)] = own
        key, have = (own & ~low_bits) | np.arange(lo, lo + len(own), dtype=np.uint64), 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        place[lo:hi] = key & low_bits
    begin = starts[docs]
    end = begin + sizes[docs] - shape.length + 1
    new = np.concatenate([[True], place[1:] != place[:-1]])
    new[begin] = True
    inside = np.zeros(len(place) + 1, np.int8)
    inside[begin] += 1
    inside[end] -= 1
    first = np.flatnonzero(new & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    of = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.concatenate([first[1:], [len(place)]]), end[of]) - 1
    place = place[first]
    return place, place - last, place - first, h[place], docs[of]


def grouped(key: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each value that key has, in ascending order."""
    if not len(key):
        return {}
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    return {int(key[own[0]]): own for own in np.split(order, edges)}


def marked(mask: np.ndarray) -> list[dict]:
    """The maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


@dataclass
class Block:
    """A block's texts and its anchors; a part of a text begins at byte `base` of it."""

    ids: np.ndarray
    nulls: np.ndarray  # 1 for a null doc_id, which is behind all others
    sizes: np.ndarray
    data: np.ndarray
    shape: Shape
    base: int = 0
    row: int | None = None

    def __post_init__(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place, self.low, self.high, self.hash, self.doc = anchors(self.data, self.starts, self.sizes, self.shape)
        self.unique, self.inverse, self.counts = np.unique(self.hash, return_inverse=True, return_counts=True)

    def buckets(self, n: int) -> dict[int, np.ndarray]:
        """Places of the unique hashes of each bucket that has some."""
        return grouped((self.unique % np.uint64(n)).astype(np.int64))

    def repeated(self, notes: list, n: int) -> np.ndarray:
        """Anchors whose hash is elsewhere too, given the buckets' answers (bucket, bits)."""
        twice = self.counts > 1
        places = self.buckets(n) if notes else {}
        for bucket, payload in notes:
            own = places[bucket]
            twice[own] |= np.unpackbits(np.frombuffer(payload, np.uint8))[: len(own)].astype(bool)
        return np.flatnonzero(twice[self.inverse])

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, representative anchors, for each of chosen its row): equal ones are one, the earliest."""
        s, place = self.shape, self.place[chosen]
        begin, end = self.starts[self.doc[chosen]], (self.starts + self.sizes)[self.doc[chosen]]
        order = np.lexsort((chosen, place - begin, self.ids[self.doc[chosen]], self.nulls[self.doc[chosen]]))
        chosen, place, begin, end = chosen[order], place[order], begin[order], end[order]
        around = np.lib.stride_tricks.sliding_window_view(np.pad(self.data, (s.back, s.length)), s.back + s.length)[place]
        out = np.concatenate([around[:, s.back :], around[:, : s.back][:, ::-1]], axis=1)
        rest = np.flatnonzero((end - place < s.length) | (place - begin < s.back))  # those at an end of their text
        beyond = np.concatenate([np.arange(s.length) >= (end - place)[rest, None], np.arange(s.back) >= (place - begin)[rest, None]], axis=1)
        out[rest] = np.where(beyond, np.uint8(0), out[rest])
        full = np.concatenate([out, self.low[chosen].astype(np.uint8)[:, None], self.high[chosen].astype(np.uint8)[:, None]], axis=1)
        _, first, row = np.unique(np.ascontiguousarray(full).view(f"V{full.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))  # rows in the order of their first ones
        kept = np.sort(first)
        back = np.empty(len(order), np.int64)
        back[order] = rank[row.reshape(-1)]
        return out[kept], chosen[kept], back


def multikey_order(text: np.ndarray) -> np.ndarray:
    """Order of rows of bytes by multikey quicksort, a character being 8 bytes: all rows that are still equal up to some
    character are partitioned by the next one at once; rows that stand alone are done."""
    n = len(text)
    wide = -(-text.shape[1] // 8) * 8
    padded = np.zeros((n, wide), np.uint8)
    padded[:, : text.shape[1]] = text
    words = padded.view(">u8")
    order, group = np.arange(n), np.zeros(n, np.int64)  # group by position in order: where its group starts
    open_ = np.arange(n)
    for c in range(words.shape[1]):
        if len(open_) < 2:
            break
        rows, of = order[open_], group[open_]
        value = words[rows, c].astype(np.uint64)
        by = np.lexsort((value, of))
        rows, of, value = rows[by], of[by], value[by]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])])
        order[open_] = rows
        starts = open_[np.flatnonzero(new)]
        group[open_] = starts[np.cumsum(new) - 1]
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        open_ = open_[np.repeat(sizes > 1, sizes)]
    return order


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of bytes."""
    same = a == b
    if not same.shape[1]:
        return np.zeros(len(same), np.int64)
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))


def shared_with_next(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, in that order, and the next."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    for lo in range(0, len(out), _TILE):
        rows = text[order[lo : lo + _TILE + 1]]
        out[lo : lo + _TILE] = common(rows[1:], rows[:-1])
    return out


def compare(text: np.ndarray, low: np.ndarray, high: np.ndarray, borders: list[bytes | None], shape: Shape) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(flags, open): flags[i, o] is 1 if row i's string o bytes before its anchor is another row's before i; open has the
    (row, o) that were first here but may be elsewhere. Rows come in order of their place in the corpus."""
    s, n = shape, len(text)
    flags, undecided = np.zeros((n, s.back + 1), bool), []
    ahead, behind = text[:, : s.length], text[:, s.length :]
    by_ahead, by_behind = multikey_order(ahead), multikey_order(behind)
    share_a, share_b = shared_with_next(ahead, by_ahead), shared_with_next(behind, by_behind)
    at_border = np.zeros(n, np.int64)
    for b in borders:
        if b is not None:
            edge = np.frombuffer(b[: s.length].ljust(s.length, b"\0"), np.uint8)
            for lo in range(0, n, _TILE):
                at_border[lo : lo + _TILE] = np.maximum(at_border[lo : lo + _TILE], common(ahead[lo : lo + _TILE], edge[None, :]))
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(s.back + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if not len(rows):
            continue
        a[by_ahead[1:]] = np.cumsum(share_a < s.length - o)
        b[by_behind[1:]] = np.cumsum(share_b < o)
        first = np.unique(a[rows] * n + b[rows], return_index=True)[1]
        flags[rows, o] = True
        flags[rows[first], o] = False
        for i in rows[first][at_border[rows[first]] >= s.length - o].tolist():
            undecided.append((i, o))
    return flags, undecided


def _blocks(docs: DataFrame, block_bytes: int, length: int) -> DataFrame:
    def block(number: int, given: list, texts: list[bytes], row: int | None = None, base: int | None = None) -> pa.RecordBatch:
        ids, nulls = np.array([i or 0 for i in given], np.int64), np.array([i is None for i in given], np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return _batch([(number, int(sizes.sum()), row, base, ids.tobytes(), nulls.tobytes(), sizes.tobytes(), data)], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 24
        for b in (x for whole in batches for x in slices(iter([whole]), block_bytes)):
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
            short = [r for r in rows if len(r[1]) <= block_bytes]
            if short:
                k += 1
                yield block(k, *zip(*short, strict=True))
            for i, t in (r for r in rows if len(r[1]) > block_bytes):
                row = k + 1
                for at in range(0, len(t), block_bytes):
                    k += 1
                    yield block(-k, [i], [t[at : at + block_bytes + length - 1]], row, at)

    return written(as_bytes(docs).mapInArrow(run, _BLOCK), "blocks")


def _opened(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[int, Block, list]]:
    for b in batches:
        for r in b.to_pylist():
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint8)
            ids, nulls, sizes = (np.frombuffer(r[c], kind) for c, kind in (("doc_ids", np.int64), ("nulls", np.uint8), ("sizes", np.int64)))
            yield r["block"], Block(ids, nulls, sizes, data, shape, r["base"] or 0, r["row"]), r.get("notes") or []


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])


def _buckets(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("bucket",)) -> Iterator[list[dict]]:
    """The rows of each bucket, of batches sorted by keys: no more than one bucket's are held."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and any(r[k] != rows[0][k] for k in keys):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _joined(rows: list[dict], columns: tuple) -> tuple[np.ndarray, ...]:
    """The suffixes of rows and their blocks, in order of their places in the corpus; rows leave their payloads."""
    parts = [_unpack(r.pop("payload"), r["n"], *columns) for r in rows]
    text, ids, nulls, place, index, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    block = np.repeat(np.array([r["block"] for r in rows]), [r["n"] for r in rows])
    order = np.lexsort((block, place, ids, nulls))
    return tuple(x[order] for x in (text, ids, nulls, place, index, low, high, block))


def _flagged(block: np.ndarray, index: np.ndarray, flags: np.ndarray) -> list[tuple]:
    """Rows of _MATCHED: per block the suffixes that have flags."""
    out, by_block = [], np.argsort(block, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(block[by_block]) != 0, [True]])) if len(block) else []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        own = by_block[lo:hi]
        own = own[flags[own].any(axis=1)]
        if len(own):
            out.append((int(block[by_block[lo]]), len(own), _pack(index[own], np.packbits(flags[own], axis=1)), None, None, None, None))
    return out


def _with_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    of = notes.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("notes"))
    return blocks.join(of, F.col("block") == F.col("of"), "left").drop("of")


def repeats(docs: DataFrame, length: int = 100, gram: int = 32, block_bytes: int = 2 << 20, samples: int = 40, bucket_bytes: int = 32 << 20, most: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop: the maximal removed runs, in bytes) and kept (binary), a row per row of docs.

    docs needs doc_id and text; other columns are ignored. Texts are taken as UTF-8, null as empty; texts shorter than
    `length` are kept whole. A null doc_id is behind all others; rows that repeat a doc_id count as one document in which
    strings at equal places are ordered by where they are stored. What is kept is bytes: a run may end within a
    character. A block's arrays take some 80 bytes for each byte that repeats others; a text of more than block_bytes is cut
    into blocks, and put together again it takes about four bytes a byte, as any row of a text does; such a row has less than
    2 GB. An empty table gives no rows. gram must be a power of two. There is a bucket for each bucket_bytes of text, and
    a task holds one at a time. A bucket of more than `most` suffixes, such as those of a passage that all blocks hold, is first
    dealt in parts, which leave one of equal suffixes each.
    """
    spark, shape = docs.sparkSession, Shape(length, gram)
    blocks = _blocks(docs, block_bytes, length)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_tasks = partitions(spark)
    n_buckets = max(n_tasks, -(-total // bucket_bytes))

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t, _ in _opened(batches, shape):
            yield _batch([(block, 0, k, t.unique[own].tobytes()) for k, own in t.buckets(n_buckets).items()], _NOTE)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            each = [np.frombuffer(r["payload"], np.uint64) for r in rows]
            values, inverse, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            more = np.split(counts[inverse.reshape(-1)] > 1, np.cumsum([len(x) for x in each])[:-1])
            yield _batch([(r["block"], 0, r["bucket"], np.packbits(m).tobytes()) for r, m in zip(rows, more, strict=True) if m.any()], _NOTE)

    told = written(blocks.mapInArrow(announce, _NOTE).repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _NOTE), "answers")
    columns = (("u1", length + shape.back), ("i8", 1), ("u1", 1), ("i8", 1), ("u4", 1), ("u1", 1), ("u1", 1))

    def collapse(t: Block, notes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        chosen = t.repeated([(x["bucket"], x["payload"]) for x in notes if x["kind"] == 0], n_buckets)
        return chosen, *t.suffixes(chosen)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t, notes in _opened(batches, shape):
            _, text, anchor, _ = collapse(t, notes)
            if len(text):
                doc = t.doc[anchor]
                pick = text[np.argsort(t.hash[anchor] * np.uint64(0x9E3779B97F4A7C15))[:samples]]
                payload = _pack(text, t.ids[doc], t.nulls[doc], t.place[anchor] - t.starts[doc] + t.base, np.arange(len(anchor), dtype=np.uint32), t.low[anchor].astype(np.uint8), t.high[anchor].astype(np.uint8))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([len(text)], pa.int32()), "payload": [payload], "sample": [[x.tobytes() for x in pick]]})

    suffixes = written(_with_notes(blocks, told).mapInArrow(gather, "block long, n int, payload binary, sample array<binary>"), "suffixes")
    # splitters: an even sample of the blocks' samples, `samples` for each bucket at most
    sampled = suffixes.select("n", F.explode("sample").alias("s")).orderBy(F.xxhash64("s", "n")).limit(samples * min(n_buckets, 4096)).collect()
    ordered = sorted(bytes(r["s"]) for r in sampled)
    splitters = sorted({ordered[len(ordered) * k // n_buckets] for k in range(1, n_buckets)}) if ordered else []
    held = spark.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cols = _unpack(r["payload"], r["n"], *columns)
                bucket = np.array([bisect_right(held.value, x.tobytes()) for x in cols[0]])
                yield _batch([(r["block"], len(own), k, _pack(*(c[own] for c in cols))) for k, own in grouped(bucket).items()], _DEALT)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One of equal suffixes stays (bucket is set), the earliest; the others are repeats at all their places (o is -1)."""
        for rows in _buckets(batches, ("bucket", "part")):
            text, ids, nulls, place, index, low, high, block = _joined(rows, columns)
            full = np.ascontiguousarray(np.concatenate([text, low[:, None], high[:, None]], axis=1))
            first = np.unique(full.view(f"V{full.shape[1]}").reshape(-1), return_index=True)[1]
            again = np.ones(len(text), bool)
            again[first] = False
            offsets = np.arange(shape.back + 1)
            flags = again[:, None] & (offsets >= low[:, None]) & (offsets <= high[:, None])
            out = [(b, n, None, payload, -1) for b, n, payload, *_ in _flagged(block, index, flags)]
            for b in np.unique(block[first]):
                own = first[block[first] == b]
                out.append((int(b), len(own), rows[0]["bucket"], _pack(*(c[own] for c in (text, ids, nulls, place, index, low, high))), 0))
            yield _batch(out, f"{_DEALT}, o int")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            bucket = rows[0]["bucket"]
            text, ids, nulls, place, index, low, high, block = _joined(rows, columns)
            borders = [held.value[k] if 0 <= k < len(held.value) else None for k in (bucket - 1, bucket)]
            flags, undecided = compare(text, low, high, borders, shape)
            out = _flagged(block, index, flags)
            for i, o in undecided:
                string = text[i, length : length + o][::-1].tobytes() + text[i, : length - o].tobytes()
                out.append((int(block[i]), int(index[i]), None, o, string, None if nulls[i] else int(ids[i]), int(place[i]) - o))
            yield _batch(out, _MATCHED)

    dealt = written(suffixes.select("block", "n", "payload").mapInArrow(deal, _DEALT), "dealt")
    sizes = dealt.groupBy("bucket").agg(F.sum("n").alias("of")).filter(F.col("of") > most)
    hot = written(sizes.select(F.col("bucket").alias("hot"), F.ceil(F.col("of") / most).cast("int").alias("parts")), "hot")
    repeated = None
    if not hot.isEmpty():
        split = dealt.join(hot, F.col("bucket") == F.col("hot")).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
        split = split.select("block", "n", "bucket", "payload", "part").repartition(n_tasks, "bucket", "part").sortWithinPartitions("bucket", "part")
        reduced = written(split.mapInArrow(reduce, f"{_DEALT}, o int"), "reduced")
        repeated = reduced.filter("o < 0").select("block", "n", "payload")
        cool = dealt.join(hot, F.col("bucket") == F.col("hot"), "left_anti")
        dealt = cool.unionByName(reduced.filter("o = 0").drop("o"))
    matched = written(dealt.repartition(n_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(match, _MATCHED), "matched")
    # of a string that stands at borders of buckets, all but the earliest are repeats
    open_ = matched.filter(F.col("string").isNotNull()).select("string", F.struct(F.col("id").isNull().alias("last"), "id", "start", "block", "n", "o").alias("at"))
    first = written(open_.groupBy("string").agg(F.min("at").alias("first")), "firsts")
    across = open_.join(first, "string").filter(F.col("at") > F.col("first")).select("at.block", "at.n", "at.o")
    pairs = across.groupBy("block").agg(F.collect_list(F.struct("n", "o")).alias("p")).select("block", F.lit(2).alias("kind"), F.lit(0).alias("bucket"), F.to_json("p").cast("binary").alias("payload"))
    flagged = matched.filter(F.col("payload").isNotNull()).select("block", "n", "payload")
    inner = (flagged if repeated is None else flagged.unionByName(repeated)).select("block", F.lit(1).alias("kind"), F.col("n").alias("bucket"), "payload")
    notes = written(told.select("block", "kind", "bucket", "payload").unionByName(inner).unionByName(pairs), "notes")

    def removed(t: Block, notes: list) -> np.ndarray:
        """True for each byte of the block that goes."""
        import json

        chosen, _, anchor, row = collapse(t, notes)
        flags = np.zeros((len(anchor), shape.back + 1), bool)
        for x in notes:
            if x["kind"] == 1:
                index, bits = _unpack(x["payload"], x["bucket"], ("u4", 1), ("u1", -(-(shape.back + 1) // 8)))
                flags[index] |= np.unpackbits(bits.reshape(len(index), -1), axis=1)[:, : shape.back + 1].astype(bool)
            elif x["kind"] == 2:
                for p in json.loads(x["payload"]):
                    flags[p["n"], p["o"]] = True
        copy = np.ones(len(chosen), bool)
        at = np.searchsorted(chosen, anchor)
        copy[at] = False
        offsets = np.arange(shape.back + 1)
        inside = (offsets >= t.low[chosen][:, None]) & (offsets <= t.high[chosen][:, None])
        gone = np.where(copy[:, None], inside, flags[row])
        i, o = np.nonzero(gone)
        begin = t.place[chosen[i]] - offsets[o]
        n = len(t.data)
        cover = np.bincount(begin, minlength=n + 1) - np.bincount(begin + shape.length, minlength=n + 1)
        return np.cumsum(cover[:n]) > 0

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, notes in _opened(batches, shape):
            gone = removed(t, notes)
            ids, n_bytes, spans, kept = [], [], [], []
            for doc_id, null, lo, hi in zip(t.ids.tolist(), t.nulls.tolist(), t.starts.tolist(), (t.starts + t.sizes).tolist(), strict=True):
                ids.append(None if null else doc_id)
                n_bytes.append(hi - lo)
                spans.append(marked(gone[lo:hi]))
                kept.append(t.data[lo:hi][~gone[lo:hi]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, notes in _opened(batches, shape):
            own = t.data[:block_bytes].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([t.row], pa.int64()), pa.array([t.base], pa.int64()), pa.array([None if t.nulls[0] else int(t.ids[0])], pa.int64()), pa.array([marked(removed(t, notes))], _SPANS), pa.array([own], pa.binary())],
                names=["row", "base", "doc_id", "spans", "own"],
            )

    def whole(group: pa.Table) -> pa.Table:
        """One row of the parts of a text."""
        group = group.sort_by("base")
        data = np.frombuffer(b"".join(group.column("own").to_pylist()), np.uint8)
        gone = np.zeros(len(data), bool)
        for base, spans in zip(group.column("base").to_pylist(), group.column("spans").to_pylist(), strict=True):
            for s in spans:
                gone[base + s["start"] : base + s["stop"]] = True
        kept = pa.array([data[~gone].tobytes()], pa.binary())
        return pa.Table.from_arrays([group.column("doc_id")[:1].combine_chunks(), pa.array([len(data)], pa.int64()), pa.array([marked(gone)], _SPANS), kept], names=["doc_id", "n_bytes", "spans", "kept"])

    short, long = (_with_notes(blocks.filter(side), notes.filter(side)) for side in ("block >= 0", "block < 0"))
    return short.mapInArrow(texts, _KEPT).unionByName(long.mapInArrow(parts, _PARTS).groupBy("row").applyInArrow(whole, _KEPT))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what repeats() gave."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
