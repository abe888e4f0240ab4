"""SimHash near-duplicates: fingerprints compared in bit slices inside buckets that miss no pair.

Two fingerprints that differ in at most r of 64 bits agree on m - r of any m blocks the bits are cut into: a
fingerprint goes to one bucket for each choice of m - r blocks. In a bucket, bit planes are stored vertically (bit j of
all fingerprints side by side in machine words), and carry-save counters add up many distances at a time, leaving
blocks of lanes as soon as all of them exceed r. A bucket above `tile` fingerprints is cut into parts that meet two by
two in different tasks; a task returns a star for each component that it finds, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import partitions, written
from .token_ids import as_bytes, slices

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles of `width` words; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(b" ".join(words), seed)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
        hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.uint32).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def blocks_for(n: int, radius: int) -> int:
    """Blocks to cut 64 bits into, so that n even fingerprints leave about 256 in a bucket at most."""
    m = radius + 1
    while m < radius + 4 and n > 256 << (64 * (m - radius) // m):
        m += 1
    return m


def bucket_keys(fp: Column, radius: int, m: int) -> Column:
    """The array of a fingerprint's bucket keys, one for each choice of m - radius blocks."""
    edges = [64 * i // m for i in range(m + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(range(m), m - radius)):
        keys.append(F.xxhash64(F.lit(k), *(part[i] for i in chosen)) if len(chosen) > 1 else F.shiftleft(F.lit(k).cast("bigint"), 32).bitwiseOR(part[chosen[0]]))
    return F.array(*keys)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit k of word w of plane j is bit j (from the highest) of fingerprint 64 w + k."""
    lanes = np.zeros(-(-len(fps) // 64) * 64, ">u8")
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(left: list[np.ndarray], right: list[np.ndarray], radius: int, every: int = 8) -> np.ndarray:
    """Words whose bits are 1 where the lanes' distance is at most radius.

    left, right: 64 planes each, of shapes that broadcast to (rows, words). counters[i] holds bit i of all distances;
    a lane that passes 2^len - 1 stays in `over`. Every few planes, words whose lanes are all out are left behind.
    """
    bits = radius.bit_length()
    shape = np.broadcast_shapes(left[0].shape, right[0].shape)
    flat = [np.broadcast_to(x, shape).reshape(-1) if x.shape != shape else x.reshape(-1) for x in (left[0], right[0])]
    counters, over = [np.zeros(flat[0].size, "<u8") for _ in range(bits)], np.zeros(flat[0].size, "<u8")
    live = None
    for j in range(64):
        a, b = (np.broadcast_to(x[j], shape).reshape(-1) for x in (left, right))
        carry = (a ^ b) if live is None else (a[live] ^ b[live])
        for i in range(bits):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if j % every == every - 1 and j >= 15:
            high = over.copy() if radius == (1 << bits) - 1 else over | _above(counters, radius)
            stay = high != _ALL
            if not stay.any():
                return np.zeros(shape, "<u8")
            if stay.mean() < 0.7:
                live = np.flatnonzero(stay) if live is None else live[stay]
                counters, over = [c[stay] for c in counters], over[stay]
    near = ~(over | _above(counters, radius))
    if live is None:
        return near.reshape(shape)
    out = np.zeros(flat[0].size, "<u8")
    out[live] = near
    return out.reshape(shape)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """1 where the counters' number exceeds radius."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            more, same = more | (same & counters[i]), same & ~counters[i]
    return more


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least item of each of n items' component, given pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_small(fps: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """The least near item for each item, of many small groups at once: fps sorted by group; item i meets i + s."""
    i_all, j_all, at = [], [], np.arange(len(fps))
    s = 1
    while True:
        at = at[at + s < len(fps)]
        at = at[group[at] == group[at + s]]
        if not len(at):
            break
        near = within(list(bit_planes(fps[at])), list(bit_planes(fps[at + s])), radius)
        hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(at)])
        i_all.append(at[hit])
        j_all.append(at[hit] + s)
        s += 1
    if not i_all:
        return np.arange(len(fps))
    return _labels(len(fps), np.concatenate(i_all), np.concatenate(j_all))


def link_large(fps: np.ndarray, side: np.ndarray, cross: bool, radius: int, rows: int = 64) -> np.ndarray:
    """The least item of each item's component in one large group; with cross, sides 0 and 1 meet, else all."""
    n, lanes = len(fps), np.arange(len(fps))
    queries = np.flatnonzero(side == 0) if cross else lanes
    targets = np.flatnonzero(side == 1) if cross else lanes
    planes = bit_planes(fps[targets])[:, None, :]
    label = lanes.copy()
    for k in range(0, len(queries), rows):
        q = queries[k : k + rows]
        own = np.unpackbits(fps[q].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
        near = within([np.where(b, _ALL, np.uint64(0))[:, None] for b in own], list(planes), radius)
        hits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(targets)]
        r, c = np.nonzero(hits)
        label = _labels(n, np.concatenate([q[r], lanes]), np.concatenate([targets[c], label]))
    return label


def links(fps: DataFrame, radius: int = 3, tile: int = 1024, small: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span all links of distance <= radius."""
    spark, m = fps.sparkSession, blocks_for(fps.count(), radius)
    spread = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius, m)).alias("key"))
    hot = written(spread.groupBy("key").count().filter(F.col("count") > tile).select(F.col("key").alias("hot"), F.ceil(F.col("count") / tile).cast("int").alias("parts")), "hot")
    cut = spread.join(hot, F.col("key") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own > o).cast("int").alias("side")))
    dealt = cut.select("fp", "key", F.explode(meets).alias("t")).select("fp", "key", "t.x", "t.y", "t.side")
    dealt = dealt.repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: np.ndarray) -> pa.RecordBatch:
            signed, key, x, y, side = cols
            ids = np.unique(np.stack([key, x, y]), axis=1, return_inverse=True)[1].reshape(-1) if len(key) else key
            fps, sizes = signed.view(np.uint64), np.bincount(ids) if len(ids) else np.zeros(0, int)
            a, b = [], []
            few = np.flatnonzero(sizes[ids] <= small) if len(ids) else ids
            few = few[np.argsort(ids[few], kind="stable")]
            if len(few):
                label = link_small(fps[few], ids[few], radius)
                a.append(signed[few])
                b.append(signed[few][label])
            for g in np.flatnonzero(sizes > small):
                rows = np.flatnonzero(ids == g)
                label = link_large(fps[rows], side[rows], bool(x[rows[0]] != y[rows[0]]), radius)
                a.append(signed[rows])
                b.append(signed[rows][label])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            same = (held[1:4] == held[1:4, -1:]).all(axis=0)
            whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # rows before the last group
            if whole:
                yield found(held[:, :whole])
                held = held[:, whole:]
        yield found(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (long) and component_id, the smallest doc_id that links lead to.

    docs needs doc_id and text; other columns are ignored. Fingerprints at `radius` or fewer differing bits are linked,
    and so are their documents; null and empty texts have fingerprint 0 and are linked like any other. Equal
    fingerprints are compared once, however many rows have them. A null doc_id never names a component unless it holds
    no other. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(links(nodes.select("fp"), radius))
    named = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = written(named, "named")
    of = written(named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id"), "smallest")
    placed = written(named.join(of, F.col("root") == F.col("r")).select(F.col("fp").alias("of_fp"), "component_id"), "placed")
    return rows.join(placed, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")
