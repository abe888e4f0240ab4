"""Near copies by the exact Jaccard similarity of word shingles.

SimHash names the first candidates: a row and the one that its fingerprints' links lead to. Three bits stand for a similarity of
about 0.98, so MinHash bands name those between: a text's 60 least hashes are cut into 20 bands of 3, and texts that share a band meet
in its bucket. A pair at similarity s shares none with probability (1 - s^3)^20, 6e-7 at 0.8. Every row is first held
against one row of each of its buckets; after that only rows of a bucket that are not yet linked to each other are compared,
in the task that holds the bucket with their shingles: pairs whose least hashes agree in under half of the places are left
out (1e-8 at 0.8), each pair is taken in its first common bucket only, and a task returns links that join groups, never all
pairs. What links is always verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import partitions, text_or_empty, written
from .token_ids import slices

BANDS, ROWS = 20, 3
_draw = np.random.default_rng(7)
_MIX = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of the shingles of `width` words, sorted; a shorter text is one shingle."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(line, seed), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def least_hashes(hashes: np.ndarray, each: int = 1024) -> np.ndarray:
    """For each of 60 orders the least of hashes."""
    parts = [((hashes[k : k + each, None] ^ _MIX) * _TIMES).min(axis=0) for k in range(0, len(hashes), each)]
    return np.min(parts, axis=0)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """id, doc_id, sig (a byte of each least hash) and keys (of the bands) of every row of docs (id, doc_id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            sigs, keys = [], []
            for t in b.column("text").to_pylist():
                low = least_hashes(shingles(t, width))
                sigs.append((low >> np.uint64(24)).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)])
            cols = [b.column("id"), b.column("doc_id"), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "doc_id", "sig", "keys"])

    return docs.mapInArrow(run, "id long, doc_id long, sig binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts' similarity is at least `least`; texts: id, text as bytes, an id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def of(key: int, text: bytes) -> np.ndarray:
            if key not in known:
                if len(known) >= 1000:
                    known.clear()
                known[key] = shingles(text, width)
            return known[key]

        for b in slices(batches, name="ta"):
            a, z, ta, tz = (b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            good = [jaccard(of(i, x), of(j, y)) >= least for i, j, x, y in zip(a, z, ta, tz, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs, "pairs")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return written(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "verified")


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """id and set (the sorted hashes of the shingles, as bytes) of every row of texts (id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, width).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def _linked(nums: np.ndarray, sig: np.ndarray, keys: np.ndarray, sets: list[bytes], least: float, agree: int) -> tuple[list, list]:
    """Links among the rows of one tile, of x, y, side, band, id, comp: one for each two groups that a pair joins."""
    x, y, side, band, ids, comp = nums.T
    label, a, b, known = comp.copy(), [], [], {}

    def of(i: int) -> np.ndarray:
        if i not in known:
            known[i] = np.frombuffer(sets[i], np.uint64)
        return known[i]

    sizes = np.array([len(s) for s in sets], np.int64)
    for i in range(len(nums) - 1):
        fit = np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (x[i] == y[i]))) + i + 1
        fit = fit[np.minimum(sizes[fit], sizes[i]) >= least * np.maximum(sizes[fit], sizes[i])]
        fit = fit[(sig[fit] == sig[i]).sum(axis=1) >= agree]
        fit = fit[np.argmax(keys[fit] == keys[i], axis=1) == band[i]]
        for j in fit.tolist():
            if label[j] != label[i] and jaccard(of(i), of(j)) >= least:
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                label[label == label[j]] = label[i]
    return a, b


def open_links(rows: DataFrame, sets: DataFrame, least: float, tile: int = 512, agree: int = BANDS * ROWS // 2) -> DataFrame:
    """Verified links (a, b) among rows (key, band, id, comp, sig, keys) that share a key and are of different comp; sets: id, set.

    What they lead to is what all such pairs would. A bucket above `tile` rows is cut into parts that meet two by two in
    different tasks.
    """
    spread = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
    open_ = written(spread.select(F.col("key").alias("of"), F.ceil(F.col("n") / tile).cast("int").alias("parts")), "open")
    cut = written(rows.join(open_, F.col("key") == F.col("of")).drop("of"), "cut")
    full = cut.join(sets.select(F.col("id").alias("of"), "set"), F.col("id") == F.col("of"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), (own > o).cast("int").alias("side")))
    dealt = full.select("key", "band", "id", "comp", "sig", "keys", "set", F.explode(meets).alias("t")).select("key", "t.x", "t.y", "t.side", "band", "id", "comp", "sig", "keys", "set")
    dealt = dealt.repartition(partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nums, sig, keys, sets = np.zeros((0, 7), np.int64), np.zeros((0, BANDS * ROWS), np.uint8), np.zeros((0, BANDS), np.int64), []

        def found(lo: int, hi: int) -> pa.RecordBatch:
            a, b = _linked(nums[lo:hi, 1:], sig[lo:hi], keys[lo:hi], sets[lo:hi], least, agree)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for whole in batches:
            for batch in slices(iter([whole]), name="set"):
                nums = np.concatenate([nums, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)])
                sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)])
                keys = np.concatenate([keys, batch.column(8).flatten().to_numpy().reshape(-1, BANDS)])
                sets += batch.column(9).to_pylist()
                edges = [0, *(np.flatnonzero((nums[1:, :3] != nums[:-1, :3]).any(axis=1)) + 1).tolist()]
                for lo, hi in zip(edges, edges[1:], strict=False):  # all tiles but the last are whole
                    yield found(lo, hi)
                nums, sig, keys, sets = nums[edges[-1] :], sig[edges[-1] :], keys[edges[-1] :], sets[edges[-1] :]
        if len(nums):
            yield found(0, len(nums))

    return dealt.mapInArrow(run, "a long, b long")


def superfluous(docs: DataFrame, number: str, least: float = 0.8, width: int = 5) -> DataFrame:
    """id (of the column `number`) of every row but one of each group of near copies; the smallest doc_id (null last) stays, of
    equal ones the smallest number.

    docs needs doc_id, text and a column of different longs. Rows whose shingles have a Jaccard similarity of `least` or more
    are linked, groups are what links lead to. Rows without words, null and empty texts among them, are alike. Rows that repeat others
    are a group; other columns are ignored. A long text is held whole by one task, with 8 bytes for each of its shingles. An empty
    table gives no rows.
    """
    base = docs.select(F.col(number).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    nodes = written(signatures(base, width), "signatures")
    spread = nodes.select("id", "sig", "keys", F.posexplode("keys").alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("id", "key").alias("h"), F.col("id").alias("leader")))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n"), first.alias("f")).filter("n > 1")
    buckets = written(buckets.select(F.col("key").alias("of"), F.col("f.leader").alias("leader")), "buckets")
    met = written(spread.join(buckets, F.col("key") == F.col("of")).select("key", "band", "id", "leader", "sig", "keys"), "met")
    printed = simhash.near_duplicates(docs.select(F.col(number).alias("doc_id"), "text"), width=width)
    printed = written(printed.filter("doc_id <> component_id").select("doc_id", "component_id"), "printed")
    needed = met.select("id").union(printed.select("doc_id")).union(printed.select("component_id")).distinct().select(F.col("id").alias("_met"))
    texts = written(base.join(needed, F.col("id") == F.col("_met"), "left_semi").select("id", "text"), "texts")

    others = met.filter("id <> leader")
    pairs = others.select("id", "leader").union(printed)
    edges = verified(pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), texts, least, width)
    linked = components(edges)
    rows = others.join(linked, F.col("id") == F.col("node"), "left").select("key", "band", "id", F.coalesce("component", "id").alias("comp"), "sig", "keys")
    more = open_links(written(rows, "apart"), written(shingle_sets(texts, width), "sets"), least)
    linked = components(more.union(linked.select("node", "component")))

    own = linked.select("component").distinct().select(F.col("component").alias("node"), "component")
    of = written(linked.select("node", "component").union(own), "members")
    ids = nodes.select("id", "doc_id").join(of, F.col("id") == F.col("node")).select("id", "doc_id", "component")
    ids = written(ids, "ids")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("id").alias("best")))
    best = written(ids.groupBy(F.col("component").alias("c")).agg(best.alias("f")).select("c", "f.best"), "best")
    return ids.join(best, F.col("component") == F.col("c")).filter("id <> best").select("id")
