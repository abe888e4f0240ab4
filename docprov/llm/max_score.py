"""Exact top-k inner products by MaxScore.

Every dimension is two terms, one for each sign; a term's postings are the vectors of that sign there. For a query,
terms of the same sign add at most |q| times the largest weight of their postings (their bound), terms of the other sign
add nothing or less (bound 0). With a threshold that k vectors have reached, the terms of the smallest bounds, whose
sum stays below the threshold, are non-essential: a vector that is in none of the essential postings can't be among the
best. Essential postings are traversed; what was found is probed in the other terms, by falling bounds, while it can still
reach the threshold. Shards of vectors meet blocks of queries, and the shards' best are merged.

A query's first threshold holds for all shards: the k-th best of the champions, the few vectors that are strongest in some
term. Shards whose bounds don't reach it are left at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written


class Shard:
    """Signed postings of up to some thousand integer vectors (rows of values)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        n, dims = self.values.shape
        self.postings, self.most, self.strong = {}, {}, {}
        for d in range(dims):
            column = self.values[:, d]
            for sign in (1, -1):
                at = np.flatnonzero(column * sign > 0)
                weights = column[at] * sign
                self.postings[d, sign] = (at, weights)
                self.most[d, sign] = int(weights.max()) if len(at) else 0
                self.strong[d, sign] = at[np.argsort(-weights, kind="stable")[:32]]

    def top(self, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors of another id, by score, then by smaller id; those below floor are left out."""
        n = len(self.ids)
        mine = self.ids == own
        terms = sorted(((abs(int(w)) * self.most[d, s], d, s, abs(int(w))) for d, w in enumerate(q) if w for s in (1 if w > 0 else -1,)), reverse=True)
        if floor is not None and floor > 0 and sum(t[0] for t in terms) < floor:
            return self.ids[:0], self.ids[:0]
        # the threshold: the k-th best of vectors that are strong where the query is
        seed = np.unique(np.concatenate([self.strong[d, s] for _, d, s, _ in terms[:4]] or [np.zeros(0, np.int64)]))
        seed = seed[~mine[seed]]
        first = np.sort(self.values[seed] @ q)[::-1] if len(seed) else np.zeros(0, np.int64)
        least = int(first[k - 1]) if len(first) >= k else None
        least = floor if least is None or (floor is not None and floor > least) else least
        if least is None or least <= 0:  # nothing, or a vector without common terms, may be among the best
            found = np.flatnonzero(~mine)
            scores = self.values[found] @ q
            if floor is not None:
                found, scores = found[scores >= floor], scores[scores >= floor]
        else:
            rest, cut = 0, len(terms)
            while cut and rest + terms[cut - 1][0] < least:
                cut -= 1
                rest += terms[cut][0]
            acc, seen = np.zeros(n, np.int64), np.zeros(n, bool)
            for _, d, s, w in terms[:cut]:
                at, weights = self.postings[d, s]
                acc[at] += w * weights
                seen[at] = True
            found = np.flatnonzero(seen & ~mine & (acc + rest >= least))
            scores = acc[found]
            for bound, d, s, w in terms[cut:]:
                scores = scores + w * np.maximum(self.values[found, d] * s, 0)
                rest -= bound
                stay = scores + rest >= least
                found, scores = found[stay], scores[stay]
            for _, d, s, w in terms:  # bound 0: the other sign takes away
                scores = scores + w * np.minimum(self.values[found, d] * s, 0)
                stay = scores >= least
                if not stay.all():
                    found, scores = found[stay], scores[stay]
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def usable(v: Column) -> Column:
    """True for a vector without nulls and non-finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v (array of bigint, floor(scale * x)) of the rows that take part."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select("vec_id", wide.alias("e")).filter(F.col("vec_id").isNotNull() & usable(F.col("e"))).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), dims), np.int64)
    at = np.repeat(np.arange(len(rows)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _strongest(ids: np.ndarray, values: np.ndarray, each: int) -> np.ndarray:
    """Rows that are among the `each` strongest of some term."""
    picked = [np.zeros(0, np.int64)]
    for d in range(values.shape[1]):
        for sign in (1, -1):
            w = values[:, d] * sign
            at = np.flatnonzero(w > 0)
            picked.append(at if len(at) <= each else at[np.argpartition(-w[at], each)[:each]])
    return np.unique(np.concatenate(picked))


def champions(rows: DataFrame, each: int = 32) -> DataFrame:
    """vec_id and v of the vectors that are strongest in some term: `each` for each, so that their number is bounded by the
    dimensions. Every task reduces its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            dims = max((v.shape[1] for _, v in held), default=0)
            ids = np.concatenate([i for i, _ in held])
            values = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for _, v in held])
            stay = _strongest(ids, values, each)
            return ids[stay], values[stay]

        for b in batches:
            t = pa.Table.from_batches([b])
            lists = t.column("v").combine_chunks()
            if t.num_rows:
                held.append((t.column("vec_id").to_numpy(), _matrix(t.column("v"), int(lists.value_lengths().to_numpy(zero_copy_only=False).max()))))
                held = [reduced()]
        if held:
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(held[0][0]), "v": pa.array(held[0][1].tolist(), pa.list_(pa.int64()))})

    some = rows.mapInArrow(run, "vec_id long, v array<long>").distinct()
    terms = some.select("vec_id", "v", F.posexplode("v").alias("d", "w")).filter("w <> 0")
    place = F.row_number().over(Window.partitionBy("d", F.col("w") > 0).orderBy(F.desc(F.abs("w")), "vec_id"))
    return terms.withColumn("place", place).filter(F.col("place") <= each).select("vec_id", "v").distinct()


def champions_each(n: int, dims: int, most_bytes: int = 64 << 20) -> int:
    """How many champions a term has: 32, but all of them no more than a sixteenth of n vectors (one for each term at least) and no
    more than most_bytes, as they go through the driver; 0 where dims are too many for that."""
    if not dims or 2 * dims * dims * 8 > most_bytes:
        return 0
    return min(32, max(1, n // (32 * dims)), most_bytes // (2 * dims * dims * 8))


def with_floors(queries: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """queries with floor: the k-th best score of the champions of another id, null if there are fewer."""
    t = best.toArrow()  # at most champions_each() * 2 * dimensions rows, of bounded bytes
    dims = int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) if t.num_rows else 0
    held = queries.sparkSession.sparkContext.broadcast((t.column("vec_id").to_numpy(), _matrix(t.column("v"), dims) if t.num_rows else np.zeros((0, 0), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = held.value
        for b in batches:
            t = pa.Table.from_batches([b])
            floors: list = [None] * t.num_rows
            if len(ids) >= k and t.num_rows:
                longest = int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max())
                q = _matrix(t.column("v"), max(longest, values.shape[1]))[:, : values.shape[1]]
                for i, own in enumerate(t.column("vec_id").to_pylist()):
                    scores = (values @ q[i])[ids != own]
                    if len(scores) >= k:
                        floors[i] = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(floors, pa.int64())], names=["vec_id", "v", "floor"])

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, floor long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 65536, block_rows: int = 32768) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of the k best vectors for each query.

    vectors needs vec_id and embedding; other columns are ignored. Queries are the rows whose vec_id is divisible by
    `every`; candidates are all rows of another vec_id. Vectors that are null or hold a null or non-finite component,
    and rows whose vec_id is null, take no part. Vectors of unequal length meet as if zeros followed the shorter. Rows that
    repeat a vec_id are candidates each; as queries, those that repeat the vector too are one. Ties go to the smaller
    vec_id. Scores must fit 64 bits. An empty table gives no rows. A task holds a shard and a block of queries; the work is
    queries times vectors, as the question is, and what moves is that divided by the size of a shard or block.
    """
    rows = written(quantised(vectors, scale), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries, each = queries.count(), champions_each(n, dims)
    blocks = max(1, math.ceil(n_queries / block_rows))
    shards = max(1, math.ceil(n / shard_rows), min(partitions(vectors.sparkSession) // blocks, math.ceil(n / 4096)))  # few rows: for all cores
    key = F.xxhash64("vec_id", "v")
    asked = with_floors(queries, written(champions(rows, each), "champions") if each else rows.limit(0), k).withColumn("query", key).withColumn("block", F.pmod("query", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if q.num_rows and v.num_rows:
            dims = max(int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (q, v))
            shard = Shard(v.column("vec_id").to_numpy(), _matrix(v.column("v"), dims))
            asking = (q.column(c).to_pylist() for c in ("vec_id", "query", "floor"))
            for own, query, floor, vector in zip(*asking, _matrix(q.column("v"), dims), strict=True):
                ids, scores = shard.top(own, vector, k, floor)
                for c, x in zip(out, ([query] * len(ids), [own] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                    c.extend(x)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query", "query_id", "vec_id", "score"), out, strict=True)})

    found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, "query long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
