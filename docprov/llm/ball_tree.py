"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector of whole numbers, the value of each term that some query asks for; a query is a vector of ones, and a
score is their inner product. Each task puts its documents into trees: a node has a centroid and the radius of the ball around it
that holds the node's documents. No document of a node scores above q . centroid + |q| radius, |q| being taken over the terms
that the node has at all; these figures are doubles, and each is rounded up by more than it can be wrong. A query goes down the
node of the highest bound first, and leaves what remains when that bound lies below its k-th best score. Leaves are scored
in 64-bit whole numbers. The best of all trees are merged.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docprov.functions.workers import ship

from .shared import written
from .token_ids import slices

#: Letters and digits of ASCII, and whatever is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_ULP = 2.0**-52


class Rows:
    """Sparse rows of whole numbers: row i has values[at[i]:at[i + 1]] in the terms ids[at[i]:at[i + 1]], each term once."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        self.at, self.ids, self.values = at, ids, values

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.at[rows + 1] - self.at[rows]
        at = np.concatenate(([0], np.cumsum(sizes)))
        inside = np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], sizes)
        return Rows(at, self.ids[inside], self.values[inside])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Of each row with dense; whole numbers stay such. A row has one term at least."""
        return np.add.reduceat(self.values * dense[self.ids], self.at[:-1])


def ball(rows: Rows, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(terms, their values in the centroid, radius) of rows; dense: zeros for every term, and zeros again afterwards.

    |d - c|^2 is the sum of (d - c)^2 - c^2 over the terms of d, and |c|^2. Its error is below the number of additions times the sum
    of absolute values times a rounding unit, and so much is added.
    """
    terms, place = np.unique(rows.ids, return_inverse=True)
    values = rows.values.astype(np.float64)
    mean = np.bincount(place, values, len(terms)) / len(rows)
    own = mean[place]
    sizes = np.diff(rows.at)
    norm = float(mean @ mean)
    squares = np.add.reduceat((values - own) ** 2 - own * own, rows.at[:-1]) + norm
    absolute = np.add.reduceat((values - own) ** 2 + own * own, rows.at[:-1]) + norm
    most = float(np.max(squares + absolute * ((sizes + len(terms) + 16) * (2 * _ULP))))
    return terms, mean, math.sqrt(max(most, 0.0)) * (1 + 4 * _ULP)


class Tree:
    """A ball tree over sparse rows. Children of a node stand behind it; leaves hold up to `leaf` rows."""

    def __init__(self, rows: Rows, names: np.ndarray, terms: int, leaf: int = 96) -> None:
        dense, order, self.nodes = np.zeros(terms), [], []
        todo = [(np.arange(len(rows)), -1)]
        while todo:
            own, parent = todo.pop()
            part = rows.take(own)
            node = [*ball(part, dense), None, None, 0, 0]  # and two children, or a range of rows
            if parent >= 0:
                self.nodes[parent][3 if self.nodes[parent][3] is None else 4] = len(self.nodes)
            if len(own) > leaf:
                axis = self._axis(part, node, dense)
                side = np.argsort(axis, kind="stable")
                at = self._split(axis[side])
                todo += [(own[side[:at]], len(self.nodes)), (own[side[at:]], len(self.nodes))]
            else:
                node[5], node[6] = len(order), len(order) + len(own)
                order.extend(own.tolist())
            self.nodes.append(node)
        order = np.array(order, np.int64)
        self.rows, self.names = rows.take(order), names[order]

    @staticmethod
    def _split(places: np.ndarray) -> int:
        """Where ascending places are divided: at their widest gap if that is an eighth of all, else in the middle. Either side gets a
        sixteenth at least, so that the tree's depth grows with the logarithm of its rows."""
        least = max(1, len(places) // 16)
        gaps = np.diff(places[least - 1 : len(places) - least + 1])
        k = int(np.argmax(gaps))
        return least + k if gaps[k] * 8 > places[-1] - places[0] else len(places) // 2

    @staticmethod
    def _axis(part: Rows, node: list, dense: np.ndarray) -> np.ndarray:
        """Places of rows between two of them that are far from each other."""
        squares = np.add.reduceat(part.values.astype(np.float64) ** 2, part.at[:-1])

        def farthest(terms: np.ndarray, values: np.ndarray) -> int:
            dense[terms] = values
            k = int(np.argmax(squares - 2 * part.dot(dense)))
            dense[terms] = 0
            return k

        def row(k: int) -> tuple[np.ndarray, np.ndarray]:
            s = slice(part.at[k], part.at[k + 1])
            return part.ids[s], part.values[s].astype(np.float64)

        a = farthest(node[0], node[1])
        b = farthest(*row(a))
        dense[row(a)[0]] += row(a)[1]
        dense[row(b)[0]] -= row(b)[1]
        place = part.dot(dense)
        dense[row(a)[0]] = 0
        dense[row(b)[0]] = 0
        return place

    def bound(self, k: int, asked: np.ndarray) -> int:
        """No row below node k scores above this."""
        terms, mean, radius = self.nodes[k][:3]
        at = np.searchsorted(terms, asked)
        at = at[terms[np.minimum(at, len(terms) - 1)] == asked]
        own = float(mean[at].sum()) * (1 + (len(at) + 4) * _ULP)
        return math.floor((own + radius * math.sqrt(len(at)) * (1 + 4 * _ULP)) * (1 + 4 * _ULP))

    def search(self, asked: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, one: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """(best, leaves scored): the k best (scores, names) of best and of this tree, by score, then by name ((1 for null, doc_id), smaller first).

        asked: the query's terms, ascending. one: zeros for every term, and zeros again afterwards.
        """
        scores, names = best
        heap, leaves = [(-self.bound(0, asked), 0)], 0
        one[asked] = 1
        while heap:
            bound, node = heapq.heappop(heap)
            least = int(scores[-1]) if len(scores) == k else 1
            if -bound < least:
                break
            _, _, _, left, right, start, stop = self.nodes[node]
            if left is not None:
                for child in (left, right):
                    b = self.bound(child, asked)
                    if b >= least:
                        heapq.heappush(heap, (-b, child))
                continue
            leaves += 1
            at = self.rows.at[start : stop + 1]
            ids, values = self.rows.ids[at[0] : at[-1]], self.rows.values[at[0] : at[-1]]
            got = np.add.reduceat(values * one[ids], at[:-1] - at[0])
            stay = got >= least
            if stay.any():
                scores, names = np.concatenate((scores, got[stay])), np.concatenate((names, self.names[start:stop][stay]))
                first = np.lexsort((names[:, 1], names[:, 0], -scores))[:k]
                scores, names = scores[first], names[first]
        one[asked] = 0
        return (scores, names), leaves


def terms_of(text: Column) -> Column:
    """The terms of a text: only A-Z are lower-cased."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+"), F.lit(0))


def asked_in_blocks(items: DataFrame, most: int = 16 << 20) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items (item_id, terms) in blocks of about `most` bytes of terms: what the driver holds and broadcasts at a time is one
    block. Rows that repeat an item_id are one item, of all their terms."""
    each = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("t")).groupBy("item_id").agg(F.sort_array(F.collect_set("t")).alias("terms"))
    block, size = [], 0
    for r in written(each, "items").toLocalIterator():
        block.append((r["item_id"], r["terms"]))
        size += sum(len(t) + 64 for t in r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


_VECTORS = "doc_id long, n long, ids binary, counts binary"


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written table of doc_id, n (all its terms, with repeats), and ids and counts (binary, 32 bits) of those in vocabulary, for
    every document with a term."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = TERM.findall(text.lower())
                if found:
                    own = [(known[t], c) for t, c in Counter(found).items() if t in known]
                    rows.append((doc_id, len(found), np.array([x for x, _ in own], "<u4").tobytes(), np.array([c for _, c in own], "<u4").tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "ids", "counts"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(texts.mapInArrow(run, _VECTORS), "vectors")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many rows each of `size` terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                counts[np.frombuffer(ids.as_buffer(), "<u4")] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "df"])

    found = rows.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("id").to_numpy()] = found.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _weighted(b: pa.RecordBatch, w: np.ndarray, n: int, total: int) -> tuple[np.ndarray, Rows]:
    """(places in the batch, rows) of the documents that have a value above 0."""
    ids, counts = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("ids", "counts"))
    sizes = np.array([len(x.as_buffer()) // 4 for x in b.column("ids")], np.int64)
    row = np.repeat(np.arange(b.num_rows), sizes)
    length = 50 + (50 * b.column("n").to_numpy() * n) // total
    values = w[ids] * ((1_000_000_000 * counts) // (1000 * counts + 20 * length[row]))
    some = values > 0
    present, sizes = np.unique(row[some], return_counts=True)
    return present, Rows(np.concatenate(([0], np.cumsum(sizes))), ids[some], values[some])


def _names(column: pa.Array) -> np.ndarray:
    """(1 for null, doc_id) of each row: null ones are behind all others."""
    return np.stack((column.is_null().to_numpy(zero_copy_only=False).astype(np.int64), column.fill_null(0).to_numpy(zero_copy_only=False)), 1)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, tree_values: int = 1 << 21, parts: int = 256) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long) of the k best documents of each item, of those with a score above 0.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Null and empty texts have no terms: as
    documents they take no part nor count, as items they have no rows. Equal scores go to the smaller doc_id, null last. Rows that
    repeat a doc_id are documents each; those that repeat an item_id are one item. No documents or no items give no rows.

    Items are taken in blocks of bounded size, each against all documents. A tree holds about tree_values values (a document
    of more is a tree of its own; its terms are those of the block at most). A task sends k rows an item at most; they are
    merged first in `parts` groups by task, then those, so that no group grows with the number of tasks by more.
    """
    spark, out = docs.sparkSession, []
    for block in asked_in_blocks(items):
        vocabulary: dict[bytes, int] = {}
        asked = [(i, np.array(sorted(vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms), np.int64)) for i, terms in block]
        rows = vectors(docs, vocabulary)
        n, total = rows.agg(F.count("*"), F.sum("n")).first()
        if n:
            out.append(_best(rows, asked, weights(frequencies(rows, len(vocabulary)), n), n, total, k, tree_values, parts))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _best(rows: DataFrame, asked: list, w: np.ndarray, n: int, total: int, k: int, tree_values: int, parts: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((asked, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = held.value
        best = [(np.zeros(0, np.int64), np.zeros((0, 2), np.int64))] * len(asked)
        one, waiting, size = np.zeros(len(w), np.int64), [], 0

        def search() -> None:
            at, sizes = [np.zeros(1, np.int64)], 0
            for r, _ in waiting:
                at.append(r.at[1:] + sizes)
                sizes += r.at[-1]
            every = Rows(np.concatenate(at), np.concatenate([r.ids for r, _ in waiting]), np.concatenate([r.values for r, _ in waiting]))
            tree = Tree(every, np.concatenate([x for _, x in waiting]), len(w))
            for i, (_, terms) in enumerate(asked):
                best[i], _ = tree.search(terms, best[i], k, one)

        for b in slices(batches, name="ids"):
            present, own = _weighted(b, w, n, total)
            if len(present):
                waiting.append((own, _names(b.column("doc_id"))[present]))
                size += len(own.ids)
            if size >= tree_values:
                search()
                waiting, size = [], 0
        if waiting:
            search()
        scores, names = np.concatenate([s for s, _ in best]), np.concatenate([x for _, x in best])
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        part = np.full(len(item), TaskContext.get().partitionId() % parts)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(part), pa.array(names[:, 1], mask=names[:, 0] == 1), pa.array(scores)], names=["item", "part", "doc_id", "score"])

    found = rows.mapInArrow(run, "item long, part long, doc_id long, score long")
    for keys in (("item", "part"), ("item",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", place).filter(F.col("rank") <= k)
    named = rows.sparkSession.createDataFrame([(j, i) for j, (i, _) in enumerate(asked)], "item long, item_id long")
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM w WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
v AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS x FROM tf JOIN wt USING (term), s),
sc AS (SELECT item_id, r, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN v USING (term) GROUP BY item_id, r, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk WHERE rank <= 50
"""
