"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits and runs of other visible characters; features are words and pairs of neighbours, hashed to
2 ** bits places. Both words of a pair that are equal are one feature, whatever the word. A place's value is the logarithm of its
count, and a text's values have length one. A score is a sparse dot product behind a logistic function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprov.functions.workers import ship

from .shared import written
from .token_ids import slices

BITS = 18
_SECTION = 1 << 20
_SPACE = re.compile(rb"[\x00-\x20\x7f]")
_KIND = np.array([0 if c <= 0x20 or c == 0x7F else 1 if c >= 0x80 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15
_AGAIN = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64, at least n of each."""
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        each = []
        for base in (_BASE, _AGAIN):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            each.append(np.cumprod(p, dtype=np.uint64))
        if size > 2 * _SECTION:
            return each[0], each[1]
        _powers[size] = each[0], each[1]
    return _powers[size]


def words(text: bytes) -> np.ndarray:
    """A hash of every word, in order: equal words have equal ones."""
    data = np.frombuffer(text, np.uint8)
    kind = _KIND[data]
    edges = np.flatnonzero(np.diff(kind)) + 1
    starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(data)]))
    seen = kind[starts] > 0 if len(data) else starts > 0
    starts, stops = starts[seen], stops[seen]
    power, back = _power(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    return (sums[stops] - sums[starts]) * back[starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, places ascending. Long texts are taken in sections that end at white space."""
    found, before, at, dense = [], np.zeros(0, np.uint64), 0, None
    while at < len(text):
        gap = _SPACE.search(text, at + _SECTION) if len(text) - at > _SECTION else None
        stop = gap.end() if gap else len(text)
        w = words(text[at:stop])
        run = np.concatenate((before, w))
        pairs = np.where(run[1:] == run[:-1], np.uint64(1), run[:-1] * np.uint64(0x2545F4914F6CDD1D) + run[1:])
        ids = np.concatenate((_mixed(w), _mixed(pairs ^ np.uint64(0x5851F42D4C957F2D)))) >> np.uint64(64 - bits)
        at, before = stop, run[-1:]
        if gap or dense is not None:
            dense = (0 if dense is None else dense) + np.bincount(ids.astype(np.int64), minlength=1 << bits)
        else:
            found.append(ids)
    if dense is not None:
        places = np.flatnonzero(dense)
        counts = dense[places]
    else:
        places, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
    values = np.log1p(counts)
    return places.astype(np.int64), values / max(1e-9, float(np.sqrt(values @ values)))


def chance(logit: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, logit)))))


class Leader:
    """Follow the regularised leader, place by place; the last place is the constant one."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        step = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (chance(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass(frozen=True)
class Model:
    """weights: 2 ** bits and the constant's."""

    weights: np.ndarray
    bits: int

    def score(self, text: bytes) -> float:
        places, values = features(text, self.bits)
        return chance(float(self.weights[places] @ values) + float(self.weights[-1]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _binary(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")


def examples(docs: DataFrame, labels: DataFrame, label: str, most: int, bits: int = BITS) -> DataFrame:
    """A written table of doc_id, label, places and values (binary) of `most` labelled texts at most, those of the smallest hashes.

    Held-out rows, and null labels, take no part. A doc_id with several labels has the largest; of documents that repeat a
    doc_id one is taken. The chosen ids (16 bytes each) are broadcast, so that no text moves.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [features(t, bits) for t in b.column("text").to_pylist()]
            raw = [[p.astype("<u4").tobytes() for p, _ in made], [v.astype("<f4").tobytes() for _, v in made]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *(pa.array(x, pa.binary()) for x in raw)], names=["doc_id", "label", "places", "values"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", _binary(docs)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    made = rows.mapInArrow(run, "doc_id long, label int, places binary, values binary")
    one = made.groupBy("doc_id", "label").agg(F.min(F.struct("places", "values")).alias("x"))  # repeated rows, met where they are read
    return written(one.select("doc_id", "label", "x.places", "x.values"), "examples")


def train(rows: DataFrame, passes: int = 6, bits: int = BITS) -> Model:
    """A model of examples(): its rows, bounded in number, go through one learner in the order of a hash of their ids, `passes`
    times. They are streamed; what is held is the learner. No rows give weights of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader(bits)
        for b in batches:
            for label, places, values in zip(*(b.column(c).to_pylist() for c in ("label", "places", "values")), strict=True):
                leader.learn(np.frombuffer(places, "<u4").astype(np.int64), np.frombuffer(values, "<f4").astype(np.float64), label)
        at = np.flatnonzero(leader.n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(leader.weights(at))], names=["place", "weight"])

    order = rows.repartition(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"))
    order = order.sortWithinPartitions("pass", F.xxhash64(F.lit(17), "doc_id"), "doc_id")
    learned = order.select("label", "places", "values").mapInArrow(run, "place long, weight double").toArrow()  # 2 ** bits rows at most
    weights = np.zeros((1 << bits) + 1)
    weights[learned.column("place").to_numpy()] = learned.column("weight").to_numpy()
    return Model(weights, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; null texts count as empty, and those have the constant's score.

    The model (2 MB at 18 bits, whatever the input) is broadcast. Rows are scored one by one, repeated ones alike. Other columns
    are ignored. A long text is taken in sections of a megabyte. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in slices(batches):
            scores = [own.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _binary(docs))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4096) -> DataFrame:
    """score() by a model of the labels (doc_id and label) of up to `most` documents that aren't held out.

    A row is held out if crc32 of its doc_id as text is 1 modulo 3; a null doc_id never is, nor has it a label.
    """
    return score(docs, train(examples(docs, labels, label, most)))
