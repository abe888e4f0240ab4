"""Fill-in-middle transformation of whole texts, their cuts found through a memory of chunks.

A text's bytes are cut into chunks where a rolling hash of its last _WINDOW bytes says so, so that passages shared by texts give
equal chunks. What a chunk adds is a small summary: its code points, whether it holds a sentinel, and the bytes at its two ends,
by which a sentinel across a border is seen. Summaries are remembered by content (equal bytes, not only equal hashes), sums of
them give a text's length and the chunk that a cut falls into, and only that chunk is looked at again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_ids import as_bytes, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SENTINEL = re.compile(b"<[PSM]>")
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a code point
_WINDOW = 16
_DRAW = np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint32)
_FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def hits(data: np.ndarray, average: int, section: int = 1 << 20) -> np.ndarray:
    """Places behind which the rolling hash would cut, about one in `average` (a power of two); memory is that of a section."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), section):
        first = max(0, at - _WINDOW)
        h = _DRAW[data[first : at + section]]
        for step in (1, 2, 4, 8):
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
        places = np.flatnonzero((h >> np.uint32(8)) % np.uint32(average) == 0) + first + 1
        found.append(places[places > at])
    return np.concatenate(found)


def summary(chunk: bytes) -> tuple[int, bool]:
    """Code points that start in the chunk, and whether it holds a sentinel."""
    return len(chunk.translate(None, _INSIDE)), _SENTINEL.search(chunk) is not None


class Chunks:
    """Summaries by content. most: bytes that they may take, about; at half of it those not met since the last time are
    forgotten, which changes no result."""

    def __init__(self, most: int = 64 << 20, average: int = 1024, least: int = 128, longest: int = 8192) -> None:
        self.most, self.average, self.least, self.longest = most, average, max(least, _WINDOW), longest
        self.known, self.older, self.size = {}, {}, 0

    def __getitem__(self, chunk: bytes) -> tuple[int, bool]:
        got = self.known.get(chunk)
        if got is None:
            got = self.older.get(chunk) or summary(chunk)
            if self.size > self.most // 2:
                self.older, self.known, self.size = self.known, {}, 0
            self.known[chunk] = got
            self.size += len(chunk) + 160
        return got

    def cut(self, text: bytes, places: list[int], start: int) -> list[bytes]:
        """The chunks of a text that begins at `start` of what places (hits()) count from."""
        out, at, stop = [], 0, len(text)
        while at < stop:
            k = bisect_left(places, start + at + self.least)
            to = places[k] - start if k < len(places) else stop
            to = min(to, at + self.longest, stop)
            out.append(text[at:to])
            at = to
        return out

    def measure(self, parts: list[bytes]) -> tuple[list[int], bool]:
        """Code points up to each chunk's end, and whether the text holds a sentinel."""
        each = [self[c] for c in parts]
        marked, tail = any(m for _, m in each), b""
        for c in parts if not marked else ():
            if tail and _SENTINEL.search(tail + c[:2]):
                marked = True
                break
            tail = (tail + c[-2:])[-2:]
        return list(accumulate(n for n, _ in each)), marked


def place(parts: list[bytes], upto: list[int], point: int) -> int:
    """The byte at which code point `point` of the chunks' text begins; the text's end for one past the last."""
    k = bisect_right(upto, point)
    before = sum(map(len, parts[:k]))
    if k == len(parts):
        return before
    inside = np.flatnonzero(np.frombuffer(parts[k], np.uint8) & 0xC0 != 0x80)
    return before + int(inside[point - (upto[k - 1] if k else 0)])


def _drawn(doc_id: Column, seed: str) -> list[Column]:
    """h1 to h4: the first 8-digit groups of a hash of the id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output (UTF-8) of every row.

    docs needs doc_id and text; other columns are ignored. Cuts and form are drawn from a hash of seed and doc_id (null: of an
    empty id), so that rows that repeat a doc_id with the same text come out alike. plain and spm are percentages: of all texts,
    and of those that aren't plain. Texts that are null or empty or hold a sentinel are plain. A text is held whole by one task,
    with its output and its chunks: about four times its bytes. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for b in slices(batches):
            texts, rows, start = b.column("text").to_pylist(), [], 0
            places = hits(np.frombuffer(b"".join(texts), np.uint8), chunks.average).tolist()
            drawn = zip(*(b.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)), strict=True)
            for doc_id, text, (h1, h2, h3, h4) in zip(b.column("doc_id").to_pylist(), texts, drawn, strict=True):
                parts = chunks.cut(text, places, start)
                start += len(text)
                upto, marked = chunks.measure(parts)
                n = upto[-1] if upto else 0
                if not text or marked or h3 % 100 >= 100 - plain:
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                x, y = place(parts, upto, first), place(parts, upto, last)
                if h4 % 100 < spm:
                    out = ("spm", first, last - first, b"".join((SUFFIX, text[y:], PREFIX, text[:x], MIDDLE, text[x:y])))
                else:
                    out = ("psm", first, last - first, b"".join((PREFIX, text[:x], SUFFIX, text[y:], MIDDLE, text[x:y])))
                rows.append((doc_id, n, *out))
            names, kinds = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    texts = as_bytes(docs)
    return texts.select("doc_id", *_drawn(F.col("doc_id"), seed), "text").mapInArrow(run, _FORMS)


def restored(form: Column, output: Column) -> Column:
    """The text that transform() made output of, from output and form alone. Only sentinels of its own are in a text that isn't
    plain, so that cutting there gives its three parts."""
    part = F.split(output.cast("string"), _SENTINEL.pattern.decode(), -1)
    psm, spm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))), F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output.cast("string"))


def digest(made: DataFrame) -> DataFrame:
    """transform()'s rows with hashes of output and of the text restored from it in output's place."""
    hashes = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(text, 1, x) AS a, substring(text, x + 1, y - x) AS m, substring(text, y + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
