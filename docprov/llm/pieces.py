"""SentencePiece BPE encoding by suffix-array matching, and decoding.

A batch's texts are cut before every run of the space mark, where no piece of the vocabulary can reach across, and between
characters that stand side by side in no piece; what is new of these parts is put one behind another. A suffix array of that text is searched for every piece of the vocabulary;
the ranges found are all edges (place, piece). Sorted by place, they are relaxed from left to right: the encoding of a
prefix of BPE ends in exactly one piece, so an edge is taken if it may follow the piece that ends where it starts, that
is, if no merge across their border comes before the merges that made both.
"""

from __future__ import annotations

import array
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import as_bytes, slices

MARK = "▁"
_NEVER = float("inf")
_models: dict = {}
_vocabularies: dict = {}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of codes' suffixes, ordered by their first `depth` items at least (prefix doubling)."""
    n, h = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    while h < min(depth, n):
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        h *= 2
    return np.argsort(rank, kind="stable")


def grid_of(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of words, their items padded by -1): what ranges() searches for."""
    sizes = np.array([len(w) for w in words], np.int64)
    grid = np.full((len(words), int(sizes.max(initial=0))), -1, np.int32)
    for i, w in enumerate(words):
        grid[i, : len(w)] = w
    return sizes, grid


def ranges(codes: np.ndarray, order: np.ndarray, sizes: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) of order for each word: where the suffixes start with it. All are searched together, item by item."""
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(order))
    wide = int(codes.max(initial=0)) + 2
    group = np.zeros(len(order), np.int64)
    padded = np.concatenate([codes, np.full(grid.shape[1] + 1, -1)])
    for level in range(grid.shape[1]):
        column = padded[order + level] + 1
        keys = group * wide + column
        live = np.flatnonzero((sizes > level) & (low < high))
        if not len(live):
            break
        inside = grid[live, level] < wide - 1
        target = group[np.minimum(low[live], len(order) - 1)] * wide + grid[live, level] + 1
        low[live] = np.where(inside, np.searchsorted(keys, target, "left"), 0)
        high[live] = np.where(inside, np.searchsorted(keys, target, "right"), 0)
        group = np.concatenate([[0], np.cumsum(np.diff(keys) != 0)]) if len(keys) else group
    high[sizes == 0] = 0
    return low, high


class Vocabulary:
    """Pieces of a SentencePiece BPE file with byte fallback, and what each says; the library only reads the file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [b""] * size
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        self.bytes[sp.unk_id()] = " ⁇ ".encode()
        # what Model takes for granted: texts are not normalised, and begin with a mark of their own
        self.taken_as_is = sp.normalize("a  ﬁ é\n") == "▁a▁▁ﬁ▁é\n"

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data[1:].decode(errors="replace") if data[:1] == b" " else data.decode(errors="replace")


class Model(Vocabulary):
    """Encodes. most: bytes that remembered units may take, about; beyond it all are forgotten, which changes nothing but time.
    Units of more than `longest` bytes are not remembered."""

    def __init__(self, path: str, most: int = 128 << 20, longest: int = 64, most_fits: int = 200_000) -> None:
        super().__init__(path)
        if not self.taken_as_is:
            raise ValueError("this model normalises texts")
        self.most, self.longest, self.known, self.size = most, longest, {}, 0
        self.most_fits, self.fits, self.n_fits, self.spines = most_fits, {}, 0, {}
        self.pieces = sorted(self.ids)
        self.sized = [(p, len(p)) for p in self.pieces]
        self.longest_piece = max(map(len, self.pieces))
        self.grid = grid_of([[ord(c) + 1 for c in p] for p in self.pieces])
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.apart = np.ones(1 << 16, bool)  # by two bytes of ASCII: whether they stand side by side in no piece
        self.apart[[ord(a) << 8 | ord(b) for a, b in (p.replace(MARK, " ") for p in self.pairs) if (a + b).isascii()]] = False
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.unit = re.compile(b"(?s).+" if crossing else b" *[^ ]+| +")
        # where runs of marks are merged behind all else, and greedily, they can be told apart from the word behind them
        runs = {p for p in self.pieces if p.startswith(MARK * 2)}
        self.runs = sorted((len(p) for p in runs if p == MARK * len(p)), reverse=True)
        others = max((r for p, r in self.rank.items() if p not in runs and len(p) > 1), default=0)
        apart = not crossing and len(runs) == len(self.runs) and all(self.rank[p] > others for p in runs)
        self.greedy = apart and all(self.merged(MARK * n)[0] == self._run(n) for n in range(1, 5 * self.longest_piece))

    def _run(self, n: int) -> list[str]:
        """n marks by the longest pieces of marks."""
        out = []
        for size in self.runs:
            out += [MARK * size] * (n // size)
            n %= size
        return out + [MARK] * n

    def merged(self, text: str) -> tuple[list[str], dict]:
        """BPE's pieces of text by merging, best score first and leftmost of equals; and the two parts of each merge."""
        at, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap, parts = [], {}

        def offer(i: int) -> None:
            j = after[i]
            if j < len(at) and (r := self.rank.get(at[i] + at[j])) is not None:
                heap.append((r, i, at[i], at[j])) if not heap else heapq.heappush(heap, (r, i, at[i], at[j]))

        for i in range(len(at) - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if at[i] != a or after[i] >= len(at) or at[after[i]] != b:
                continue
            j = after[i]
            parts[a + b] = (a, b)
            at[i], at[j], after[i] = a + b, None, after[j]
            if after[j] < len(at):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in at if x is not None], parts

    def spine(self, piece: str) -> tuple | None:
        """((left parts), (right parts)) of the piece from itself down to a character, each with its merge's rank; None
        if merging its characters doesn't give it."""
        if piece not in self.spines:
            end, parts = self.merged(piece)
            sides = []
            for k in (0, 1):
                p, until, side = piece, _NEVER, []
                while True:
                    side.append((p, until))
                    if p not in parts:
                        break
                    until, p = self.rank[p], parts[p][k]
                sides.append(tuple(side))
            self.spines[piece] = tuple(sides) if end == [piece] else None
        return self.spines[piece]

    def may_follow(self, left: str, right: str) -> bool:
        """True if BPE of left and right together is left, right: no merge across the border is before those beside it."""
        a, b, rank = self.spine(left), self.spine(right), self.rank
        if a is None or b is None:
            return False
        for x, stop_x in a[1]:
            for y, stop_y in b[0]:
                r = rank.get(x + y)
                if r is not None and r < stop_x and r <= stop_y:
                    return False
        return True

    def _fit(self, row: dict[str, bool], left: str, right: str) -> bool:
        """may_follow, kept in row (the answers for left)."""
        self.n_fits += 1
        row[right] = fits = self.may_follow(left, right)
        return fits

    def _ids(self, pieces: list[str]) -> bytes:
        try:
            return array.array("I", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:  # bytes stand for a character
            out = array.array("I")
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend([self.byte_ids[b] for b in p.encode()])
            else:
                out.append(i)
        return out.tobytes()

    def _edges(self, codes: np.ndarray) -> tuple[list[int], list[tuple[str, int]]]:
        """(bounds, pieces): place k of codes has the edges pieces[bounds[k] : bounds[k + 1]]."""
        order = suffix_array(codes, self.longest_piece)
        low, high = ranges(codes, order, *self.grid)
        counts = high - low
        piece = np.repeat(np.arange(len(self.pieces), dtype=np.int32), counts)
        place = order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(len(piece))]
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(len(codes) + 1)).tolist()
        return bounds, list(map(self.sized.__getitem__, piece[by_place].tolist()))

    def _encode_parts(self, parts: Iterable[str], chunk: int) -> Iterator[bytes]:
        """ids of parts, none of them empty. About `chunk` characters stand in a suffix array: longer parts go through several,
        that overlap by the longest piece."""
        some, held = [], 0
        for p in parts:
            if some and held + len(p) > chunk:
                yield from self._encode_some(some, chunk)
                some, held = [], 0
            some.append(p)
            held += len(p) + 1
        if some:
            yield from self._encode_some(some, chunk)

    def _encode_some(self, parts: list[str], chunk: int) -> Iterator[bytes]:
        if self.n_fits > self.most_fits:
            self.fits.clear()
            self.n_fits = 0
        if len(parts) == 1 and len(parts[0]) > chunk:
            yield self._ids(self._relax(parts[0], self._windows(parts[0], chunk)))
            return
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        codes = np.frombuffer("\0".join(parts).encode("utf-32-le"), "<u4").astype(np.int64) + 1
        codes[(starts + sizes)[:-1]] = 0  # between parts, and in no piece
        bounds, piece = self._edges(codes)
        for p, at in zip(parts, starts.tolist(), strict=True):
            yield self._ids(self._relax(p, iter([(len(p), at, bounds, piece)])))

    def _windows(self, part: str, chunk: int) -> Iterator[tuple]:
        for lo in range(0, len(part), chunk):
            text = part[lo : lo + chunk + self.longest_piece]
            bounds, piece = self._edges(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1)
            yield min(lo + chunk, len(part)), -lo, bounds, piece

    def _relax(self, part: str, windows: Iterator[tuple]) -> list[str]:
        """The pieces of a part. A window (until, at, bounds, piece) has the edges of places before `until`; those of place k are
        piece[bounds[at + k] : bounds[at + k + 1]]."""
        n, ids, here = len(part), self.ids, 0
        last: list[str | None] = [None] * (n + 1)
        for until, at, bounds, piece in windows:
            while here < until:
                left, k, stop = last[here], bounds[at + here], bounds[at + here + 1]
                if here == 0:
                    for p, size in piece[k:stop]:
                        if self.spine(p) is not None:
                            last[size] = p
                elif left is not None:
                    row = self.fits.get(left)
                    if row is None:
                        row = self.fits[left] = {}
                    for p, size in piece[k:stop]:
                        if last[here + size] is None:  # a prefix has one last piece
                            fits = row.get(p)
                            if fits is None:
                                fits = self._fit(row, left, p)
                            if fits:
                                last[here + size] = p
                c = part[here]
                if c not in ids and (here == 0 or (left is not None and self.may_follow(left, c))):  # no piece: bytes stand for it
                    last[here + 1] = c
                here += 1
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _parts(self, unit: bytes) -> Iterator[str]:
        """The unit cut between characters that stand side by side in no piece: no merge can cross there."""
        text = unit.decode().replace(" ", MARK)
        pairs, start = self.pairs, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                yield text[start:i]
                start = i
        yield text[start:]

    def _ascii_parts(self, units: list[bytes]) -> tuple[list[bytes], list[int]]:
        """_parts() of all units, none of them empty and all of ASCII, one behind another, and where each unit's begin (and end)."""
        text = b"".join(units)
        codes = np.frombuffer(text, np.uint8).astype(np.uint16)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = self.apart[codes[:-1] << 8 | codes[1:]]
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        cut[first] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:])], np.searchsorted(at, first).tolist()

    def _learn(self, units: list[bytes], chunk: int) -> dict[bytes, bytes]:
        """ids of units that aren't known; short ones are remembered, parts that stand for a unit of their own too."""
        known, mark = self.known, MARK.encode()
        parts, plain, heads, got = {}, set(), {}, {}
        for u in units:
            if not self.greedy and b"  " in u:
                got[u] = self._ids(self.merged(u.decode().replace(" ", MARK))[0])
                continue
            if u.startswith(b"  "):  # the last mark of a run may belong to the word
                body = u.lstrip(b" ")
                n = len(u) - len(body)
                heads[u] = n - 1 if body else n
                u = b" " + body if body else b""
            if len(u) > 4096:
                ids = bytearray()  # parts of a long unit are not looked for elsewhere
                for x in self._encode_parts(self._parts(u), chunk):
                    ids += x
                got[u] = bytes(ids)
            elif u.isascii():
                plain.add(u)
            elif u not in parts and u not in known:
                parts[u] = [x.encode().replace(mark, b" ") for x in self._parts(u)]
        plain = [u for u in plain if u and u not in known]
        cut, bounds = self._ascii_parts(plain)
        fresh = list(set(cut).union(*parts.values()).difference(known))
        got.update(zip(fresh, self._encode_parts([p.decode().replace(" ", MARK) for p in fresh], chunk), strict=True))
        of = {p: got[p] if p in got else known[p] for p in set(cut).union(*parts.values())}
        for u, a, b in zip(plain, bounds, bounds[1:]):
            if b > a + 1:
                got[u] = b"".join(map(of.__getitem__, cut[a:b]))
        for u, each in parts.items():
            if u not in got:
                got[u] = b"".join(map(of.__getitem__, each))
        lone = self._ids([MARK])
        for u, n in heads.items():
            body = u.lstrip(b" ")
            ids = (got.get(b" " + body) or known[b" " + body]) if body else b""
            if ids.startswith(lone):
                n, ids = n + 1, ids[len(lone) :]
            got[u] = self._ids(self._run(n)) + ids
        short = {u: ids for u, ids in got.items() if len(u) <= self.longest}
        self.size += sum(map(len, short)) + sum(map(len, short.values())) + 180 * len(short)
        if self.size > self.most:
            known.clear()
            self.size = 0
        known.update(short)
        return got

    def encode(self, texts: list[bytes], chunk: int = 100_000) -> list[bytes]:
        """ids of each text (in UTF-8), as bytes of little-endian unsigned 32-bit ids. chunk: characters in a suffix array."""
        mark, known = MARK.encode(), self.known
        cut = [self.unit.findall(b" " + t.replace(mark, b" ")) if t else [] for t in texts]
        every: set = set()
        for units in cut:
            every.update(units)
        ids = {u: known[u] for u in every if u in known}
        ids.update(self._learn([u for u in every if u not in ids], chunk))
        return [b"".join(map(ids.__getitem__, units)) for units in cut]


def vocabulary(path: str) -> Vocabulary:
    """This Python worker's vocabulary."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def model(path: str) -> Model:
    """This Python worker's model."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row of docs.

    docs needs doc_id and text; other columns are ignored. Whole texts are encoded; null and empty ones give no ids. Rows
    that repeat another, or a doc_id, are encoded each. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = model(path).encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column text, what its ids say; null ids give null, other columns stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20, "ids"):
            texts = [None if i is None else vocabulary(path).decode(i) for i in b.column("ids").to_pylist()]
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.mapInArrow(run, schema)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and decoded_sha256 of what encode() gave, after decoding it."""
    return decode(encoded, path).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
