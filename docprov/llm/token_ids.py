"""Token ids of texts by the tokenizers library, repeated units of text being encoded once."""

from __future__ import annotations

import array
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprov.functions.workers import ship

#: Per file kind: what may be encoded apart from the rest. Tokens of the first never hold white space; those of the
#: second hold it as a leading space or a run of its own.
UNITS = {
    "word": re.compile(rb"[^\s]+"),
    # runs of letters, digits or marks of ASCII and Latin-1 that no other character follows stand for themselves
    "byte": re.compile(rb"'(?:s|t|re|ve|m|ll|d)| ?(?:(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++|[0-9]++|[!-/:-@\[-`{-~]++)(?![\x80-\xff])| ?[^\s]+|\s+(?!\S)|\s+"),
}
#: White space outside ASCII, in UTF-8: a text that holds any is encoded whole where units hold white space.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: First bytes of combining characters that join ASCII letters: lower-casing before normalising could change those.
_JOINS = re.compile(rb"[\xcc\xcd]")
#: Other characters than those of ASCII that are seen and the letters that UTF-8 starts with 0xC3: units with any are left to
#: the library's own normaliser and pre-tokenizer.
_ODD = re.compile(rb"[\x00-\x1f\x7f\xc0-\xc2\xc4-\xff]|\xc3[\x97\xb7]")
_LETTERS, _MARKS = rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+", rb"[!-/:-@\[-`{-~]+"
_SHORT = rb"'(?:s|t|re|ve|m|ll|d)"
#: What other units, a line each, are cut into: as the files' own pre-tokenizers cut them.
_CUTS = {
    "word": re.compile(rb"\n|" + _SHORT + b"|" + _LETTERS + b"|[0-9]|" + _MARKS),
    "byte": re.compile(rb"\n|" + _SHORT + b"| ?" + _LETTERS + b"| ?[0-9]+| ?" + _MARKS),
}
#: The pattern of the pre-tokenizer that "word" holds for.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in vocabularies of bytes: those that are seen for themselves, others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER_OF = _byte_letters()
_LINE = _LETTER_OF.pop(10)  # line feeds stand between parts
_encoders: dict = {}


def fits(path: str, units: str) -> bool:
    """True if the file's normaliser and pre-tokenizer are those that this kind of units was made for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    if units == "byte":
        return not norm and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    steps = [x["type"] for x in norm.get("normalizers", [])]
    first, *rest = cut.get("pretokenizers", [{}])
    whole = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0].get("use_regex", True) and not rest[0].get("add_prefix_space")
    return steps == ["NFC", "Replace", "Lowercase"] and whole and first.get("pattern") == {"Regex": _WORD_SPLIT} and bool(first.get("invert"))


class Encoder:
    """ids of texts in UTF-8, as bytes of little-endian unsigned 32-bit ids; the library decides on every unit.

    Units of up to `longest` bytes are remembered. most: bytes that these may take, about; at half of it those not met since
    the last time are forgotten, which costs time and changes nothing.
    """

    def __init__(self, path: str, units: str, most: int = 128 << 20, longest: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.inner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.names = [t.content.encode() for t in added]
        self.lower_names = [n.lower() for n in self.names]
        self.inner.normalizer, self.inner.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.line = self.inner.encode(_LINE, add_special_tokens=False).ids
        self.largest = max(self.library.get_vocab(with_added_tokens=True).values())
        self.units, self.cut, self.spaced = UNITS[units], _CUTS[units].findall, units == "byte"
        self.most, self.longest, self.known, self.older, self.size = most, longest, {}, {}, 0
        self.whole = not fits(path, units) or len(self.line) != 1 or any(t.normalized for t in added)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _encode_parts(self, parts: list[bytes], each: int = 500) -> list[bytes]:
        """As _encode, for what _CUTS gives: normalised and cut already, many stand in one text with a line feed's id between."""
        out: list = []
        for k in range(0, len(parts), 16 * each):
            texts = [b"\n".join((b"", *parts[i : i + each], b"")) for i in range(k, min(k + 16 * each, len(parts)), each)]
            if not self.spaced:
                texts = [t.decode().lower().encode() for t in texts]
            texts = [t.decode("latin-1").translate(_LETTER_OF).replace("\n", f"\n{_LINE}\n") for t in texts]
            for e in self.inner.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), (4 * np.flatnonzero(ids == self.line[0])).tolist()
                out.extend(raw[a + 4 : b] for a, b in zip(at, at[1:], strict=False))
        return out

    def _learn(self, units: set[bytes]) -> dict[bytes, bytes]:
        """ids of units that aren't in known; what is short is put there."""
        known, older, odd = self.known, self.older, _ODD.search
        got = {u: older[u] for u in units if u in older}
        plain, rest = [], []
        for u in units:
            if u not in got:
                (rest if odd(u) or u.isspace() else plain).append(u)
        got.update(zip(rest, self._encode(rest), strict=True))
        parts = self.cut(b"\n".join((*plain, b""))) if plain else []
        of = {p: known[p] if p in known else older.get(p) for p in set(parts)}
        fresh = [p for p, ids in of.items() if ids is None and p != b"\n"]
        of.update(zip(fresh, self._encode_parts(fresh), strict=True))
        start = 0
        for u in plain:
            stop = parts.index(b"\n", start)
            got[u] = of[parts[start]] if stop == start + 1 else b"".join(map(of.__getitem__, parts[start:stop]))
            start = stop + 1
        if self.size > self.most // 2:
            self.older, self.known, self.size = known, {}, 0
        self.known.update(got if max(map(len, got), default=0) <= self.longest else {u: ids for u, ids in got.items() if len(u) <= self.longest})
        self.size += sum(map(len, got)) + sum(map(len, got.values())) + 180 * len(got)
        return got

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.whole:
            return self._encode(texts)
        out: list = []
        for t in texts:
            # an added token, such as <|endoftext|>: the library finds it in the text as it stands. In capitals it is none there, and
            # would be one after lower-casing here, so that such a text goes to the library too
            low = t if self.spaced else t.lower()
            if any(n in low for n in (self.names if self.spaced else self.lower_names)):
                out.append(self._encode([t])[0])
            elif not self.spaced:
                out.append([u if _ODD.search(u) else u.lower() for u in t.split()] if _JOINS.search(t) else low.split())
            elif _WIDE_SPACE.search(t):
                out.append(self._encode([t])[0])
            else:
                out.append(self.units.findall(t))
        every: set = set()
        for x in out:
            if not isinstance(x, bytes):
                every.update(x)
        known = self.known
        ids = {u: known[u] for u in every if u in known}
        ids.update(self._learn(every.difference(ids)))
        of = ids.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(of, x)) for x in out]


def encoder(path: str, units: str) -> Encoder:
    """This Python worker's encoder for the file."""
    if (path, units) not in _encoders:
        _encoders[path, units] = Encoder(path, units)
    return _encoders[path, units]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of about `most` bytes in the binary column `name`."""
    for b in batches:
        sizes, start, total = b.column(name), 0, 0
        for i in range(b.num_rows):
            total += len(sizes[i].as_buffer())
            if total >= most:
                yield b.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def as_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and text in UTF-8, null being empty."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
