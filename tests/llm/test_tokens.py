"""Packing and token-id files against the library applied to whole texts."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from docprov.llm import packing, planes
from docprov.llm.queries import BYTE_BPE, WORD_BPE
from docprov.llm.token_ids import Encoder
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [
    (5, "Hello  world\n\nit's  5  　x  ", "x"),
    (3, None, "x"),
    (4, "", None),
    (9, "word " * 9000, "y"),
    (None, "no id <|endoftext|> é é", "y"),
    (7, "same text", "z"),
    (8, "same text", "z"),
    (1, "\x1c \x85 a\x0bb\r\n  tail  ", "z"),
]


@cache
def library(path):
    return Tokenizer.from_file(path)


@cache
def small(path, units):
    return Encoder(path, units, most=5)


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


ODD = st.text(st.sampled_from(list("  \n\t\r,,\x0b\x1c\x85  　abEH'sé×̱́İß1!.<|>\U0001f600")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_units_give_the_librarys_ids(texts):
    for path, units in ((BYTE_BPE, "byte"), (WORD_BPE, "word")):
        got = small(path, units)([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(path, t) for t in texts]


ITEMS = ["'S", "'re", "'VE", "'M", "'ll", "'D", "IT'S", "WE'LL", "don't", "\u0301", "e\u0301", "A\u030a", "\u0345", "\u0360", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", " ", "  ", "\u3000", "\x85", "\xa0", "\n", "\t", "\u212a", "\u0130", "\xdf", "\xc9", "a", "Bc", "12", "!?", "\u65e5", "\x1c", "\U0001f600"]


def test_ten_thousand_texts_have_the_plain_calls_ids():
    """Combining marks, contractions in either case, added tokens' names and odd spaces; no switch of the library is set."""
    r = random.Random(11)
    texts = ["".join(r.choice(ITEMS) for _ in range(r.randint(0, 14))) for _ in range(10_000)]
    for path, units in ((BYTE_BPE, "byte"), (WORD_BPE, "word")):
        encode = Encoder(path, units, most=1 << 16)
        got = [np.frombuffer(g, "<u4").tolist() for k in range(0, len(texts), 500) for g in encode([t.encode() for t in texts[k : k + 500]])]
        assert got == [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert ids_of(BYTE_BPE, "a <|endoftext|> b") == [64, 220, 50256, 275]


def test_a_name_in_capitals_is_no_added_token():
    """Lower-cased before it went to the library with other characters of its word, it became one."""
    texts = ["WE'LL<|ENDOFTEXT|>\u0130 a", "<|EndOfText|>\u65e5", "<|STARTOFTEXT|>", "a<|endoftext|><|ENDOFTEXT|>\u0130"]
    got = Encoder(WORD_BPE, "word")([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(WORD_BPE, t) for t in texts]


def test_files_round_trip(spark):
    for bits, most in ((False, 1 << 27), (True, 1 << 27), (False, 5)):
        files = planes.write_corpus(docs(spark), BYTE_BPE, "byte", end_id=0, block=64, bits=bits, file_ids=most)
        assert files.count() <= 4 if most > 5 else files.count() > 4
        got = {r["doc_id"]: r for r in planes.read_corpus(spark, files).collect()}
        start = 0
        for doc_id, text, _ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
            want = np.array([*ids_of(BYTE_BPE, text), 0], "<u4")
            assert (got[doc_id]["start"], bytes(got[doc_id]["ids"])) == (start, want.tobytes())
            start += len(want)
        assert len(got) == len(TEXTS)
    empty = docs(spark).filter("false")
    assert planes.read_corpus(spark, planes.write_corpus(empty, BYTE_BPE, "byte", 0)).count() == 0


def test_planes_invert():
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, np.uint32)
    for n in (0, 1, 7, 8, 1000):
        for bits in (False, True):
            assert (planes.unplanes(planes.planes(ids[:n], bits), n, bits) == ids[:n]).all()


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], np.zeros(n, int)
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if k == len(free):
                free.append(100)
            assert offsets[i] == 100 - free[k]
            free[k] -= lengths[i]
            want[i] = k
        assert (bins == want).all()


def test_packing_places_every_id_once(spark):
    for width, end in ((2, 2), (4, 70_000)):
        cut = packing.pieces(docs(spark), WORD_BPE, "word", end_id=end, size=64)
        assert {r["width"] for r in cut.collect()} == {width}
        built = packing.pack(cut, 5, size=64).collect()
        assert len({r["sequence_id"] >> 32 for r in built}) > 1 and len({r["sequence_id"] for r in built}) == len(built)
        by_doc, seen = defaultdict(list), set()
        for r in built:
            at = 0
            for p in r["pieces"]:
                assert p["offset"] == at and p["piece_id"] not in seen
                seen.add(p["piece_id"])
                by_doc[p["doc_id"]].append((p["start"], bytes(r["ids"])[4 * at : 4 * (at + p["length"])], p["doc_tokens"]))
                at += p["length"]
            assert at == r["length"] <= 64 and len(r["ids"]) // 4 == (at if at.bit_count() == 1 else 64)
            assert not any(bytes(r["ids"])[4 * at :])
        for doc_id, text, _ in TEXTS:
            want = np.array([*ids_of(WORD_BPE, text), end], "<u4").tobytes()
            parts = sorted(by_doc[doc_id])
            assert b"".join(p for _, p, _ in parts) == want and {n for *_, n in parts} == {len(want) // 4}
            assert [a for a, *_ in parts] == list(range(0, len(want) // 4, 64))
        rows = packing.placed(packing.pack(cut, 5, size=64)).collect()
        crc = sorted((r["doc_id"] or 0, r["start"], r["ids_crc32"]) for r in rows)
        assert crc == sorted((i or 0, a, zlib.crc32(p)) for i, parts in by_doc.items() for a, p, _ in parts)
    none = docs(spark).filter("false")
    assert packing.pack(packing.pieces(none, WORD_BPE, "word", 2), packing.groups_for(none)).count() == 0


def test_one_row_repeated_fills_many_groups(spark):
    many = spark.range(20000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    groups = packing.groups_for(many, group_rows=1000)
    rows = packing.placed(packing.pack(packing.pieces(many, WORD_BPE, "word", end_id=2), groups)).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 20000 and len(sizes) == groups and 20 <= groups <= 22 and max(sizes.values()) < 1300


def test_queries_over_whole_tables(spark):
    from docprov.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op10_token_planes"](spark, sf).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        want = np.array([*ids_of(BYTE_BPE, texts[r["doc_id"]]), 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want) // 4, zlib.crc32(want))
        start += r["n_tokens"]
    assert len(rows) == len(texts)
    placed = queries()["op9_packing"](spark, sf)
    assert placed.agg(F.sum("length")).first()[0] == sum(len(ids_of(WORD_BPE, t)) + 1 for t in texts.values())
    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.filter("n > 4096").count() == 0


def test_units_encoded_as_lines_have_the_librarys_ids():
    texts = ["", " ", "\n\n a  b", "a\n's 't don't\t\tx", "é  ñ!! \"q\"\r\n12ab", "a\x1cb \x1c", "日本 語\n\n\n", "<|endoftext|> a <|endoftext|>", "'s\n's 's", "\n", "x\x85y"]
    encode = Encoder(BYTE_BPE, "byte")
    for _ in range(2):  # units unknown, then known
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encode([t.encode() for t in texts])]
        assert got == [ids_of(BYTE_BPE, t) for t in texts]
    many = [f"w{i}'s!?'d" if i % 3 else f" É{i}.÷" for i in range(2500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in many])] == [ids_of(BYTE_BPE, t) for t in many]
