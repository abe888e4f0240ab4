"""Suffix-array dedup against every string of every text."""

import random

import numpy as np
import pytest
from docprov.llm import suffix_dedup


def brute(rows, length):
    """doc_id -> (spans, kept), rows in order of doc_id (null last)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        edges = [i for i in range(len(data) + 1) if (i < len(data) and gone[i]) != (i > 0 and gone[i - 1])]
        out[doc_id] = (list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    shared = [" ".join(r.choice(words) for _ in range(r.randint(4, 20))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randint(0, 5))]
        texts.append(" ".join(parts))
    texts += [None, "", "a" * 90, "a" * 40, "ab" * 60, texts[0], texts[1], texts[2] * 3]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows[-1], rows[-2], rows[-3] = (None, rows[-1][1]), (2**63 - 1, rows[-2][1]), (-(2**63), rows[-3][1])
    return rows


@pytest.mark.parametrize(
    ("seed", "length", "gram", "block", "samples", "bucket", "most"),
    [(1, 20, 8, 1 << 20, 40, 1 << 20, 1000), (2, 24, 4, 300, 40, 400, 1000), (3, 16, 16, 200, 1, 1 << 20, 20), (4, 33, 8, 500, 3, 700, 10), (5, 20, 8, 250, 2, 500, 3)],
)
def test_same_as_brute_force(spark, seed, length, gram, block, samples, bucket, most):
    rows = corpus(seed, 60)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    want = brute(rows, length)
    got = suffix_dedup.repeats(df, length, gram, block, samples, bucket, most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ([tuple(s) for s in r["spans"]], bytes(r["kept"])) == want[r["doc_id"]]
        assert r["n_bytes"] == len((dict(rows)[r["doc_id"]] or "").encode())


def test_a_passage_in_every_block(spark):
    """Blocks of one document each, all with the same passage: buckets that are too large are dealt in parts first."""
    passage = "the same passage stands in every one of these documents and is longer than any window of the strings asked for "
    rows = [(i, f"{passage}{passage} own{i * 7919 % 1000:04d}") for i in range(60)]
    want = brute(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (5, 1000):
        got = suffix_dedup.repeats(df, 20, 8, 100, most=most).collect()
        assert {r["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got} == want


def test_empty_table(spark):
    assert suffix_dedup.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order_sorts():
    rng = np.random.default_rng(1)
    for width in (1, 8, 13, 20):
        text = rng.integers(97, 99, (300, width), np.uint8)
        order = suffix_dedup.multikey_order(text)
        rows = [t.tobytes() for t in text]
        assert [rows[i] for i in order] == sorted(rows)


def test_query_over_a_whole_table(spark):
    from docprov.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 100)
    for r in queries()["op8_suffix_dedup"](spark, sf).collect():
        spans, kept = want[r["doc_id"]]
        assert (r["n_spans"], r["n_removed"], r["n_bytes"] - r["n_removed"]) == (len(spans), sum(b - a for a, b in spans), len(kept))


def test_a_long_text_is_cut_into_blocks(spark):
    """Strings over borders of a text's blocks, a block that ends the text in less than a string, one text that others repeat."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh") for _ in range(3007))
    rows = [(7, long + long[400:900]), (3, long[95:140] + "-" + long[295:330]), (None, "x" + long[1000:2900]), (9, "z" * 1000), (8, long[:101]), (5, None)]
    want = brute(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for block in (100, 101, 1000):
        got = suffix_dedup.repeats(df, 20, 8, block, 3, 700, 10).collect()
        assert {g["doc_id"]: ([tuple(s) for s in g["spans"]], bytes(g["kept"])) for g in got} == want
        assert {g["doc_id"]: g["n_bytes"] for g in got} == {i: len((t or "").encode()) for i, t in rows}
        assert len(got) == len(rows)
