"""MaxScore against all inner products, and pieces against the library."""

import hashlib
import math
import random
import subprocess
import sys
from functools import cache

import numpy as np
import sentencepiece
from docprov.llm import max_score, pieces
from docprov.llm.queries import PIECE_BPE
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_top(rows, k):
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, q in {(i, tuple(v)) for i, v in use if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in use if i != own)
        out += [(own, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5, **how):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int, block int").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in max_score.top_k(df, k, **how).collect())
    assert got == brute_top(rows, k)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.15, 12).tolist()) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 460)]  # ties
    rows += [(i, (-np.abs(rng.normal(0, 1, 12))).tolist()) for i in range(460, 470)]
    rows += [(500, [0.0] * 12), (501, None), (550, [None] * 12), (600, [float("nan")] * 12), (650, [float("inf")] * 12), (None, [1.0] * 12), (700, [1.0]), (701, []), (750, [])]
    check(spark, rows)
    check(spark, rows, shard_rows=50, block_rows=4)
    check(spark, [(i, np.eye(12)[i % 12].tolist()) for i in range(120)], k=20)
    check(spark, [(0, [-1.0, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 0.0])])
    check(spark, [(0, [1.0])])
    check(spark, [(50, [1.0]), (50, [1.0]), (1, [2.0]), (1, [2.0])])
    assert max_score.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_terms_are_skipped_without_loss():
    rng = np.random.default_rng(9)
    values = (rng.pareto(1.5, (3000, 20)) * rng.choice([0, 1, -1], (3000, 20), p=[0.8, 0.15, 0.05]) * 50).astype(np.int64)
    ids = rng.permutation(3000)
    shard = max_score.Shard(ids, values)
    for i in range(0, 3000, 100):
        scores = values @ values[i]
        other = ids != ids[i]
        best = np.lexsort((ids[other], -scores[other]))[:5]
        got = shard.top(int(ids[i]), values[i], 5)
        assert (got[0] == ids[other][best]).all() and (got[1] == scores[other][best]).all()
        floor = int(scores[other][best[2]])
        got = shard.top(int(ids[i]), values[i], 5, floor)
        stay = scores[other][best] >= floor
        assert (got[0] == ids[other][best][stay]).all() and (got[1] == scores[other][best][stay]).all()
        assert not len(shard.top(int(ids[i]), values[i], 5, 10**9)[0])


def test_champions_bound_the_first_threshold(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(-9, 10, 6).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    best = max_score.champions(df, 3)
    assert 0 < best.count() <= 3 * 2 * 6
    top = {(d, sign): sorted((-v[d] * sign for _, v in rows))[2] for d in range(6) for sign in (1, -1)}
    for r in best.collect():
        assert any(-r["v"][d] * sign <= top[d, sign] for d in range(6) for sign in (1, -1))
    for r in max_score.with_floors(df.filter("vec_id % 50 = 0"), best, 5).collect():
        scores = sorted((sum(a * b for a, b in zip(r["v"], v)) for i, v in rows if i != r["vec_id"]), reverse=True)
        assert r["floor"] <= scores[4]
    assert {r["floor"] for r in max_score.with_floors(df, best.limit(2), 5).collect()} == {None}


@cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


@cache
def model():
    return pieces.Model(PIECE_BPE, most=50)


def same(texts):
    for t, ids in zip(texts, model().encode([t.encode() for t in texts], chunk=200), strict=True):
        want = library().encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model().decode(ids) == library().decode(want)


ODD = st.text(st.sampled_from(list("aabcdeinorst  \n\t.▁é梦ﬁ́\x00\U0001f600ا1239-_=")), max_size=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_encodes_like_the_library(texts):
    same(texts)


def test_encodes_words_and_runs_like_the_library():
    r = random.Random(1)
    same(["", " ", "          x", "a" * 300, "=" * 70, "\n" * 40, " " * 500 + "b", "<s></s><unk><0x41>", "internationalisation " * 50, "x" * 5000])
    names = [p.replace("▁", " ") for p in model().pieces]
    same(["".join(r.choice(names) for _ in range(r.randint(1, 12))) for _ in range(1500)])


def test_units_of_ascii_are_cut_together_as_one_by_one():
    r, m = random.Random(7), pieces.Model(PIECE_BPE)
    units = [" " * r.randint(0, 1) + "".join(r.choice("abcXYZ019.,;:-_=/\n\t\x00\x7f(") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    cut, bounds = m._ascii_parts([u.encode() for u in units])
    want = [list(m._parts(u.encode())) for u in units]
    assert [[x.decode().replace(" ", "▁") for x in cut[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert m._ascii_parts([]) == ([], [0]) and max(map(len, want)) > 5


def test_long_units_take_little_memory():
    code = """
import random, resource, sys
import numpy as np, sentencepiece
from docprov.llm import pieces
from docprov.llm.queries import PIECE_BPE
model, r = pieces.Model(PIECE_BPE), random.Random(4)
unit = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(4_000_000))
want = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode(unit[:20000])
assert np.frombuffer(model.encode([unit[:20000].encode()], chunk=700)[0], "<u4").tolist() == want
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert np.frombuffer(model.encode([unit.encode()])[0], "<u4")[: len(want) - 50].tolist() == want[:-50]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 300


def test_ranges_find_every_occurrence():
    r = random.Random(2)
    text = "".join(r.choice("ab") for _ in range(400))
    codes = np.array([ord(c) for c in text], np.int64)
    order = pieces.suffix_array(codes, 8)
    words = ["a", "b", "ab", "abba", "bbbb", "abababab", "c", "ac", "z"]
    low, high = pieces.ranges(codes, order, *pieces.grid_of([[ord(c) for c in w] for w in words]))
    for w, a, b in zip(words, low, high, strict=True):
        assert sorted(order[a:b].tolist()) == [i for i in range(400) if text.startswith(w, i)]


def test_pieces_on_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "two  words\n", "z"), (3, "same", "z"), (3, "same", "z"), (4, "long word " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    encoded = pieces.encode(df, PIECE_BPE)
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in pieces.decode(encoded, PIECE_BPE).collect()), key=str)
    assert got == sorted(((i, library().encode(t or ""), t or "") for i, t, _ in rows), key=str)
    assert pieces.digest(pieces.encode(df.filter("false"), PIECE_BPE), PIECE_BPE).count() == 0


def test_query_over_a_whole_table(spark):
    from docprov.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op6_pieces"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_tokens"] == len(library().encode(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_champions_are_few(spark):
    """A sixteenth of the vectors and 64 MB at most; on the given table that is far fewer dense products than vectors."""
    for n, dims in ((2000, 64), (100_000, 64), (10**9, 64), (10**6, 1024), (10**6, 4096), (0, 0), (10, 3)):
        each = max_score.champions_each(n, dims)
        assert 2 * dims * each * dims * 8 <= 64 << 20 and each <= 32
        assert 2 * dims * each <= max(n // 16, 2 * dims)
    from docprov.llm.max_score import quantised

    rows = quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    n = rows.count()
    assert max_score.champions(rows, max_score.champions_each(n, 64)).count() <= n / 15
