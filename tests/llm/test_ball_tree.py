"""Ranked lexical search against brute force; bounds against exact figures."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from docprov.llm import ball_tree
from docprov.llm.ball_tree import Rows, Tree
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    n, total = len(found), sum(x for _, x, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    for i, ts in asked.items():
        scored = []
        for doc_id, length, c in found:
            m = 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus(n=400, seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("An", "be", "cé", "日", "x1", "zz") for b in range(30)]
    docs = [(i * 3 % (n + 1), " ".join(r.choices(words[: r.choice([20, 90, 180])], k=r.randint(1, 60)))) for i in range(n)]
    docs += [(None, "an0 an1 an2 an0"), (2**63 - 1, "an0 an1 an2 an0"), (-5, None), (7, ""), (8, "!!! ?"), (9, "an0 an1 an2 an0"), (9, "an0 an1 an2 an0"), (11, "An0,An0;AN0 É é" + " filler" * 3000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(12)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "AN0 an0 an1"), (53, "an2"), (None, "an0 é"), (54, "an0 an0 an1")]
    return docs, items


@pytest.mark.parametrize(("values", "parts", "k"), [(1 << 21, 256, 50), (300, 2, 7), (1, 1, 3)])
def test_ranks_are_those_of_brute_force(spark, values, parts, k):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS item", "2 AS rank", "3 AS `a.b`").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = [tuple(r) for r in ball_tree.rank(d, q, k, values, parts).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, k), key=str)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items = corpus(60)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = ball_tree.asked_in_blocks
    monkeypatch.setattr(ball_tree, "asked_in_blocks", lambda x: whole(x, 900))
    assert len(list(ball_tree.asked_in_blocks(q))) > 2
    got = [tuple(r) for r in ball_tree.rank(d, q).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)
    for a, b in ((d.filter("false"), q), (d, q.filter("false")), (d.filter("text is null"), q)):
        assert ball_tree.rank(a, b).count() == 0


def sparse(n, terms, seed, scale=10**9):
    rng = np.random.default_rng(seed)
    topics = rng.random((5, terms)) ** 6
    sets = [np.flatnonzero(rng.random(terms) < topics[rng.integers(5)] * 0.5 + 0.01) for _ in range(n)]
    sets = [s if len(s) else np.array([0]) for s in sets]
    return Rows(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), np.concatenate(sets), rng.integers(1, scale, sum(map(len, sets))))


@pytest.mark.parametrize("scale", [3, 10**5, 10**10])
def test_no_row_lies_above_a_bound_nor_outside_a_ball(scale):
    rows = sparse(500, 120, 7, scale)
    tree = Tree(rows, np.stack((np.zeros(500, np.int64), np.arange(500)), 1), 120, leaf=16)
    assert sorted(tree.names[:, 1].tolist()) == list(range(500))
    rng = np.random.default_rng(8)
    below = {}

    def members(k):
        _, _, _, left, right, start, stop = tree.nodes[k]
        below[k] = list(range(start, stop)) if left is None else members(left) + members(right)
        return below[k]

    assert len(members(0)) == 500
    for k, own in below.items():
        ids, mean, radius = tree.nodes[k][:3]
        centre = {int(t): Fraction(float(m)) for t, m in zip(ids, mean, strict=True)}
        for i in own[:20]:
            s = slice(tree.rows.at[i], tree.rows.at[i + 1])
            row = dict(zip(tree.rows.ids[s].tolist(), tree.rows.values[s].tolist(), strict=True))
            assert sum((row.get(t, 0) - c) ** 2 for t, c in centre.items()) <= Fraction(radius) ** 2
    for _ in range(20):
        asked = np.sort(rng.choice(120, rng.integers(1, 30), replace=False))
        one = np.zeros(120, np.int64)
        one[asked] = 1
        scores = tree.rows.dot(one)
        for k, own in below.items():
            assert max(scores[own]) <= tree.bound(k, asked)


def test_subtrees_are_left_out():
    """Documents of topics of their own: a query of one topic scores few leaves, and has the best rows."""
    rng, n, topics = np.random.default_rng(2), 6000, 10
    topic = rng.integers(0, topics, n)
    ids = np.concatenate([np.sort(rng.choice(20, 8, replace=False)) + 20 * t for t in topic])
    rows = Rows(np.arange(0, 8 * n + 1, 8), ids, rng.integers(900, 1000, 8 * n))
    tree = Tree(rows, np.stack((np.zeros(n, np.int64), np.arange(n)), 1), 20 * topics)
    leaves = sum(x[3] is None for x in tree.nodes)
    one, empty = np.zeros(20 * topics, np.int64), (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    for t in (0, 4, 9):
        asked = np.arange(20 * t + 2, 20 * t + 9)
        (scores, names), scored = tree.search(asked, empty, 10, one)
        dense = np.zeros(20 * topics, np.int64)
        dense[asked] = 1
        every = rows.dot(dense)
        assert scores.tolist() == np.sort(every)[::-1][:10].tolist() and (every[names[:, 1]] == scores).all()
        assert scored < leaves / 2 and not one.any()


def test_terms(spark):
    texts = ["A-Z: É é İ \x7f~a_b`c 日本1", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(ball_tree.terms_of(F.col("text"))).collect()
    assert [r[0] for r in rows] == [terms(t) for t in texts]
    assert [t.decode() for t in ball_tree.TERM.findall(texts[0].encode().lower())] == terms(texts[0])
