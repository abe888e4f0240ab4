"""Stage near_dedup against the Jaccard similarity of five-word shingles, counted pair by pair."""

import random

import corpus_pipeline as cp
import numpy as np
from docprov.llm import components, near_copies
from docprov.llm.shared import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) <= 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_kept(rows, least=0.8):
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                root[x] = y
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append((rows[i][0] is None, rows[i][0] or 0))
    return sorted(min(g) for g in groups.values())


def near(spark, docs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in cp.near(spark, docs, SF).collect())


def test_planted_copies_from_70_to_95_percent(spark):
    """Copies with words replaced; SimHash at three bits passes nearly all of them."""
    rng, rows = random.Random(5), []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows.append((k, " ".join(words)))
        copy = list(words)
        for i in rng.sample(range(400), 2 + k % 14):
            copy[i] = f"x{rng.randrange(5000)}"
        rows.append((1000 + k, "  ".join(copy).upper()))
    rows += [(2000, " "), (2001, None), (2002, "two words"), (2003, "TWO\nwords"), (None, rows[0][1])]
    want = brute_kept(rows)
    assert 20 < len(rows) - len(want) < 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    assert near(spark, docs) == want


def test_a_large_group_of_copies_of_copies(spark):
    """A chain: only neighbours are alike; and the copies of one text, which fill every bucket."""
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(300)], []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for i in range(5 * k, 5 * k + 5):
            words[i] = f"y{i}"
    base = [f"z{i}" for i in range(300)]
    for k in range(100):
        copy = list(base)
        for i in rng.sample(range(300), 4):
            copy[i] = f"q{k}"
        rows.append((500 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    assert near(spark, docs) == brute_kept(rows)


def test_documents(spark):
    docs = table(spark, SF, "documents")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert near(spark, docs) == want and len(want) < docs.count()


def test_buckets_in_parts(spark):
    """Cut buckets lose no link, and all links of one group come to no more than its rows need in each pair of parts."""
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(1000 * (i % 4), 1000 * (i % 4) + 60), 56)) for i in range(40)]
    rows = [(1, 3, i, i, bytearray(60), [i * 100 + k if k < 3 else 7 for k in range(20)]) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, band int, id long, comp long, sig binary, keys array<long>")
    own = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)], "id long, set binary")
    want = {i: i for i in range(40)}
    for i in range(40):
        for j in range(i):
            if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])):
                low, high = sorted((want[i], want[j]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert 1 < len(set(want.values())) < 40
    for tile in (7, 40, 512):
        links = near_copies.open_links(df, own, 0.8, tile)
        assert links.count() < 40 * -(-40 // tile)
        got = {r["node"]: r["component"] for r in components.components(links).collect()}
        assert {i: got.get(i, i) for i in range(40)} == want
    assert near_copies.open_links(df.withColumn("comp", F.lit(3).cast("long")), own, 0.8, 7).count() == 0
    assert near_copies.open_links(df.withColumn("band", F.lit(4)), own, 0.8, 7).count() == 0  # taken in the first common one
