"""Quality scores: features and updates against plain Python, held-out documents, odd rows."""

import math
import re
import zlib

import numpy as np
import pytest
from docprov.llm import quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute_words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20\x7f0-9A-Za-z\x80-\xff]+", text)


def test_equal_words_have_equal_hashes():
    text = "It's é é, IT's  !! x!!y\n\x00tail é ab ba 日本 日 本 a aa aaa".encode()
    found = brute_words(text)
    hashes = quality.words(text).tolist()
    assert len(hashes) == len(found)
    assert len(set(hashes)) == len(set(found)) == len(set(zip(hashes, found, strict=True)))
    assert quality.words(b"zz " + text).tolist()[1:] == hashes
    assert len(quality.words(b"")) == len(quality.words(b" \n")) == 0


def brute_features(text, bits):
    """(counts of places) by big integers."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & mask
        return (h ^ (h >> 32)) >> (64 - bits)

    h = [sum((b + 1) * pow(quality._BASE, i, 1 << 64) for i, b in enumerate(w)) & mask for w in brute_words(text)]
    pairs = [1 if a == b else (a * 0x2545F4914F6CDD1D + b) & mask for a, b in zip(h, h[1:], strict=False)]
    counts = {}
    for x in [mixed(x) for x in h] + [mixed(x ^ 0x5851F42D4C957F2D) for x in pairs]:
        counts[x] = counts.get(x, 0) + 1
    return counts


@pytest.mark.parametrize("section", [1 << 20, 7])
def test_features(monkeypatch, section):
    monkeypatch.setattr(quality, "_SECTION", section)
    for text in ("", "one", "Er Er Er Er", "THE!! OF!! a | b | a | b, é é\n" * 20, " lead", "w" * 300 + " tail"):
        places, values = quality.features(text.encode(), 12)
        want = brute_features(text.encode(), 12)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in want.values())) or 1
        assert places.tolist() == sorted(want)
        assert np.allclose(values, [math.log1p(want[k]) / norm for k in sorted(want)])


def test_updates_are_those_of_the_regularised_leader():
    rng, leader = np.random.default_rng(1), quality.Leader(3, alpha=0.5, beta=1.0, l1=0.05, l2=0.2)
    z, n = [0.0] * 9, [0.0] * 9
    for _ in range(200):
        places, label = np.sort(rng.choice(8, 3, replace=False)), int(rng.integers(2))
        x = rng.random(3)
        at = [*places.tolist(), 8]
        w = [0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.2) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*x, 1.0], strict=True))))
        for i, wi, xi in zip(at, w, [*x, 1.0], strict=True):
            g = (p - label) * xi
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
            z[i] += g - s * wi
            n[i] += g * g
        leader.learn(places, x, label)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert np.mean([s >= 0.5 for s in good]) >= 0.98 and np.mean([s < 0.5 for s in bad]) >= 0.9
    # what the held-out rows' labels are has no effect, nor have the other columns
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs.withColumn("lang", F.lit("x")).repartition(5), turned).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_odd_rows(spark):
    rows = [(None, "no id", "a"), (1, None, "a"), (2, "", "b"), (3, "good words here", "c"), (3, "good words here", "c"), (4, "BAD!! BAD!!", None), (5, "x " * 900_000, "d"), (6, "BAD!! words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS label", "2 AS score", "3 AS places", "4 AS `a.b`")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (1, None), (6, 0), (77, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    made = quality.examples(docs, labels, "quality", 100)
    want = {i for i in (3, 4, 6) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["doc_id"]: r["label"] for r in made.collect()} == {i: {3: 1, 4: 0, 6: 0}[i] for i in want}
    assert made.count() == len(want) and quality.examples(docs, labels, "quality", 1).count() <= 1
    got = quality.classify(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    untaught = quality.classify(docs, labels.filter("false")).collect()
    assert {(r["score"], r["predicted"]) for r in untaught} == {(0.5, 1)}
    assert quality.classify(docs.filter("false"), labels).count() == 0
