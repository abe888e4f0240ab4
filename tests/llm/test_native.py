"""Exact dedup and secret scans against brute force in Python."""

import hashlib
import re
import time

import pytest
from docprov.llm import exact_dedup, secret_scan
from pyspark.sql import functions as F

KEY = "AKIA" + "A1" * 8
TEXTS = [
    (1, "Same text\n", "a"),
    (2, "Sametext", "b"),
    (3, "S a m e text   ", "c"),
    (4, None, None),
    (5, "", "x"),
    (6, " \t\r\n", "y"),
    (7, "ck" * 30000, "long"),
    (8, "ck " * 30000, "long"),
    (9, "ck" * 30000 + "!", "long"),
    (None, "same text", "z"),
    (12, "same text", "z"),
    (12, "same text", "z"),
    (13, "é ſecret=aaaaaaaaa", "z"),
    (14, f"PassWord : 'abcdefgh1' token:short {KEY} secret={'0f' * 20} api_key=\"{'x' * 9}\"", "z"),
    (15, "\U0001f600 token=token=abcdefgh AKIAshort " + "f" * 31 + " " + "f" * 32, "z"),
    (15, "api key=12345678 apikey=12345678", "z"),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, secrets string").withColumn("recipe", F.lit(1)).repartition(3)


def brute_dedup():
    groups = {}
    for doc_id, text, _ in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {norm: (min(g)[3], min(g)[0], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("sizes", [(1024, 8192), (3, 5), (1, 1)])
def test_exact_dedup(spark, sizes):
    want = brute_dedup()
    rows = exact_dedup.exact_dedup(docs(spark), *sizes).collect()
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(rows) == len(TEXTS)
    for r in rows:
        keep, _, n = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (keep, n)
        if r["kept"]:
            assert r["doc_id"] == keep
    assert {r["text_sha256"] for r in rows if r["kept"]} == set(by_sha)
    assert exact_dedup.exact_dedup(docs(spark).filter("false")).count() == 0


def test_cuts_follow_content(spark):
    text = ("lorem ckipsum skdolor " * 400).replace(" ", "")
    df = spark.createDataFrame([(text,), ("shift" + text,)], "text string")
    a, b = (set(r[0]) for r in df.select(exact_dedup.chunks(F.col("text"), 64, 512)).collect())
    assert len(a & b) >= len(a) - 3


def test_collisions_are_found_and_answered(spark):
    assert exact_dedup.collisions(docs(spark), lambda c: F.length(c)).count() > 0
    assert exact_dedup.collisions(docs(spark), exact_dedup._digest).count() == 0


def brute_spans(text):
    rules = (
        ("assign", re.compile(secret_scan.RULES[0].regex, re.ASCII), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    )
    found = [(m.start(), k, m.end()) for k, (_, r, g, n) in enumerate(rules) for m in r.finditer(text or "") if len(m[g]) >= n]
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(spark):
    scanned = secret_scan.scan(docs(spark))
    assert sorted(r["spans"] for r in secret_scan.report(scanned).collect()) == sorted(brute_spans(t) for _, t, _ in TEXTS)
    assert secret_scan.scan(docs(spark).filter("false")).count() == 0
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.redact(scanned).collect() if r["doc_id"] in (4, 9, 14)}
    assert hidden[14] == "[SECRET]' token:short [SECRET] [SECRET] [SECRET]\"" and hidden[9] == TEXTS[8][1] and hidden[4] is None


def test_secrets_of_rows_with_clashing_columns(spark):
    names = ["_cand", "_cand_id", "secrets", "row", "cand", "m0", "p0", "pieces", "raw", "reach", "gaps", "a.b"]
    df = docs(spark).drop("secrets", "recipe").select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    scanned = secret_scan.scan(df)
    assert scanned.columns == [c for c in df.columns if c != "secrets"] + ["secrets"]
    assert sorted(r["spans"] for r in secret_scan.report(scanned).collect()) == sorted(brute_spans(t) for _, t, _ in TEXTS)
    rows = secret_scan.redact(scanned).collect()
    assert len(rows) == len(TEXTS) and rows[0].asDict()["a.b"] == names.index("a.b") and rows[0]["_cand"] == 0


def test_overlapping_secrets_are_masked_as_one(spark):
    text = "é AKIA" + "A" * 12 + "0" * 32 + "abc, é token=" + "a" * 40 + "日"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret_scan.scan(df)).collect()}
    assert got == {1: "é [SECRET], é [SECRET]日", 2: None, 3: ""}


def test_a_text_of_very_many_secrets(spark):
    """Time grows with the text: 100,000 secrets in one text, and 1,000 around the sizes that lists are cut at."""
    many = "".join(f"ü token={i:08d}x, {i:032x} " for i in range(50_000))
    sizes = {i: "".join(f"é {KEY} " for _ in range(i)) for i in (1, 255, 256, 257, 512, 513)}
    rows = [(0, many), *sizes.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    scanned = secret_scan.scan(df)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(scanned).collect()}
    assert all(got[i] == brute_spans(t) for i, t in rows)
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redact(scanned).collect()}
    assert masked[0] == "ü [SECRET], [SECRET] " * 50_000 and all(masked[i] == "é [SECRET] " * i for i in sizes)
    assert time.time() - start < 60


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert q("[0-9a-f]{32,}") is None
    assert q("(abcd|xyz)?e+") is None
    assert q("(?i:abcd|xyz)e?") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert frozenset({"tok", "oke", "ken"}) in q(secret_scan.RULES[0].regex)
    for rule in secret_scan.RULES:
        for clause in q(rule.regex) or ():
            assert all(len(g) == 3 for g in clause)
