"""Fill-in-middle against brute force over code points."""

import hashlib
import random

import numpy as np
import pytest
from docprov.llm import infill
from pyspark.sql import functions as F

R = random.Random(4)
SHARED = "".join(R.choice("abc é日\U0001f600 <P") for _ in range(5000))
TEXTS = [None, "", "a", "é", "<", "<P", "P>", "ab<P>", "x" * 3000 + "<M>" + "y" * 3000, "<S" + ">" * 3, "no <p> <Q> here", "\U0001f600" * 900, SHARED.replace("<P>", ""), "new " + SHARED.replace("<P>", "-"), "ab " * 9000 + "<", "same", "same", "z" * 20000]


def rows():
    return [*((i * 7 - 3, t) for i, t in enumerate(TEXTS)), (None, "no id at all"), (4, "same"), (4, "same"), (2**63 - 1, "last of ids")]


def brute(doc_id, text, plain=10, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return (doc_id, n, "plain", None, None, text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, m, z = text[:x], text[x:y], text[y:]
    return (doc_id, n, "spm", x, y - x, f"<S>{z}<P>{a}<M>{m}") if h4 % 100 < spm else (doc_id, n, "psm", x, y - x, f"<P>{a}<S>{z}<M>{m}")


@pytest.mark.parametrize(("plain", "spm"), [(10, 20), (0, 50), (0, 100), (100, 0)])
def test_forms_cuts_and_restoring(spark, plain, spm):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS h1", "2 AS output", "3 AS `a.b`").repartition(3)
    made = infill.transform(df, plain=plain, spm=spm).withColumn("back", infill.restored(F.col("form"), F.col("output")))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode()) for r in made.collect()]
    assert sorted(got, key=str) == sorted((brute(i, t, plain, spm) for i, t in rows()), key=str)
    assert sorted(r["back"] for r in made.collect()) == sorted(t or "" for _, t in rows())
    assert infill.transform(df.filter("false")).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"average": 16, "least": 16, "longest": 40}, {"most": 600, "average": 64}])
def test_chunks_measure_and_place(sizes):
    chunks, r = infill.Chunks(**sizes), random.Random(9)
    for _ in range(60):
        text = "".join(r.choice(["a", "é", "日", "\U0001f600", "<", "P", ">", "<S>", "word "]) for _ in range(r.randint(0, 700)))
        if r.random() < 0.7:
            text = text.replace("<S>", "").replace("<P>", "")
        raw = text.encode()
        start = r.randint(0, 50)
        places = infill.hits(np.frombuffer(b"q" * start + raw, np.uint8), chunks.average, section=97).tolist()
        assert places == infill.hits(np.frombuffer(b"q" * start + raw, np.uint8), chunks.average).tolist()
        parts = chunks.cut(raw, places, start)
        assert b"".join(parts) == raw and max(map(len, parts), default=0) <= chunks.longest
        upto, marked = chunks.measure(parts)
        assert (upto[-1] if upto else 0, marked) == (len(text), any(m in text for m in ("<P>", "<S>", "<M>")))
        for point in {0, len(text), *(r.randint(0, len(text)) for _ in range(9))}:
            assert infill.place(parts, upto, point) == len(text[:point].encode())


def test_shared_passages_are_known_chunks():
    r = random.Random(5)
    chunks, passage = infill.Chunks(average=64, least=16), bytes(r.choice(b"abcdefgh ") for _ in range(20_000))
    texts = [b"one " + passage, b"another beginning " + passage + b" end"]
    each = [chunks.cut(t, infill.hits(np.frombuffer(t, np.uint8), 64).tolist(), 0) for t in texts]
    assert len(set(each[0]) & set(each[1])) > 0.9 * len(each[0])
    chunks.measure(each[0])
    assert sum(c in chunks.known for c in each[1]) > 0.9 * len(each[1])


def test_a_long_text_is_cut_right(spark):
    text = "ü日x " * 1_500_000
    df = spark.createDataFrame([(i, text) for i in (1, 2)], "doc_id long, text string")
    got = infill.digest(infill.transform(df, plain=0)).collect()
    want = {i: brute(i, text, 0) for i in (1, 2)}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (*w[1:5], hashlib.sha256(w[5].encode()).hexdigest())
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
