"""The pipeline against brute force over what each stage gets."""

import re

import corpus_pipeline as cp
import numpy as np
from docprov.llm.shared import table, written
from pyspark.sql import functions as F

from .test_native import KEY, brute_spans
from .test_near_copies import brute_kept
from .test_tokens import WORD_BPE, ids_of

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))


def planted(spark):
    docs = table(spark, SF, "documents")
    copy = docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 100000).withColumn("text", F.concat("text", F.lit(" \n")))
    odd = spark.createDataFrame([(200000, None, None, None, None), (200001, " 12 ", "en", "s", 4), (200002, "", "en", "s", 0), (None, f"no id but a key {KEY} there", "en", "s", 1)], docs.schema)
    return docs.unionByName(copy).unionByName(odd)


def test_stages(spark):
    docs = planted(spark)
    before = rows_of(docs)
    out = written(cp.STAGES[0][1](spark, docs, SF), "a")
    assert out.columns == docs.columns
    kept = rows_of(out)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in kept}
    assert {200000, 200001, 200002} <= gone
    letters = [r for r in before if re.search(r"[^\W\d_]", r["text"] or "")]
    assert len(kept) >= 0.99 * len(letters)

    out = written(cp.STAGES[1][1](spark, out, SF), "b")
    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    kept = rows_of(out)
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted((min(g)[3] for g in groups.values()), key=str)

    out = written(cp.STAGES[2][1](spark, out, SF), "c")
    want = brute_kept([(r["doc_id"], r["text"]) for r in kept])
    kept = rows_of(out)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == want
    texts = {r["doc_id"]: r["text"] for r in before if r["doc_id"] is None or r["doc_id"] < 200000}
    assert all(r["text"] == texts[r["doc_id"]] for r in kept)

    out = written(cp.STAGES[3][1](spark, out, SF), "d")
    masked = rows_of(out)
    assert [r["doc_id"] for r in masked] == [r["doc_id"] for r in kept]
    for r, old in zip(masked, kept, strict=True):
        assert brute_spans(r["text"]) == "" or brute_spans(old["text"]) != ""
        assert (r["text"] == old["text"]) == (brute_spans(old["text"]) == "") and r["n_chars"] == len(r["text"])
    assert any(KEY in r["text"] for r in kept) and not any(KEY in r["text"] for r in masked)

    packed = cp.STAGES[4][1](spark, out, SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids_of(WORD_BPE, r["text"])) + 1 for r in masked)


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())
    assert len({r["doc_id"] for r in rows}) <= table(spark, SF, "documents").count()
    assert np.all([r["length"] <= 4096 for r in rows])


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").filter("false")
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, SF), name)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


NAMES = ["_row", "_kept", "_gone", "secrets", "_cand", "_cand_id", "row", "id", "word", "others", "recipe", "l0"]


def test_repeated_rows_and_clashing_names(spark):
    """Rows that repeat whole, repeat a doc_id with another text, or tie; every stage's own names among the columns."""
    long = " ".join(f"word{i} of the text" for i in range(200))
    rows = [(1, long), (1, long), (1, long.replace("word7 ", "other ")), (1, "quite another text here and there"), (2, f"key {KEY} in the text"), (2, f"key  {KEY} in the text"), (3, f"key {KEY} in the text"), (None, long), (None, None), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))
    want = {
        "language_id": [r for r in rows if r[1]],
        "exact_dedup": [(1, long), (1, rows[2][1]), (1, rows[3][1]), (2, rows[5][1])],
        "near_dedup": [(1, long), (1, rows[3][1]), (2, rows[5][1])],
        "secret_scan": [(1, long), (1, rows[3][1]), (2, "key  [SECRET] in the text")],
    }
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == df.columns
        got = docs.collect()
        assert [r.asDict()[c] for r in got for c in NAMES] == list(range(len(NAMES))) * len(got)
        if name == "near_dedup":  # of equal doc_ids, either of the two may stay
            assert sorted(len(r["text"]) // 100 for r in got) == sorted(len(t) // 100 for _, t in want[name])
            docs = spark.createDataFrame(want[name], "doc_id long, text string").join(df.drop("doc_id", "text").limit(1)).select(df.columns)
        else:
            assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want[name], key=str)
    whole = [r for r in cp.near(spark, df, SF).collect() if r["text"]]
    assert sorted(len(r["text"]) // 100 for r in whole) == sorted(len(t) // 100 for _, t in [(1, long), (1, rows[3][1]), (2, rows[4][1])])
    assert len(cp.near(spark, df, SF).collect()) == 4 and len(cp.exact(spark, df, SF).collect()) == 5
    packed = cp.packing(spark, df, SF).collect()
    assert len([r for r in packed if r["doc_tokens"] == 1]) == 3
