"""Groups of packing are bounded in rows too."""

from docprov.llm import packing
from docprov.llm.queries import WORD_BPE
from pyspark.sql import functions as F


def test_empty_texts_are_dealt_to_several_groups(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    groups = packing.groups_for(docs, size=64, group_rows=60)
    rows = packing.placed(packing.pack(packing.pieces(docs, WORD_BPE, "word", end_id=2, size=64), groups, size=64)).collect()
    assert len(rows) == 400 and len({r["sequence_id"] >> 32 for r in rows}) == groups == 7
