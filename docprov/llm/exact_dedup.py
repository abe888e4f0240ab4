"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, every chunk gets an identifier, and two texts are equal when their
ordered lists of identifiers (recipes) are. Identifiers are verified: one pass groups the chunks by identifier and
compares the bytes, so that equal recipes mean equal texts. In that pass a chunk leaves each map task once, however
many copies the task holds; no later shuffle moves text, only recipes of a few identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: White space that equality ignores.
BLANK = r"[\x20\x09-\x0D]+"
#: Code points a cut may follow when two of them stand together; their code point is 3 modulo 8.
CUT = r"[#+3;CKS\[cks{]"


def chunk_pattern(least: int = 1024, most: int = 8192) -> str:
    """A chunk ends behind the first pair of CUT code points after `least`; without one, at `most` or the text's end."""
    return rf"(?s).{{{least},{most}}}?(?:(?<={CUT}{CUT})|\z)|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def chunks(text: Column, least: int = 1024, most: int = 8192) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def _wide(c: Column) -> Column:
    return F.array(F.xxhash64(c), F.xxhash64(F.lit(1), c))


def _digest(c: Column) -> Column:
    return F.array(*(F.conv(F.substring(F.sha2(c, 256), i, 16), 16, -10).cast("bigint") for i in (1, 17, 33, 49)))


def collisions(docs: DataFrame, identify, least: int = 1024, most: int = 8192) -> DataFrame:
    """Identifiers that stand for two different chunks (compared byte by byte)."""
    return (
        docs.select(F.explode(chunks(normalised(F.col("text")), least, most)).alias("chunk"))
        .select(identify(F.col("chunk")).alias("id"), "chunk")
        .groupBy("id")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("id")
    )


def recipes(docs: DataFrame, least: int = 1024, most: int = 8192, number: str | None = None) -> DataFrame:
    """row (the column `number`, else null), doc_id, n_points, text_sha256 and recipe (array of bigint) of every row; verified,
    then written.

    Identifiers of 128 bits are tried first. Should two chunks share one, identifiers of 256 bits are taken, verified
    in the same way.
    """
    for identify in (_wide, _digest):
        if collisions(docs, identify, least, most).isEmpty():
            break
    else:
        raise ValueError("two chunks share a SHA-256")
    row = (F.col(number) if number else F.lit(None)).cast("long").alias("row")
    norm = docs.select(row, "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("norm"))
    return written(
        norm.select(
            "row",
            "doc_id",
            "n_points",
            F.sha2("norm", 256).alias("text_sha256"),
            F.flatten(F.transform(chunks(F.col("norm"), least, most), identify)).alias("recipe"),
        ),
        "recipes",
    )


def exact_dedup(docs: DataFrame, least: int = 1024, most: int = 8192, number: str | None = None) -> DataFrame:
    """One row per row of docs: row, doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored, whatever their names. Texts are equal when identical without
    the characters of BLANK; null counts as empty, and all empty texts are equal. The row with the most code points
    in the original text stays, of those the smallest doc_id (null last). doc_id names a row: rows that repeat a doc_id
    and the length of its text are counted in group_size and share one decision. number: a column of different longs, given as
    row in the result; with it, only the smallest of those is kept. An empty table gives no rows.
    """
    r = recipes(docs, least, most, number)
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    groups = r.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = written(groups.select(F.col("recipe").alias("of"), "best.keep_id", "best.keep_row", (-F.col("best.less")).alias("keep_points"), "group_size"), "groups")
    return r.join(groups, r["recipe"] == groups["of"]).select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & F.col("row").eqNullSafe(F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
h AS (SELECT doc_id, pts, sha256(norm) AS text_sha256 FROM n),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
