"""The corpus pipeline: language ID, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which its predecessor kept; the caller writes its result as
Parquet and reads that again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.llm import exact_dedup, language_id, near_copies, secret_scan
from docprov.llm.queries import packed
from docprov.llm.shared import table, written

#: Documents whose best language is less sure than this are rejected, and those without letters.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, and that column's name, which docs doesn't have."""
    names, name = {c.lower() for c in docs.columns}, "_row"
    while name in names:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those of `und` or a score below LEAST_SCORE go.

    Null and empty texts and those without letters go. Ties go to the language that sorts first; with two of equal score, each
    has 0.5 and the document stays. Rows are judged one by one, repeated ones alike. Other columns may have any name and stay. An
    empty table gives no rows.
    """
    rows, name = _numbered(docs)
    found = language_id.identify(rows, number=name)
    stay = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return rows.join(stay.select(F.col("row").alias(name)), name, "left_semi").drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id (null last).

    Null texts count as empty, and one of all empty texts stays. Of rows that tie in length and doc_id, whole repeated rows too,
    one stays. Other columns may have any name and stay. An empty table gives no rows.
    """
    rows, name = _numbered(docs)
    stay = exact_dedup.exact_dedup(rows, number=name).filter("kept")
    return rows.join(stay.select(F.col("row").alias(name)), name, "left_semi").drop(name)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest doc_id (null last).

    SimHash links are verified, and so are those at lower similarity that it misses at three bits. Null texts count as empty,
    and texts without words are alike. Of rows that repeat a doc_id, or whole rows, one of a group stays. Other columns may have
    any name and stay. An empty table gives no rows.
    """
    rows, name = _numbered(docs)
    gone = near_copies.superfluous(rows, name)
    return rows.join(gone.select(F.col("id").alias(name)), name, "left_anti").drop(name)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew.

    Null texts stay null, with an n_chars of null; empty ones stay empty. Overlapping secrets become one mask. Repeated rows stay
    alike. Other columns may have any name and stay. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed_up = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("others"), "text")
    masked = secret_scan.redact(secret_scan.scan(packed_up))
    back = {c: F.col("others").getField(f"c{i}") for i, c in enumerate(others)}
    back |= {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return masked.select(*(back[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences, a row per piece.

    Null and empty texts have one piece, of the end id alone. Pieces of equal length are taken in the order they were read;
    repeated rows have pieces each. Other columns are left behind. An empty table gives no rows.
    """
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Fingerprints and trained scores can't be told in SQL: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one behind another, on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
