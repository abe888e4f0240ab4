"""The thin opN_<name> queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, exact_dedup, infill, language_id, max_score, packing, pieces, planes, quality, secret_scan, simhash, suffix_dedup, warc
from .shared import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score.top_k(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(table(spark, sf_dir, "documents"), PIECE_BPE), PIECE_BPE)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).drop("row")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.repeats(table(spark, sf_dir, "documents")))


def packed(docs: DataFrame) -> DataFrame:
    """The digest columns of op9 and of the pipeline's last stage, from the padded sequences."""
    built = packing.pack(packing.pieces(docs, WORD_BPE, "word", end_id=2), packing.groups_for(docs))
    return packing.placed(built).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planes.write_corpus(table(spark, sf_dir, "documents"), BYTE_BPE, "byte", end_id=0)
    return planes.read_corpus(spark, files).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_warc": op2_warc,
        "op3_max_score": op3_max_score,
        "op4_secret_scan": op4_secret_scan,
        "op5_simhash": op5_simhash,
        "op6_pieces": op6_pieces,
        "op7_language_id": op7_language_id,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_packing": op9_packing,
        "op10_token_planes": op10_token_planes,
        "op11_ball_tree": op11_ball_tree,
        "op12_infill": op12_infill,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_warc": warc.ORACLE,
        "op3_max_score": max_score.ORACLE,
        "op4_secret_scan": secret_scan.ORACLE,
        "op11_ball_tree": ball_tree.ORACLE,
        "op12_infill": infill.ORACLE,
    }
