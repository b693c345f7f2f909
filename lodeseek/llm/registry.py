"""Queries of the operators in this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_names, bpe, feistel_shards, hard_negatives, imatch, langid, license_scan, matroska, mixing, setsketch, token_align, url_rules, weak_quality
from .common import table

#: The url rules of op3.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_quality.classify(docs, "doc_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.withColumn("held_out", langid.held_out(docs["doc_id"])), "doc_id", "held_out")
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rules_frame(spark, URL_RULES), "page_id")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 85)


def op7_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_align.counted(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.from_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


def op13_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
