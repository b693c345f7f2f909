"""A corpus pipeline of five stages, each of which takes the rows that the one before it kept.

All stages decide by row, so that null ids, ids of several texts and repeated rows are rows like others; they read whole
texts, however long, return the columns of documents without any others, and give an empty result for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.cluster import ship
from lodeseek.llm import bpe, langid, mixing, setsketch, weak_quality
from lodeseek.llm.common import numbered, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates share so many hundredths of their five-word shingles at least; op6's own query is stricter.
NEAR = 80
#: Bytes of one batch of rows on its way to Python. Spark's own bound of 64 MB is held several times over in each task, by
#: the JVM while a batch grows and by the worker that reads it; results do not depend on how rows are cut into batches.
BATCH_BYTES = "2m"


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one that is hardly likely, go.

    Those are all whose text is null, empty or without a letter. Rows of equal texts stay or go together. Where no row
    has a language to learn from, none is likely, and all go."""
    _ready(spark)
    found = langid.identify(docs.select(*COLUMNS), *COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (found["score"] >= langid.REJECT_BELOW)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer does not keep go.

    Those are all whose text is null or has no word. Rows of equal texts stay or go together."""
    _ready(spark)
    return weak_quality.classify(docs.select(*COLUMNS), *COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, the first by id, null ids last; of equal ids any one row.

    A row without words, null texts among them, is like no other and stays."""
    _ready(spark)
    # by row, not by doc_id: ids may be null or stand in rows of different texts
    rows = numbered(docs.select(*COLUMNS))
    gone = setsketch.redundant(rows.select("row_no", "doc_id", "text"), NEAR)
    return rows.join(gone, "row_no", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, to the nearest whole; those that it hardly takes go.

    A source's mix is its shuffled stream of documents, once, twice or in part, so the mix takes all of a document or
    nothing, but for one document in each source, the one at which its words are full. Documents are not cut: that one
    stands once more or not at all, so a source's words are within half of that document's of the target. Texts that
    are null or without words have no share, and go; repeated rows count each."""
    _ready(spark)
    rows = numbered(docs.select(*COLUMNS))
    mixture, placed = mixing.mixture(rows.select("doc_id", "text", "source", "row_no"), 0, mixing.BLOCK, "row_no")
    words = mixture.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    times = placed.join(words, "uid").select("row_no", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    copies = rows.join(times, "row_no")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; a null text is an empty one, with no tokens."""
    _ready(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id")


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("mixing to target weights", mix),
    ("byte-level BPE", encode),
]

#: The fitted models of the first two stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
