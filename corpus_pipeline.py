"""Documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage takes empty tables, null ids and texts, empty and very long texts, repeated rows, and columns beyond
``COLUMNS`` whatever their names; what becomes of them is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.llm import decontam, minhash, packing, quality, suffix
from uttermark.llm.work import folder, small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_SCORE = 0.3  #: least quality score of a document that stays
REPEAT_BYTES = 50  #: shortest repeated string that is removed


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is at least ``KEEP_SCORE``; all, if nothing is labelled in both ways.

    Rows are scored one by one, so repeated rows stay or go together, and a null text is scored as an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    net = quality.fit(docs, labels)
    if net is None:
        return docs.select(COLUMNS)
    scored = quality.score(docs, net, keep=["text", "lang", "source", "n_chars"])
    return scored.where(F.col("score") >= KEEP_SCORE).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: five-word shingles, similarity 0.8 or more.

    The smallest id stays. Rows of one id are one document and stay or go together. Rows with a null id, and texts
    without a word, are copies of nothing and stay.
    """
    found = minhash.components_of(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    found = small(written(found, f"{folder(spark)}/copies"))
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of ``REPEAT_BYTES`` bytes that also start in a document with a smaller id. A character of
    which only some bytes are left goes too, and so does a document of which nothing but space is left.

    Documents of which nothing is cut stay as they are, empty and null texts too; so do rows with a null id, and rows
    of one id cut nothing from each other.
    """
    cut = suffix.remove_repeats(docs, width=REPEAT_BYTES, keep=["text", "lang", "source", "n_chars"], as_text=True)
    whole = F.size("starts") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("kept")).cast("long")
    left = cut.where(whole | (F.length(F.trim("kept")) > 0))
    return left.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item: five-word shingles, containment 0.8 or more.

    All rows of such an id go. Rows with a null id stay, and so do empty and null texts.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row for each piece of a document. Each row is packed by itself; a null or empty text is
    the separator alone."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Networks and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = folder(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
