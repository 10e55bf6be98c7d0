"""The corpus pipeline: documents to packed token sequences, in five stages.

Each stage takes what its predecessor kept and returns a DataFrame, which is written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.llm import decontam, jaccard, packing, secrets, toxicity
from cairnmap.llm.common import discard, documents, shared_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger, fitted on the labelled ones, does not reject.

    Every row is judged by its own text, with null and repeated ids too; empty and null
    texts stay; without labels of both classes nothing is known and all rows stay, unless
    all labels are toxic.
    """
    return toxicity.clean(docs, toxicity.learn(docs, documents(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates (five-word shingles, 0.8).

    All rows of that id stay; so do rows with null ids and texts without words.
    """
    return jaccard.representatives(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans of benchmark items; documents that consist of them for the most part go.

    Every row is cleaned by itself, with null and repeated ids too; null texts stay null.
    """
    return _counted(decontam.clean(docs, documents(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking secrets masked; copied examples stay, no row goes.

    Null and repeated ids are treated like any other; null texts stay null.
    """
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; a null or empty text is one end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: The classifier of the first stage has no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    A stage's folder is removed once the next stage is written; the last one is the result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            discard(spark, f"{folder}/{last}")
        last = name
    return docs
