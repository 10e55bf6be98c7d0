"""The thin queries over the whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.digest(decontam.decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), with_text=False))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import superkmer

    return superkmer.digest(superkmer.dedup_windows(documents(spark, sf_dir)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(documents(spark, sf_dir), words=3, percent=90)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hnsw

    return hnsw.digest(hnsw.near_duplicates(documents(spark, sf_dir, "embeddings")))


def op8_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pfp

    return pfp.digest(pfp.dedup_bytes(documents(spark, sf_dir)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linkgraph

    return linkgraph.digest(linkgraph.judge(documents(spark, sf_dir, "pages")))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_window_dedup": op3_window_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_byte_dedup": op8_byte_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_pack": op10_pack,
}


def oracles() -> dict[str, str]:
    from . import decontam, hnsw, jaccard, linkgraph, secrets, superkmer

    return {"op1_secret_scan": secrets.oracle(), "op2_decontaminate": decontam.ORACLE, "op3_window_dedup": superkmer.ORACLE, "op4_jaccard_join": jaccard.ORACLE, "op7_vector_dedup": hnsw.ORACLE, "op9_url_filter": linkgraph.oracle()}
