"""Ensemble weights and weighted votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def instance_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """w of each row: (N - n of its class) / N, all rows' weights summing to one.

    Class counts are a small table that joins back; the sum over rows follows from them.
    """
    n = df.groupBy(F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    t = n.agg(F.sum("_n").alias("t"), F.sum(F.col("_n").cast("double") * F.col("_n")).alias("q")).first()
    total, scale = float(t["t"] or 0), float(t["t"] or 0) - float(t["q"] or 0) / float(t["t"] or 1)
    w = n.select("_y", (F.lit((total if total else 1.0)) - F.col("_n")).alias("_w"))
    return df.join(w, df[label] == F.col("_y"), "left").withColumn("w", F.col("_w") / total / F.lit(scale if scale else 1.0)).drop("_y", "_w")


def positive_ratio(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows of class 0 for each of class 1."""
    return df.agg((F.sum((F.col(label) == 0).cast("long")) / F.sum((F.col(label) == 1).cast("long"))).alias("value"))


def ensemble_weights(metrics: DataFrame, power: float, threshold: float) -> DataFrame:
    """run, weight: e^power, 0 below the threshold, summing to one. Raises if no run reaches it."""
    raw = metrics.select("run", F.when(F.col("e") < threshold, 0.0).otherwise(F.pow("e", F.lit(float(power)))).alias("w"))
    total = raw.agg(F.sum("w")).first()[0] or 0.0
    if total <= 0:
        raise ValueError("no run reaches the threshold: all weights are zero")
    return raw.select("run", (F.col("w") / total).alias("weight"))


def hard_vote(votes: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """id, pred, votes: the class with the largest weight sum, the lowest on ties. Runs of no weight are skipped.

    Partial sums are made by each task before anything is shuffled.
    """
    live = weights.where("weight > 0")
    sums = votes.join(live, "run").groupBy(key, "pred").agg(F.sum("weight").alias("v"))
    return sums.groupBy(key).agg(F.max_by("pred", F.struct(F.round("v", 12), -F.col("pred"))).alias("pred"), F.max("v").alias("votes"))


def soft_vote(probs: DataFrame, weights: DataFrame, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """id, p, pred: the weighted sum of probabilities, and whether it reaches the threshold."""
    p = probs.join(weights.where("weight > 0"), "run").groupBy(key).agg(F.sum(F.col("weight") * F.col("prob")).alias("p"))
    return p.withColumn("pred", (F.col("p") >= threshold).cast("int"))


def partial_votes(votes: DataFrame, weights: DataFrame, n_workers: int, key: str = "id") -> DataFrame:
    """worker, id, pred, v: the sums of the runs that are dealt to each worker in turn."""
    dealt = votes.withColumn("worker", F.pmod("run", F.lit(n_workers)).cast("int"))
    return dealt.join(weights.where("weight > 0"), "run").groupBy("worker", key, "pred").agg(F.sum("weight").alias("v"))


def combine_votes(parts: DataFrame, key: str = "id") -> DataFrame:
    sums = parts.groupBy(key, "pred").agg(F.sum("v").alias("v"))
    return sums.groupBy(key).agg(F.max_by("pred", F.struct(F.round("v", 12), -F.col("pred"))).alias("pred"))


def stretch_probabilities(df: DataFrame, mask: str | None = None) -> DataFrame:
    """p of each class divided by its largest (of masked rows); class maxima are a small table."""
    top = df.where(mask) if mask else df
    return df.join(top.groupBy("class_id").agg(F.max("p").alias("_m")), "class_id").withColumn("p", F.col("p") / F.col("_m")).drop("_m")


def to_cube(flat: DataFrame, key: str = "id") -> DataFrame:
    """id and its probabilities in order of class, from rows (id, class_id, p)."""
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("class_id", "p"))), lambda x: x["p"]).alias("probs"))
