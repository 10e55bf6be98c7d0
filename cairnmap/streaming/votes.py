"""Votes of base models folded as their predictions arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_votes(predictions: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """(id, pred, v) over a streaming DataFrame of (run, id, pred): weight sums so far, for update or complete mode."""
    return predictions.join(weights.where("weight > 0"), "run").groupBy(key, "pred").agg(F.sum("weight").alias("v"))


def decide(sums: DataFrame, key: str = "id") -> DataFrame:
    """id, pred: the class with most weight in a snapshot of running_votes, the lowest on ties."""
    return sums.groupBy(key).agg(F.max_by("pred", F.struct(F.round("v", 12), -F.col("pred"))).alias("pred"))
