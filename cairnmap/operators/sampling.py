"""Splits, folds, column draws and synthetic minority samples with explicit seeds.

Order within a class comes from a hash of seed and id, so draws are reproducible and do
not depend on how the data is partitioned. Ranks are taken within class and hash bucket
where only a share is needed, so that one class with most rows does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, key: str = "id") -> Column:
    """A pseudo-random integer below 2^32 for an integer id; plain arithmetic, the same in any engine."""
    return ((F.col(key) + seed) * 2654435761) % 4294967296


def random_split(df: DataFrame, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows by hash of their id, about ``share`` of them in the first part."""
    left = shuffle_key(seed) < int(share * 4294967296)
    return df.where(left), df.where(~left)


def _ranked(df: DataFrame, label: str, seed: int, key: str, buckets: int = 256) -> DataFrame:
    """rank of each row within its class by shuffle key, and the class count n.

    Ranks are local to a range of the key; range totals, a table of buckets x classes, give the offsets.
    """
    k = shuffle_key(seed, key)
    d = df.withColumn("_k", k).withColumn("_b", F.floor(k / (4294967296 // buckets)).cast("int"))
    size = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(label).orderBy("_b")
    size = size.withColumn("_before", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_m").over(Window.partitionBy(label)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_k", key)))
    return d.join(size.drop("_m"), [label, "_b"]).withColumn("rank", (F.col("_r") + F.col("_before")).cast("long")).drop("_k", "_b", "_r", "_before")


def stratified_split(df: DataFrame, share: float, label: str = "y", seed: int = 1, key: str = "id") -> DataFrame:
    """df with train: exactly floor(n * share) rows of each class."""
    return _ranked(df, label, seed, key).withColumn("train", F.col("rank") <= F.floor(F.col("n") * share)).drop("rank", "n")


def stratified_folds(df: DataFrame, k: int, label: str = "y", seed: int = 1, key: str = "id", repeats: int = 1) -> DataFrame:
    """df with repeat and fold (0..k-1), classes dealt evenly, shuffled anew in each repeat."""
    out = None
    for r in range(repeats):
        one = _ranked(df, label, seed + r, key).withColumn("repeat", F.lit(r)).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "n")
        out = one if out is None else out.unionByName(one)
    return out


def column_rates(clusters: DataFrame, rate: float, weights: list[float]) -> DataFrame:
    """cluster, n, take: how many columns of each cluster a run draws.

    weights: [-1] the same rate for all, [-2] rates that favour small clusters, else one
    weight for each cluster. A draw cannot exceed the cluster.
    """
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    total, k = t["t"] or 0, t["k"]
    if weights[0] == -1:
        r = F.lit(float(rate))
    elif weights[0] == -2:
        r = (total - F.col("n")) / F.lit(float(total * (k - 1) or 1)) * rate * k
    else:
        s = float(sum(weights))
        r = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cluster") + 1) / s * rate * k
    return n.withColumn("take", F.least(F.ceil(F.round(F.col("n") * r, 9)), F.col("n")).cast("long"))


def draw_columns(clusters: DataFrame, rate: float, weights: list[float], runs: int, seed: int = 1) -> DataFrame:
    """run, cluster, var: each run's draw without replacement (clusters: var, pos, cluster)."""
    every = clusters.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    k = ((F.col("pos") + 1 + F.col("run") * 1000003 + seed) * 2654435761) % 4294967296
    ranked = every.withColumn("_r", F.row_number().over(Window.partitionBy("run", "cluster").orderBy(k, "pos")))
    return ranked.join(F.broadcast(column_rates(clusters, rate, weights).select("cluster", "take")), "cluster").where("_r <= take").select("run", "cluster", "var")


def smote_targets(df: DataFrame, ratio: float = 16, label: str = "y") -> DataFrame:
    """class, n, target: counts stretched so that the smallest class gets the largest / ratio; ratio -1: all get the largest."""
    n = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    t = n.agg(F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    hi, lo = t["hi"] or 0, t["lo"] or 0
    if ratio == -1 or hi == lo:
        return n.withColumn("target", F.lit(hi).cast("long"))
    low = float(round(hi / ratio))  # halves to even
    return n.withColumn("target", F.ceil((F.col("n") - lo) / (hi - lo) * (hi - low) + low).cast("long"))


def neighbours(df: DataFrame, k: int, block: int = 512) -> DataFrame:
    """id, y, nn: the k nearest of the same class, by Euclidean distance, ties by id.

    Pass only the classes that are asked for: the work grows with the square of a class.

    A stated query set against all rows of its class, in blocks: each block of a class
    meets each other block once, and keeps k candidates before they are merged.
    """
    import numpy as np
    import pandas as pd

    sized = df.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(F.broadcast(sized), "y").withColumn("_of", F.greatest(F.ceil(F.col("_n") / block), F.lit(1)).cast("int"))
    d = d.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_of")).cast("int"))
    ask = d.select("y", F.col("_b").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("rb"), F.lit(0).alias("side"), "id", "x")
    own = d.select("y", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("qb"), F.col("_b").alias("rb"), F.lit(1).alias("side"), "id", "x")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(q) or not len(r):
            return pd.DataFrame(columns=["y", "id", "nn"])
        a, b = np.stack(q["x"].to_numpy()), np.stack(r["x"].to_numpy())
        dist = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2) if len(a) * len(b) * a.shape[1] < 5e7 else (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        ids = r["id"].to_numpy()
        dist = np.where(q["id"].to_numpy()[:, None] == ids[None, :], np.inf, np.sqrt(np.maximum(dist, 0)))
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        rows = [(y, i, [{"d": float(dist[n, j]), "id": int(ids[j]), "x": b[j].tolist()} for j in order[n] if np.isfinite(dist[n, j])]) for n, (y, i) in enumerate(zip(q["y"], q["id"], strict=True))]
        return pd.DataFrame(rows, columns=["y", "id", "nn"])

    part = ask.unionByName(own).groupBy("y", "qb", "rb").applyInPandas(best, "y int, id long, nn array<struct<d:double,id:long,x:array<double>>>")
    return part.groupBy("y", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, k).alias("nn"))


def smote(df: DataFrame, ratio: float = 16, seed: int = 1) -> DataFrame:
    """df (id, y, x) and synthetic samples on the way from a sample to one of its neighbours; synthetic says which."""
    t = smote_targets(df, ratio)
    least = t.agg(F.min("n")).first()[0] or 0
    k = 5 if least > 5 else max(1, least - 1)
    need = t.withColumn("deficit", F.greatest(F.col("target") - F.col("n"), F.lit(0))).where("deficit > 0")
    # Classes at their target get no synthetic samples, so theirs are not compared at all.
    nn = neighbours(df.join(F.broadcast(need.select("y")), "y", "left_semi"), k).where(F.size("nn") > 0)
    src = df.join(F.broadcast(need), "y").join(nn, ["y", "id"]).join(_ranked(df.select("id", "y"), "y", seed, "id").select("id", "rank"), "id")
    # The deficit is dealt over the class: sample of rank r makes the synthetic ones r, r + n, r + 2n and so on.
    made = src.withColumn("j", F.explode(F.expr("case when rank <= deficit then sequence(rank, deficit, n) else cast(array() as array<bigint>) end")))
    h = F.pmod(F.xxhash64("id", "j", F.lit(seed)), F.lit(1 << 30))
    pick = F.element_at("nn", (h % F.size("nn")).cast("int") + 1)["x"]
    u = F.pmod(F.xxhash64("j", "id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    new = made.select("id", "y", F.zip_with("x", pick, lambda a, b: a + u * (b - a)).alias("x"), F.lit(True).alias("synthetic"))
    return df.select("id", "y", "x", F.lit(False).alias("synthetic")).unionByName(new)


def worker_of(run: Column, n_workers: int) -> Column:
    """Runs dealt to workers in turn."""
    return F.pmod(run, F.lit(n_workers)).cast("int")
