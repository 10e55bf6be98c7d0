"""Redundancy, clustering and floating selection of features."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, sampling


def correlation(samples: DataFrame, n: int) -> np.ndarray:
    """The n x n Pearson matrix from one pass of sums; only the matrix reaches the driver."""

    def sums(batches):
        s1, s2, c = np.zeros(n), np.zeros((n, n)), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())[:, :n]
                s1, s2, c = s1 + x.sum(0), s2 + x.T @ x, c + len(x)
        yield pd.DataFrame([(c, s1.tolist(), s2.ravel().tolist())], columns=["c", "a", "b"])

    parts = samples.select("x").mapInPandas(sums, "c long, a array<double>, b array<double>")
    flat = parts.select("c", F.posexplode(F.concat("a", "b")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("c").alias("c")).orderBy("i").collect()
    c = flat[0]["c"] if flat else 0
    v = np.array([r["v"] for r in flat])
    mean = v[:n] / c
    cov = v[n:].reshape(n, n) / c - np.outer(mean, mean)
    d = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(d, d)


def drop_redundant(r: np.ndarray, names: list[str], threshold: float = 0.98) -> list[str]:
    """Names in catalogue order, without those whose signed correlation with one kept exceeds the threshold."""
    kept: list[int] = []
    for i in range(len(names)):
        if not any(r[i, j] > threshold for j in kept):
            kept.append(i)
    return [names[i] for i in kept]


def correlation_pairs(samples: DataFrame, n: int) -> DataFrame:
    """i, j, r for i < j."""
    r = correlation(samples, n)
    return samples.sparkSession.createDataFrame([(i, j, float(r[i, j])) for i in range(n) for j in range(i + 1, n)], "i int, j int, r double")


def cluster_variables(samples: DataFrame, names: list[str], k: int, seed: int = 1) -> DataFrame:
    """var, pos, cluster: k-means on the variables' correlation profiles.

    Standardised columns as points have inner products n r_ij, so their distances follow
    from the correlation matrix; its rows stand for the columns, whatever the number of samples.
    """
    r = np.nan_to_num(correlation(samples, len(names)))
    w, v = np.linalg.eigh((r + r.T) / 2)
    points = v * np.sqrt(np.maximum(w, 0))  # same distances as the standardised columns, up to scale
    spark = samples.sparkSession
    df = spark.createDataFrame([(n, i, p.tolist()) for i, (n, p) in enumerate(zip(names, points, strict=True))], "var string, pos int, p array<double>")
    model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="cluster").fit(df.withColumn("f", array_to_vector("p")))
    return model.transform(df.withColumn("f", array_to_vector("p"))).select("var", "pos", "cluster")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def pool(all_names: DataFrame, chosen: DataFrame) -> DataFrame:
    """Names not chosen yet, in their order (columns pos, var)."""
    return all_names.join(chosen.select("var"), "var", "left_anti")


def weakest(scores: DataFrame) -> DataFrame:
    """The feature of lowest score, the first on ties (feature, pos, score)."""
    return scores.orderBy("score", "pos").limit(1)


def without_weakest(scores: DataFrame) -> DataFrame:
    return scores.join(F.broadcast(weakest(scores).select("pos")), "pos", "left_anti")


def best_candidate(sweep: DataFrame) -> DataFrame:
    """The candidate of highest metric, the first on ties (pos, e)."""
    return sweep.orderBy(F.col("e").desc(), "pos").limit(1)


def strong_maxima(series: DataFrame, share: float = 0.85) -> DataFrame:
    """iter, metric: strict local maxima above a share of the largest, not after its first place; ends are none.

    A selection series has one row for each iteration of a driver loop: a single window over it is small.
    """
    w = Window.orderBy("iter")
    top = series.agg(F.max("metric").alias("m"), F.max_by("iter", F.struct("metric", -F.col("iter"))).alias("at")).first()
    s = series.withColumn("before", F.lag("metric").over(w)).withColumn("after", F.lead("metric").over(w))
    return s.where((F.col("metric") > F.col("before")) & (F.col("metric") > F.col("after")) & (F.col("metric") > share * F.lit(top["m"])) & (F.col("iter") <= F.lit(top["at"]))).select("iter", "metric")


def final_set(sets: DataFrame, series: DataFrame, share: float = 0.85) -> DataFrame:
    """Distinct variables of the sets (iter, var) at the strong maxima."""
    return sets.join(F.broadcast(strong_maxima(series, share).select("iter")), "iter", "left_semi").select("var").distinct()


def sweep(samples: DataFrame, base: list[int], candidates: list[int], params: boosting.Params, forward: bool = True, k: int = 5, metric: str = "kappa", seed: int = 1, method: str = "softmax", repeats: int = 1, valid: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """pos, e: the metric of the set with each candidate added, or without it.

    Cross-validated over ``repeats`` deals of k folds, the predictions of all pooled; with
    ``valid`` fitted on all samples and scored on valid instead. One group for each
    candidate; the sample table is the bounded training set of a map.
    """
    if valid is None:
        dealt = sampling.stratified_folds(samples, k, seed=seed, repeats=repeats).select("id", "y", "x", "repeat", "fold")
    else:
        dealt = samples.select("id", "y", "x", F.lit(0).alias("repeat"), F.lit(-1).alias("fold"))
        dealt = dealt.unionByName(valid.select("id", "y", "x", F.lit(0).alias("repeat"), F.lit(0).alias("fold")))
    rows, folds = dealt.withColumn("pos", F.explode(F.array(*[F.lit(c) for c in candidates]))), k if valid is None else 1

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["pos"].iloc[0])
        feats = [*base, c] if forward else [f for f in base if f != c]
        truth, said = [], []
        for _, part in pdf.sort_values("id").groupby("repeat"):
            x, y, fold = np.stack(part["x"].to_numpy())[:, feats], part["y"].to_numpy(int), part["fold"].to_numpy()
            out = np.zeros(len(y), int)
            for f in range(folds):
                test = fold == f
                if test.any() and not test.all() and feats:
                    model = boosting.fit_one(x[~test], y[~test], method, replace(params, seed=seed), boosting.class_weights(y[~test]) if weighted else None)
                    out[test] = boosting.predict_one(model, x[test], method, params.n_classes).argmax(1)
            truth.append(y[fold >= 0])
            said.append(out[fold >= 0])
        e = boosting.local_metric(np.concatenate(truth), np.concatenate(said), metric) if len(truth) else 0.0
        return pd.DataFrame([(c, e)], columns=["pos", "e"])

    return rows.groupBy("pos").applyInPandas(score, "pos int, e double")


def split_scores(samples: DataFrame, feats: list[int], params: boosting.Params) -> dict[int, int]:
    """Split counts of a model refitted on the whole sample."""
    n = params.n_classes

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        model = boosting.fit_one(np.stack(pdf["x"].to_numpy())[:, feats], pdf["y"].to_numpy(int), "softmax", replace(params, n_classes=n))
        c = model.split_counts(len(feats))[: len(feats)]
        return pd.DataFrame({"pos": feats, "n": c.astype(int)})

    return {r["pos"]: r["n"] for r in samples.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "pos int, n long").collect()}


def floating_selection(samples: DataFrame, names: list[str], params: boosting.Params, max_iterations: int = 360, max_backtracks: int = 70, every: int = 5, patience: int = 25, k: int = 10, metric: str = "kappa", mode: str = "reference", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(series: iter, metric; sets: iter, var) of revised floating selection.

    A forward iteration adds the best candidate and records value and set; each
    ``every``-th then loses the feature that splits least. After that the least
    significant feature is dropped as long as the value does not fall, one step a turn;
    when no drop helps, the most significant one is tried against all others and replaced
    on gain. It ends after so many iterations or backtracks, or when at a multiple of
    ``patience`` the best iteration is the same as at the last one.

    mode "reference": after a replacement the value compared with stays that of the
    unreplaced set, and the stop test runs on backtracking turns too. mode "strict": the
    value is the new set's, and only forward turns test. The last feature is never
    dropped. The loop is the driver's; what a step compares is one distributed sweep.
    """
    strict = mode == "strict"
    everything = list(range(len(names)))
    chosen: list[int] = []
    values: list[float] = []
    sets: list[list[int]] = []
    best_at, backtracks, going_back, value = -1, 0, False, 0.0

    def tried(base: list[int], candidates: list[int], forward: bool) -> list[tuple[int, float]]:
        got = {r["pos"]: r["e"] for r in sweep(samples, base, candidates, params, forward, k, metric, seed).collect()}  # one number a candidate
        return [(c, got[c]) for c in candidates]

    while len(values) < max_iterations and backtracks < max_backtracks:
        if len(values) % patience == 0 and not (strict and going_back):
            top = int(np.argmax(values)) if values else 0
            if top == best_at:
                break
            best_at = top
        if not going_back:
            rest = [f for f in everything if f not in chosen]
            if not rest:
                break
            added, value = max(tried(chosen, rest, True), key=lambda t: t[1])
            chosen.append(added)
            values.append(value)
            sets.append(list(chosen))
            if len(values) % every == every - 1 and len(chosen) > 1:
                splits = split_scores(samples, chosen, params)
                chosen.remove(min(chosen, key=lambda f: (splits.get(f, 0), chosen.index(f))))
        drops = tried(chosen, list(chosen), False) if len(chosen) > 1 else []
        going_back = bool(drops) and max(e for _, e in drops) >= value
        if going_back:
            least, value = max(drops, key=lambda t: t[1])
            chosen.remove(least)
            backtracks += 1
            continue
        lead = min(drops, key=lambda t: t[1])[0] if drops else chosen[0]
        others = [f for f in chosen if f != lead]
        swap, gained = max(tried(others, [f for f in everything if f not in others], True), key=lambda t: t[1])
        if gained > value:
            chosen = [*others, swap]
            backtracks += 1
            if strict:
                value = gained
    spark = samples.sparkSession
    series = spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(values)], "iter int, metric double")
    return series, spark.createDataFrame([(i + 1, names[f]) for i, fs in enumerate(sets) for f in fs], "iter int, var string")
