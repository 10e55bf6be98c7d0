"""Maps from models: every cell of a stack predicted by a weighted ensemble, and what is made of that.

Models go to the cells. All runs vote on a cell in the task that holds it, so a map costs
one pass over the stack and no shuffle, whatever the number of runs.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmap.sources import geotiff

from . import boosting, lookup, metrics, sampling


def class_shares(rows: DataFrame, ensemble: DataFrame, n_classes: int, method: str = "softmax") -> DataFrame:
    """id, votes, probs: of each row (id, x) the weighted vote share and the mean probability of every class."""
    models = rows.sparkSession.sparkContext.broadcast(boosting.models_of(ensemble))

    def run(batches):
        known = [(w, f, boosting.Booster.load(raw)) for _, w, f, raw in models.value if raw]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            share, prob = np.zeros((len(x), n_classes)), np.zeros((len(x), n_classes))
            for w, f, model in known:
                p = boosting.predict_one(model, x[:, f], method, n_classes)
                share[np.arange(len(x)), p.argmax(1)] += w
                prob += w * p
            yield pd.DataFrame({"id": pdf["id"], "votes": list(share), "probs": list(prob)})

    return rows.select("id", "x").mapInPandas(run, "id long, votes array<double>, probs array<double>")


def cells_of(stack: DataFrame, names: list[str], n_cols: int, nodata: float = 0.0) -> DataFrame:
    """id (row * n_cols + col) and x of the cells whose first band is not NoData; a null band reads as NoData."""
    first = F.col(names[0])
    live = stack.where(first.isNotNull() & ~F.isnan(first) & (first != nodata))
    return live.select((F.col("row") * n_cols + F.col("col")).cast("long").alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(nodata)) for c in names]).alias("x"))


def class_map(stack: DataFrame, names: list[str], ensemble: DataFrame, n_classes: int, n_cols: int, method: str = "softmax", least_share: float = 0.0, nodata: float = 0.0) -> DataFrame:
    """row, col, class (from 1; 0 is NoData), share of the winner's votes, p its mean probability, u the confusion index.

    The winner has the largest vote share, the lowest class on ties. Cells whose share is
    below ``least_share`` of the largest share on the map become NoData.
    """
    got = class_shares(cells_of(stack, names, n_cols, nodata), ensemble, n_classes, method)
    rounded = F.transform("votes", lambda v: F.round(v, 12))
    top = F.array_max(rounded)
    best = F.array_position(rounded, top).cast("int")
    second = F.coalesce(F.element_at(F.sort_array(rounded, asc=False), 2) if n_classes > 1 else F.lit(0.0), F.lit(0.0))
    won = got.select("id", best.alias("class"), top.alias("share"), F.element_at("probs", best).alias("p"), (1 - (top - second)).alias("u"))
    if least_share:
        won = lookup.suppress_low(won, least_share, "share")
        won = won.withColumn("class", F.when(F.col("share") > 0, F.col("class")).otherwise(0))
    row, col = F.floor(F.col("id") / n_cols).cast("long"), (F.col("id") % n_cols).cast("int")
    live = won.select(row.alias("row"), col.alias("col"), "class", "share", "p", "u")
    first = F.col(names[0])
    dead = stack.where(~(first.isNotNull() & ~F.isnan(first) & (first != nodata))).select(F.col("row").cast("long"), F.col("col").cast("int"), F.lit(0).alias("class"), *[F.lit(0.0).alias(c) for c in ("share", "p", "u")])
    return live.unionByName(dead)


def joint_map(parent: DataFrame, child: DataFrame) -> DataFrame:
    """row, col, upper, class, u of a class map and the map of its parts: the uncertainties of both joined."""
    both = parent.select("row", "col", F.col("class").alias("upper"), F.col("u").alias("_u")).join(child.select("row", "col", "class", "u"), ["row", "col"])
    return both.select("row", "col", "upper", "class", (1 - (1 - F.col("_u")) * (1 - F.col("u"))).alias("u"))


def write_map(cells: DataFrame, folder: str, geo: geotiff.Georeference | None = None) -> None:
    """class, share, p and u as one GeoTIFF each, below a folder that all executors mount; NaN where the map has no cell."""
    bands = F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).cast("double").alias("v")) for c in ("class", "share", "p", "u")])).alias("b")
    geotiff.write(cells.select("row", "col", bands).select("b.band", "row", "col", "b.v"), folder, geo, "Float64", outside=math.nan)


def map_files(spark: SparkSession, paths: list[str] | str, names: list[str], ensemble: DataFrame, n_classes: int, **options) -> DataFrame:
    """class_map() of a stack of GeoTIFF files, one band each; only the named bands' files are opened.

    A place that holds in every file the NoData value the file names is no cell of the map.
    """
    cells = geotiff.read(spark, paths, names, inside=True)
    n_cols = int(cells.agg(F.max("col")).first()[0]) + 1
    return class_map(lookup.stack(cells, names), names, ensemble, n_classes, n_cols, **options)


def hold_out(samples: DataFrame, feats: list[int], params: boosting.Params, method: str = "softmax", share: float = 0.7, seed: int = 1) -> DataFrame:
    """id, y, p of the rows that a model fitted on a stratified share of the samples has not seen.

    The bounded training set of a map is one group, as it is for every model.
    """
    split = sampling.stratified_split(samples, share, seed=seed).select("id", "y", "x", "train")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y, train = np.stack(pdf["x"].to_numpy())[:, feats], pdf["y"].to_numpy(int), pdf["train"].to_numpy(bool)
        model = boosting.fit_one(x[train], y[train], method, replace(params, seed=seed))
        p = boosting.predict_one(model, x[~train], method, params.n_classes).argmax(1) if (~train).any() else np.zeros(0, int)
        return pd.DataFrame({"id": pdf["id"][~train], "y": y[~train], "p": p})

    return split.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "id long, y int, p int")


def best_set(sets: DataFrame, series: DataFrame, gain: float = 0.0) -> DataFrame:
    """iter, var of the first set whose metric is within ``gain`` of the largest: what a selection keeps."""
    top = series.agg(F.max("metric").alias("m")).first()["m"]
    at = series.where(F.col("metric") >= F.lit(top) - gain).agg(F.min("iter").alias("i")).first()["i"]
    return sets.where(F.col("iter") == F.lit(at)).select("iter", "var")


def refitted(samples: DataFrame, names: list[str], chosen: list[str], params: boosting.Params, runs: int = 2, metric: str = "accuracy", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(ensemble over the chosen variables, its report on held-out rows): what is kept of a selection before it is mapped."""
    feats = [names.index(c) for c in chosen]
    narrow = samples.withColumn("x", F.array(*[F.element_at("x", f + 1) for f in feats]))
    ensemble = boosting.train_ensemble(narrow, len(feats), runs, params, metric=metric, column_rate=1.0, seed=seed)
    seen = hold_out(narrow, list(range(len(feats))), params, seed=seed)
    return ensemble, metrics.report(seen.select("y", "p"))


def selected_map(stack: DataFrame, samples: DataFrame, names: list[str], sets: DataFrame, series: DataFrame, params: boosting.Params, n_cols: int, gain: float = 0.0, runs: int = 2) -> DataFrame:
    """class_map() from the best set of a selection, refitted on the whole sample; the set is at most as long as names."""
    chosen = [r["var"] for r in best_set(sets, series, gain).collect()]
    chosen = [n for n in names if n in chosen]
    ensemble, _ = refitted(samples, names, chosen, params, runs)
    return class_map(stack, chosen, ensemble, params.n_classes, n_cols)
