"""Agreement metrics of truth y and prediction p, each as a one-row DataFrame, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, n_classes: int | None = None, label: str = "y") -> DataFrame:
    """class_id, n for every id from 0 to the largest, empty ones too."""
    top = n_classes - 1 if n_classes else df.agg(F.max(label)).first()[0]
    ids = df.sparkSession.range(int(top if top is not None else -1) + 1).select(F.col("id").cast("int").alias("class_id"))
    n = df.groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(n, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame) -> DataFrame:
    """y, p, n in long form, the pairs that occur."""
    return df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))


def confusion_square(df: DataFrame) -> DataFrame:
    """y and a column for each class of either side, 0 where there is no pair."""
    labels = sorted(r[0] for r in df.select("y").union(df.select("p")).distinct().collect())  # the classes
    return df.groupBy("y").pivot("p", labels).agg(F.count(F.lit(1))).na.fill(0)


def normalised_confusion(df: DataFrame) -> DataFrame:
    """y, p, n, share of its row: the data of a confusion figure."""
    return confusion(df).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("value"))


def kappa(df: DataFrame) -> DataFrame:
    """(po - pe) / (1 - pe), from the confusion counts."""
    c = confusion(df)
    both = c.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("x"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("d"))
    per = both.groupBy("x.k").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"), (F.sum("d") / 2).alias("d"))
    t = per.agg(F.sum("a").alias("n"), F.sum("d").alias("d"), F.sum(F.col("a").cast("double") * F.col("b")).alias("e"))
    po, pe = F.col("d") / F.col("n"), F.col("e") / F.col("n") / F.col("n")
    return t.select(((po - pe) / (1 - pe)).alias("value"))


def _binary(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(((F.col("y") == 1) & (F.col("p") == 1)).cast("long")).alias("tp"), F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("p") == 1).cast("long")).alias("said"))


def _ratio(a, b):
    return F.when(b == 0, 0.0).otherwise(a / b)


def recall(df: DataFrame) -> DataFrame:
    return _binary(df).select(_ratio(F.col("tp"), F.col("pos")).alias("value"))


def precision(df: DataFrame) -> DataFrame:
    return _binary(df).select(_ratio(F.col("tp"), F.col("said")).alias("value"))


def f1(df: DataFrame) -> DataFrame:
    return _binary(df).select(_ratio(2 * F.col("tp"), F.col("pos") + F.col("said")).alias("value"))


def auc(df: DataFrame, score: str = "s", buckets: int = 64) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their average rank.

    Distinct scores are counted first and ranked within value buckets, whose totals are
    summed; so no window holds more than a bucket.
    """
    n = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    cuts = sorted(set(n.approxQuantile("s", [k / buckets for k in range(1, buckets)], 0.01)))
    n = n.withColumn("b", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("s")))) if cuts else n.withColumn("b", F.lit(0))
    below = {r["b"]: r["m"] for r in n.groupBy("b").agg(F.sum("neg").alias("m")).collect()}  # one number for each bucket
    start, at = {}, 0
    for b in sorted(below):
        start[b] = at
        at += below[b]
    if not start:
        return df.limit(0).agg(F.lit(None).cast("double").alias("value"))
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("b"))
    t = n.withColumn("wins", F.col("pos") * (lower + F.col("neg") / 2)).agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return t.select((F.col("w") / (F.col("p").cast("double") * F.col("q"))).alias("value"))


def _per_class(df: DataFrame) -> DataFrame:
    hit = df.groupBy(F.col("y").alias("class_id")).agg(F.count(F.lit(1)).alias("m"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("a"))
    return histogram(df).join(hit, "class_id", "left").select("class_id", "n", F.coalesce("a", F.lit(float("nan"))).alias("a"))


def linear_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy of each class weighted by 1/4 + 3/4 of its share, weights summing to one; an empty class gives NaN."""
    c = _per_class(df)
    t = c.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    w = 0.25 + 0.75 * F.col("n") / (t["t"] or 1)
    return c.agg((F.sum(w * F.col("a")) / F.lit(0.25 * t["k"] + 0.75)).alias("value"))


def balanced_accuracy(df: DataFrame) -> DataFrame:
    """Mean of the classes' accuracies over ids from 0 to the largest; an empty class gives NaN."""
    return _per_class(df).agg(F.avg("a").alias("value"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {"auc": auc, "accuracy": accuracy, "recall": recall, "precision": precision, "f1score": f1, "kappa": kappa, "confmat": confusion, "linear-accuracy": linear_accuracy, "balanced-accuracy": balanced_accuracy}


def evaluate(df: DataFrame, method: str) -> DataFrame:
    """The metric of that name; an unknown name raises."""
    if method not in METRICS:
        raise ValueError(f"unknown metric: {method}; known are {', '.join(METRICS)}")
    return METRICS[method](df)


def report(df: DataFrame, methods: tuple[str, ...] = ("accuracy", "kappa", "balanced-accuracy", "linear-accuracy")) -> DataFrame:
    """metric, value for each method: the evaluation report of a classifier.

    Metrics of classes come from the pairs' counts, which are taken in one scan; only "auc"
    reads the rows again. Rows without truth or prediction do not count; the metrics of an
    empty table are null.
    """
    unknown = [m for m in methods if m not in METRICS or m == "confmat"]
    if unknown:
        raise ValueError(f"unknown metric: {unknown[0]}; known are {', '.join(m for m in METRICS if m != 'confmat')}")
    out = None
    counted = [m for m in methods if m != "auc"]
    if counted:
        pairs = confusion(df.where("y is not null and p is not null"))
        side = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("d")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("d")))).alias("s"))
        per = side.groupBy("s.k").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"), F.sum("s.d").alias("d"))
        a, b, d = F.col("a"), F.col("b"), F.col("d")
        one = per.agg(
            F.sum(a).cast("double").alias("n"), F.sum(d).cast("double").alias("hit"), F.sum(a.cast("double") * b).alias("chance"),
            # Class ids run from 0 to the largest; one that is absent among them makes both means NaN.
            (F.max(F.when(a > 0, F.col("k"))) + 1).alias("ids"), F.sum((a > 0).cast("long")).alias("seen"),
            F.sum(F.when(a > 0, d / a)).alias("rates"),
            F.sum(F.when(F.col("k") == 1, d).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") == 1, a).otherwise(0)).alias("pos"), F.sum(F.when(F.col("k") == 1, b).otherwise(0)).alias("said"),
        )
        po, pe = F.col("hit") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
        nan = F.when(F.col("seen") < F.col("ids"), F.lit(float("nan")))
        formulas = {
            "accuracy": po,
            "kappa": (po - pe) / (1 - pe),
            "balanced-accuracy": nan.otherwise(F.col("rates") / F.col("ids")),
            "linear-accuracy": nan.otherwise((0.25 * F.col("rates") + 0.75 * F.col("hit") / F.col("n")) / (0.25 * F.col("ids") + 0.75)),
            "recall": _ratio(F.col("tp"), F.col("pos")),
            "precision": _ratio(F.col("tp"), F.col("said")),
            "f1score": _ratio(2 * F.col("tp"), F.col("pos") + F.col("said")),
        }
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), formulas[m].cast("double").alias("value")) for m in counted])
        out = one.select(F.explode(cells).alias("c")).select("c.metric", "c.value")
    if "auc" in methods:
        area = auc(df).select(F.lit("auc").alias("metric"), F.col("value").cast("double").alias("value"))
        out = area if out is None else out.unionByName(area)
    return out


def raster_evaluate(truth: DataFrame, predicted: DataFrame, method: str) -> DataFrame:
    """A metric over pixels: both rasters have row, col, v."""
    both = truth.select("row", "col", F.col("v").cast("int").alias("y")).join(predicted.select("row", "col", F.col("v").cast("int").alias("p")), ["row", "col"])
    return evaluate(both, method)
