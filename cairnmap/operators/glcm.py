"""Grey-level co-occurrence textures: 13 measures over four directions in a moving window.

Values are quantised by thresholds to levels (how many thresholds lie strictly below);
pairs of neighbouring cells inside the window are counted symmetrically for each
direction. NoData and what lies outside are quantised like any value; only a cell that
is NoData itself gets 0. ``mode="reference"`` keeps the conventions of the maps this
engine has to reproduce: directions are summed, the means and deviations of Correlation
are those of the marginal vector, the mean of Sum of Squares counts each row once per
level, and the difference histogram counts its diagonal twice. ``mode="haralick"`` uses
the published definitions and the mean over directions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .focal import tiles

MEASURES = ["asm", "contrast", "correlation", "variance", "idm", "sum_average", "sum_variance", "sum_entropy", "entropy", "difference_variance", "difference_entropy", "information_1", "information_2"]
#: (rows, columns) from a cell to its partner.
DIRECTIONS = [(0, 1), (-1, 1), (1, 0), (1, 1)]
EPS = 1e-8


def quantile_thresholds(df: DataFrame, levels: int = 32) -> list[float]:
    """The levels - 1 cut points of the valid cells at p = k / levels, by the n p + 1/2 rule with linear interpolation.

    Ranks come from counts of distinct values, so that what is sorted is bounded by the
    distinct values; only the cut points reach the driver.
    """
    counts = df.where((F.col("v") != 0) & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [0.0] * (levels - 1)
    # Buckets between approximate quantiles bound each window; they only deal the work, ranks are exact.
    cuts = counts.approxQuantile("v", [k / 32 for k in range(1, 32)], 0.01)
    ranged = counts.withColumn("b", F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col("v"))))
    before = {r["b"]: r["m"] for r in ranged.groupBy("b").agg(F.sum("n").alias("m")).collect()}  # one number for each bucket
    start, at = {}, 0
    for b in sorted(before):
        start[b] = at
        at += before[b]
    w = Window.partitionBy("b").orderBy("v")
    ends = F.sum("n").over(w) + F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("b"))
    ranks = sorted({r for k in range(1, levels) for r in _ranks(total, k / levels)})
    spans = ranged.withColumn("hi", ends).withColumn("lo", F.col("hi") - F.col("n") + 1)
    hit = spans.withColumn("r", F.explode(F.filter(F.array(*[F.lit(int(r)) for r in ranks]), lambda r: (r >= F.col("lo")) & (r <= F.col("hi"))))).select("r", "v")
    value = {row["r"]: row["v"] for row in hit.collect()}
    out = []
    for k in range(1, levels):
        lo, hi = _ranks(total, k / levels)
        x = min(max(total * k / levels + 0.5, 1), total)
        out.append(value[lo] + (value[hi] - value[lo]) * (x - lo))
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    x = min(max(n * p + 0.5, 1), n)
    lo = int(np.floor(x))
    return lo, min(lo + 1, n)


def level_of(v: Column, thresholds: list[float]) -> Column:
    """How many thresholds lie strictly below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t < v))


def measures(p: np.ndarray, mode: str = "reference") -> np.ndarray:
    """The 13 measures of co-occurrence matrices p (N, G, G), each summing to one or empty.

    A window fills few cells of its matrix: sums run over those; only the product of the
    marginals is dense.
    """
    n, g, _ = p.shape
    ref = mode == "reference"
    levels = np.arange(g, dtype=float)
    px, py = p.sum(1), p.sum(2)  # of the column and of the row level
    at, i, j = np.nonzero(p)
    v = p[at, i, j]
    gap = np.abs(i - j)

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x, n)

    plus = np.bincount(at * (2 * g - 1) + i + j, v, n * (2 * g - 1)).reshape(n, -1)
    minus = np.bincount(at * g + gap, v, n * g).reshape(n, g)
    if ref:
        minus[:, 0] *= 2
    out = np.zeros((n, 13))
    out[:, 0] = total(v * v)
    out[:, 1] = total(v * gap**2)
    cross = total(v * i * j)
    if ref:
        mx, my, sx, sy = px.mean(1), py.mean(1), px.std(1), py.std(1)
        mu = g * (px * levels).sum(1)
    else:
        mx, my = (px * levels).sum(1), (py * levels).sum(1)
        sx, sy = (np.sqrt(np.maximum((q * levels**2).sum(1) - m * m, 0)) for q, m in ((px, mx), (py, my)))
        mu = mx
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 2] = (cross - mx * my) / (sx * sy)
    out[:, 3] = (px * (levels[None, :] - mu[:, None]) ** 2).sum(1)
    out[:, 4] = total(v / (1 + gap**2))
    k = np.arange(2, 2 * g + 1, dtype=float)
    out[:, 5] = (plus * k).sum(1)
    out[:, 7] = -(plus * np.log(plus + EPS)).sum(1)
    centre = out[:, 7] if ref else out[:, 5]
    out[:, 6] = (plus * (k[None, :] - centre[:, None]) ** 2).sum(1)
    out[:, 8] = -total(v * np.log(v + EPS))
    out[:, 9] = minus.var(1)
    out[:, 10] = -(minus * np.log(minus + EPS)).sum(1)
    hx, hy = -(px * np.log(px + EPS)).sum(1), -(py * np.log(py + EPS)).sum(1)
    outer = px[:, None, :] * py[:, :, None]
    logs = np.log(outer + EPS)
    hxy1 = -total(v * logs[at, i, j])
    hxy2 = -np.einsum("nij,nij->n", outer, logs)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 11] = (out[:, 8] - hxy1) / np.maximum(hx, hy)
    out[:, 12] = np.sqrt(np.maximum(0, 1 - np.exp(-2 * (hxy2 - out[:, 8]))))
    out[p.sum((1, 2)) == 0] = 0
    return out


def textures(df: DataFrame, thresholds: list[float], window: int = 9, combine: str = "mean", mode: str = "reference", size: int = 64) -> DataFrame:
    """row, col and the 13 measures. combine: "mean" (the sum over directions in reference mode) or "range" (largest less smallest)."""
    import pandas as pd

    r, g = (window - 1) // 2, len(thresholds) + 1
    cuts = np.array(thresholds, float)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[0] * size - r, key[1] * size - r
        a = np.zeros((size + 2 * r, size + 2 * r))
        rr, cc = pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0
        a[rr, cc] = pdf["v"].to_numpy()
        q = np.searchsorted(cuts, a, side="left")
        own = (rr >= r) & (rr < r + size) & (cc >= r) & (cc < r + size)
        rr, cc = rr[own], cc[own]
        out = np.zeros((len(rr), 13))
        live = np.flatnonzero(a[rr, cc] != 0)
        for lo in range(0, len(live), 256):
            at = live[lo : lo + 256]
            by = []
            for dy, dx in DIRECTIONS:
                ys = np.arange(max(0, -dy), window - max(0, dy))
                xs = np.arange(0, window - dx)
                y = rr[at][:, None, None] - r + ys[None, :, None]
                x = cc[at][:, None, None] - r + xs[None, None, :]
                one, two = q[y, x].reshape(len(at), -1), q[y + dy, x + dx].reshape(len(at), -1)
                base = np.arange(len(at))[:, None] * g * g
                count = np.bincount(np.concatenate((base + one * g + two, base + two * g + one), 1).ravel(), minlength=len(at) * g * g).reshape(-1, g, g)
                by.append(measures(count / count.sum((1, 2), keepdims=True), mode))
            s = np.stack(by)
            out[at] = s.max(0) - s.min(0) if combine == "range" else s.sum(0) if mode == "reference" else s.mean(0)
        res = pd.DataFrame(out, columns=MEASURES)
        res.insert(0, "col", pdf["col"][own].to_numpy())
        res.insert(0, "row", pdf["row"][own].to_numpy())
        return res

    return tiles(df, r, size).groupBy("ty", "tx").applyInPandas(run, "row long, col int, " + ", ".join(f"{m} double" for m in MEASURES))


def textures_relational(df: DataFrame, thresholds: list[float], window: int = 9, size: int = 32) -> DataFrame:
    """Six of the measures by relations alone: row, col, asm, contrast, idm, sum_average, sum_entropy, entropy.

    Cells go once to tiles with a halo; all that follows is grouped by tile first, so the
    pairs, which are replicated to the window centres that hold both cells, are counted
    where they arise and neither shuffled nor stored. A partition has few tiles, which
    bounds the counts it holds.
    """
    r = (window - 1) // 2
    box = df.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    spark = df.sparkSession
    ring = spark.range(box["r0"] - r, box["r1"] + r + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(int(box["c0"]) - r), F.lit(int(box["c1"]) + r))).alias("col"), F.lit(None).cast("double").alias("v"))
    every = ring.unionByName(df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), "v"))

    def places(c: str) -> Column:
        """The tiles whose halo has the cell."""
        return F.explode(F.sequence(F.floor((F.col(c) - r) / size), F.floor((F.col(c) + r) / size)))

    tiles_there = ((box["r1"] - box["r0"]) // size + 2) * ((box["c1"] - box["c0"]) // size + 2)
    dealt = every.withColumn("ty", places("row")).withColumn("tx", places("col")).repartition(max(1, -(-tiles_there // 4)), "ty", "tx")
    cell = dealt.groupBy("ty", "tx", "row", "col").agg(F.max("v").alias("v"))
    cell = cell.select("ty", "tx", "row", "col", (F.coalesce("v", F.lit(0.0)) != 0).alias("live"), level_of(F.coalesce("v", F.lit(0.0)), thresholds).alias("q"))
    cell = cell.withColumn("right", F.lead("q").over(Window.partitionBy("ty", "tx", "row").orderBy("col")))
    down = Window.partitionBy("ty", "tx", "col").orderBy("row")
    cell = cell.withColumn("p2", F.lead("q").over(down)).withColumn("p3", F.lead("right").over(down)).withColumn("p1", F.lag("right").over(down)).withColumnRenamed("right", "p0")

    row, col, y0, x0 = F.col("row"), F.col("col"), F.col("ty") * size, F.col("tx") * size

    def to(d: int, p: Column, rows: tuple[Column, Column], cols: tuple[Column, Column]) -> Column:
        """A pair and the centres it counts for, of this tile; a pair is (smaller, larger) level."""
        ends = [F.greatest(rows[0], y0), F.least(rows[1], y0 + size - 1), F.greatest(cols[0].cast("long"), x0), F.least(cols[1].cast("long"), x0 + size - 1)]
        return F.struct(F.lit(d).alias("d"), F.least("q", p).alias("i"), F.greatest("q", p).alias("j"), *[e.alias(n) for e, n in zip(ends, ("ya", "yb", "xa", "xb"), strict=True)])

    pairs = [F.when(F.col(f"p{d}").isNotNull(), to(d, F.col(f"p{d}"), (row + max(0, dy) - r, row + min(0, dy) + r), (col + dx - r, col + r))) for d, (dy, dx) in enumerate(DIRECTIONS)]
    mark = F.when(F.col("live"), to(-1, F.col("q"), (row, row), (col, col)))  # only live cells are centres
    some = F.filter(F.array(*pairs, mark), lambda x: x.isNotNull() & (x["ya"] <= x["yb"]) & (x["xa"] <= x["xb"]))
    at = cell.select("ty", "tx", F.explode(some).alias("x")).select("ty", "tx", "x.*").withColumn("row", F.explode(F.sequence("ya", "yb"))).withColumn("col", F.explode(F.sequence("xa", "xb")))
    key = ["ty", "tx", "row", "col"]
    count = at.groupBy(*key, "d", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    # Counts c are whole numbers and summed as such, apart by their total; only then is divided, so that no sum depends on its order.
    totals = {"a": 2.0 * (window - 1) * (window - 1), "b": 2.0 * (window - 1) * window}
    total = F.when(F.col("d").isin(1, 3), F.lit(totals["a"])).otherwise(F.lit(totals["b"]))
    gap = F.col("i") - F.col("j")
    # An unequal pair stands for both of its orders (m); an equal one counts twice.
    c = count.select(*key, "d", "i", "j", F.when(gap == 0, 1).otherwise(2).alias("m"), (gap * gap).alias("gg"), (F.when(gap == 0, 2).otherwise(1) * F.col("n")).alias("c")).withColumn("p", F.col("c") / total)
    mc = F.col("m") * F.col("c")
    whole = {"asm": mc * F.col("c"), "contrast": F.col("gg") * mc}
    parts = whole | {"idm": F.col("m") * F.col("p") / (1 + F.col("gg")), "entropy": -F.col("m") * F.col("p") * F.log(F.col("p") + EPS)}
    plus = c.groupBy(*key, "d", (F.col("i") + F.col("j") + 2).alias("k")).agg(F.sum(mc).alias("s"), *[F.sum(e).alias(n) for n, e in parts.items()])
    real, share = F.col("d") >= 0, F.col("s") / total
    sums = {n: F.sum(F.when(real, e)) for n, e in {"idm": F.col("idm"), "entropy": F.col("entropy"), "sum_entropy": -share * F.log(share + EPS)}.items()}
    for n in ("asm", "contrast", "sum_average"):
        e = F.col("k") * F.col("s") if n == "sum_average" else F.col(n)
        apart = [F.coalesce(F.sum(F.when(F.col("d").isin(ds), e)), F.lit(0)) / F.lit(totals[t] ** (2 if n == "asm" else 1)) for t, ds in (("a", [1, 3]), ("b", [0, 2]))]
        sums[n] = apart[0] + apart[1]
    out = plus.groupBy(*key).agg(*[e.alias(n) for n, e in sums.items()], F.min("d").alias("mark"))
    return out.where("mark < 0 and idm is not null").select("row", F.col("col").cast("int").alias("col"), "asm", "contrast", "idm", "sum_average", "sum_entropy", "entropy")
