"""Focal (moving-window) operators over a long raster: row, col, v; zero is NoData.

Square windows with additive statistics are two passes of one-dimensional range windows.
Rows of the raster are cut into stripes that repeat a halo of neighbours, so that a
window partition is bounded however long a column is. Median and other windows that do
not separate run on tiles with a halo, one Arrow group for each tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-4


def _striped(df: DataFrame, along: str, radius: int, stripe: int) -> DataFrame:
    """Cells with the stripe they are in and, near its ends, the neighbouring stripes too."""
    def of(shift: int) -> Column:
        return F.floor((F.col(along) + shift) / stripe)

    return df.withColumn("_stripe", F.explode(F.array_distinct(F.array(of(-radius), of(0), of(radius)))))


def window_sums(df: DataFrame, sums: dict[str, Column], radius: int, keep: list[str], stripe: int = 4096, weights: dict[int, float] | None = None) -> DataFrame:
    """Sums over the (2 radius + 1) square around each cell of df; cells outside count as nothing."""
    out = df.select("row", "col", *keep, *[c.alias(k) for k, c in sums.items()])
    for across, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(across, "_stripe").orderBy(along).rangeBetween(-radius, radius)
        out = _striped(out, along, radius, stripe).select("row", "col", "_stripe", *keep, *[F.sum(k).over(w).alias(k) for k in sums])
        out = out.where(F.col("_stripe") == F.floor(F.col(along) / stripe)).drop("_stripe")
    return out


def focal_stats(df: DataFrame, window: int = 7, stripe: int = 4096) -> DataFrame:
    """row, col, std, cv, skew, kurt over the valid cells of the window; 0 where the cell itself is NoData.

    std = sqrt(sum((v - mean)^2) / n + 1e-4), cv = std / (mean + 1e-4); skew and kurt are
    the mean third and fourth power of (v - mean) / std, with that std and without - 3.
    Cells that are absent, and zeros, are skipped.
    """
    v = F.col("v")
    ok = (v != 0) & ~F.isnan(v)
    sums = {f"s{k}": F.when(ok, F.pow(v, F.lit(k)) if k else F.lit(1.0)).otherwise(0.0) for k in range(5)}
    sums["s1"], sums["s2"] = F.when(ok, v).otherwise(0.0), F.when(ok, v * v).otherwise(0.0)
    sums["s3"], sums["s4"] = F.when(ok, v * v * v).otherwise(0.0), F.when(ok, v * v * v * v).otherwise(0.0)
    g = window_sums(df, sums, (window - 1) // 2, ["v"], stripe)
    n, m = F.col("s0"), F.col("s1") / F.col("s0")
    m2, m3, m4 = F.col("s2") / n, F.col("s3") / n, F.col("s4") / n
    g = g.withColumn("m", m).withColumn("std", F.sqrt(F.greatest(m2 - m * m, F.lit(0.0)) + EPS))
    third = m3 - 3 * F.col("m") * m2 + 2 * F.pow("m", F.lit(3))
    fourth = m4 - 4 * F.col("m") * m3 + 6 * F.pow("m", F.lit(2)) * m2 - 3 * F.pow("m", F.lit(4))
    live = (v != 0) & ~F.isnan(v)

    def or_nodata(c: Column) -> Column:
        return F.when(live, c).otherwise(0.0)

    return g.select("row", "col", or_nodata(F.col("std")).alias("std"), or_nodata(F.col("std") / (F.col("m") + EPS)).alias("cv"), or_nodata(third / F.pow("std", F.lit(3))).alias("skew"), or_nodata(fourth / F.pow("std", F.lit(4))).alias("kurt"))


def disk_kernel(radius: float, fine: int = 32) -> dict[tuple[int, int], float]:
    """Mean over a disk: each cell weighs the part of it that the disk covers, found on a fine grid."""
    r = int(np.ceil(radius - 0.5))
    at = (np.arange(fine) + 0.5) / fine - 0.5
    out = {}
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            part = float((((dy + at)[:, None] ** 2 + (dx + at)[None, :] ** 2) <= radius * radius).mean())
            if part:
                out[dy, dx] = part
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def gaussian_kernel(size: int = 25, sigma: float = 3.5) -> dict[int, float]:
    """One-dimensional factor of a normalised Gaussian."""
    r = (size - 1) // 2
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return {i - r: float(x) for i, x in enumerate(g / g.sum())}


def tiles(df: DataFrame, reach: int, size: int = 256) -> DataFrame:
    """Cells for each tile whose window may need them: ty, tx, row, col, v."""
    def of(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))

    return df.select("row", "col", "v", of("row").alias("ty")).select("*", of("col").alias("tx"))


def chain(df: DataFrame, kernels: list[tuple[Callable[[np.ndarray], np.ndarray], int]], size: int = 256, outside: float = 0.0) -> DataFrame:
    """Kernels one after the other on each tile's array, each with its reach; one shuffle, whose halo is the sum of all.

    Only cells present are returned; absent ones, and those outside, read as ``outside``,
    between kernels too, so the result is that of one pass for each kernel. It does not
    depend on the tile's size.
    """
    reach = sum(r for _, r in kernels)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[0] * size - reach, key[1] * size - reach
        a = np.full((size + 2 * reach, size + 2 * reach), outside)
        there = np.zeros(a.shape, bool)
        r, c = pdf["row"].to_numpy() - y0, pdf["col"].to_numpy() - x0
        a[r, c], there[r, c] = pdf["v"].to_numpy(), True
        own = (r >= reach) & (r < reach + size) & (c >= reach) & (c < reach + size)
        for kernel, step in kernels:
            a, there = kernel(a), there[step : len(there) - step, step : there.shape[1] - step]
            a = np.where(there, a, outside)
        return pd.DataFrame({"row": pdf["row"][own], "col": pdf["col"][own], "v": a[r[own] - reach, c[own] - reach]})

    return tiles(df, reach, size).groupBy("ty", "tx").applyInPandas(run, "row long, col int, v double")


def _median(window: int) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    r = (window - 1) // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(a, (window, window))
        out = np.empty(view.shape[:2])
        for i in range(len(view)):  # row by row bounds the copies
            out[i] = np.median(view[i].reshape(view.shape[1], -1), axis=1)
        return out

    return kernel, r


def _gaussian(size: int, sigma: float) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    g = np.array(list(gaussian_kernel(size, sigma).values()))
    r = (size - 1) // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        rows = sum(g[k] * a[:, k : a.shape[1] - 2 * r + k] for k in range(size))
        return sum(g[k] * rows[k : a.shape[0] - 2 * r + k] for k in range(size))

    return kernel, r


def _disk(radius: float) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    weights = disk_kernel(radius)
    r = max(dy for dy, _ in weights)

    def kernel(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
        return sum(k * a[r + dy : r + dy + h, r + dx : r + dx + w] for (dy, dx), k in weights.items())

    return kernel, r


def median_filter(df: DataFrame, window: int = 11, size: int = 256) -> DataFrame:
    """Median of the square window; NoData and the outside count as 0."""
    return chain(df, [_median(window)], size)


def gaussian_filter(df: DataFrame, size: int = 25, sigma: float = 3.5, tile: int = 256) -> DataFrame:
    """Two one-dimensional passes of the kernel; what lies outside counts as 0."""
    return chain(df, [_gaussian(size, sigma)], tile)


def disk_filter(df: DataFrame, radius: int = 5, tile: int = 256) -> DataFrame:
    """Mean over a disk; what lies outside counts as 0."""
    return chain(df, [_disk(radius)], tile)


def smooth_long(df: DataFrame, sigma: float = 3.5, tile: int = 256) -> DataFrame:
    """The long chain: median 11, Gaussian 25, median 5, disk 5; one shuffle with the summed halo."""
    return chain(df, [_median(11), _gaussian(25, sigma), _median(5), _disk(5)], tile)


def smooth_short(df: DataFrame, radius: int = 5, tile: int = 256) -> DataFrame:
    """The short chain for textures: median 15, disk; one shuffle with the summed halo."""
    return chain(df, [_median(15), _disk(radius)], tile)


def resample(df: DataFrame, scale: float, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Nearest neighbour to round(n / scale) rows and columns (halves up).

    Target cell i, counted from 1, reads source cell ceil((i - 0.5) * n / m): the centre
    rule. Each source cell knows the target cells that read it, so there is no join.
    """
    if n_rows is None or n_cols is None:
        top = df.agg(F.max("row"), F.max("col")).first()
        n_rows, n_cols = int(top[0]) + 1, int(top[1]) + 1

    def of(c: str, n: int) -> Column:
        m = max(1, int(n / scale + 0.5))
        # i reads c when c < (i - 0.5) n / m <= c + 1, c counted from 0; candidates by floating bounds, then exactly in integers
        lo = F.greatest(F.floor(F.col(c) * m / n).cast("long"), F.lit(0))
        hi = F.least(F.ceil((F.col(c) + 1) * m / n).cast("long") + 1, F.lit(m).cast("long"))
        every = F.when(lo < hi, F.sequence(lo + 1, hi)).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.explode(F.filter(every, lambda i: ((2 * i - 1) * n > 2 * m * F.col(c)) & ((2 * i - 1) * n <= 2 * m * (F.col(c) + 1))))

    out = df.withColumn("_r", of("row", n_rows)).withColumn("_c", of("col", n_cols))
    return out.withColumn("row", F.col("_r") - 1).withColumn("col", (F.col("_c") - 1).cast("int")).drop("_r", "_c")


def nearest_distance(df: DataFrame, cell: float = 0.2, narrow: float | None = None, stripe: int = 4096) -> DataFrame:
    """row, col, dist: Euclidean distance to the nearest cell with v > 0, times the cell size.

    Two exact passes: along each row the nearest source to either side by windows that
    carry the last source seen, then along each column the minimum of dy^2 + g^2, found
    on column groups in numpy with the lower envelope of parabolas. Without any source
    the distance is null; beyond ``narrow`` it is null too.
    """
    is_src = F.col("v") > 0
    left = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("row").orderBy(F.col("col").desc()).rowsBetween(Window.unboundedPreceding, 0)
    src = F.when(is_src, F.col("col"))
    g = df.select("row", "col", F.last(src, True).over(left).alias("a"), F.last(src, True).over(right).alias("b"))
    g = g.select("row", "col", F.least(F.col("col") - F.col("a"), F.col("b") - F.col("col")).cast("double").alias("g"))

    def envelope(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        y, f = pdf["row"].to_numpy(float), pdf["g"].to_numpy(float) ** 2
        ok = np.flatnonzero(np.isfinite(f))
        if not len(ok):
            return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "d": np.nan})
        hull, cut = [int(ok[0])], [-np.inf]
        for i in ok[1:].tolist():
            while True:
                j = hull[-1]
                s = ((f[i] + y[i] ** 2) - (f[j] + y[j] ** 2)) / (2 * (y[i] - y[j]))
                if s > cut[-1]:
                    break
                hull.pop()
                cut.pop()
            hull.append(i)
            cut.append(s)
        at = np.array(hull)[np.searchsorted(cut, y, side="right") - 1]
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "d": np.sqrt((y - y[at]) ** 2 + f[at])})

    d = g.groupBy("col").applyInPandas(envelope, "row long, col int, d double")
    dist = F.when(~F.isnan("d"), F.col("d") * cell)
    if narrow is not None:
        dist = F.when(dist <= narrow, dist)
    return d.select("row", "col", dist.alias("dist"))


def water_masks(df: DataFrame) -> DataFrame:
    """row, col, fresh (1 where v > 0) and sea (its negation)."""
    return df.select("row", "col", (F.col("v") > 0).cast("int").alias("fresh"), (~(F.col("v") > 0)).cast("int").alias("sea"))


def skip_empty_tiles(df: DataFrame, size: int = 256) -> DataFrame:
    """ty, tx of the tiles that hold any valid cell: the others need no work and stay 0."""
    return df.select(F.floor(F.col("row") / size).alias("ty"), F.floor(F.col("col") / size).alias("tx"), "v").groupBy("ty", "tx").agg(F.max(F.abs("v")).alias("top")).where("top > 0").select("ty", "tx")
