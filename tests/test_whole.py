"""Raster and feature queries over whole tables against brute force in numpy, on every row or cell."""

import numpy as np
import pandas as pd
import pytest

from cairnmap.operators import focal, glcm
from cairnmap.plans import catalog


@pytest.fixture(scope="module")
def raster(data):
    e = pd.read_parquet(f"{data}/embeddings.parquet").sort_values("vec_id")
    assert list(e.vec_id) == list(range(len(e)))
    return np.round(np.stack(e.embedding.to_numpy()).astype(float), 3)


def grid(spark, data, name, column, shape):
    rows = catalog.QUERIES[name](spark, data).toPandas()
    assert len(rows) == shape[0] * shape[1] and not rows.duplicated(["row", "col"]).any()
    out = np.full(shape, np.nan)
    out[rows.row, rows.col] = rows[column]
    return out


def windows(a, r):
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r), (2 * r + 1, 2 * r + 1))


def test_median_of_all_cells(spark, data, raster):
    assert np.allclose(grid(spark, data, "W7_median_filter", "v", raster.shape), np.median(windows(raster, 2), axis=(2, 3)), atol=2e-6)


def test_disk_of_all_cells(spark, data, raster):
    k = np.zeros((11, 11))
    for (dy, dx), w in focal.disk_kernel(5).items():
        k[dy + 5, dx + 5] = w
    assert np.allclose(grid(spark, data, "W10_W13_disk_filter", "v", raster.shape), np.einsum("ijkl,kl->ij", windows(raster, 5), k), atol=2e-6)


def test_gaussian_of_all_cells(spark, data, raster):
    g = np.exp(-(np.arange(-12, 13) ** 2) / (2 * 3.5**2))
    k = np.outer(g, g) / g.sum() ** 2
    assert np.allclose(grid(spark, data, "W8_gaussian_filter", "v", raster.shape), np.einsum("ijkl,kl->ij", windows(raster, 12), k), atol=2e-6)


def test_distance_of_all_cells(spark, data, raster):
    src = np.argwhere(raster > 0.35)
    want = np.array([[np.sqrt(((src - [i, j]) ** 2).sum(1).min()) for j in range(raster.shape[1])] for i in range(raster.shape[0])]) * 0.2
    assert np.allclose(grid(spark, data, "L23_P7_distance", "dist", raster.shape), want, atol=2e-6)


def test_textures_of_all_cells(spark, data, raster):
    names = ["asm", "contrast", "idm", "sum_average", "sum_entropy", "entropy"]
    one, two = (catalog.QUERIES[n](spark, data).toPandas().set_index(["row", "col"]).sort_index() for n in ("W6_J11_J12_G1_G2_G5_G6_G8_G9_textures", "J11_textures_relational"))
    assert list(one.index) == [tuple(x) for x in np.argwhere(raster != 0)] and one.index.equals(two.index)
    assert np.allclose(one[names], two[names], atol=2e-6)
    q = np.searchsorted(catalog.THRESHOLDS, np.pad(raster, 4), side="left")
    n = len(catalog.THRESHOLDS) + 1
    for i, j in ((0, 0), (19, 20), (250, 40), (raster.shape[0] - 1, raster.shape[1] - 1)):
        parts = []
        for dy, dx in glcm.DIRECTIONS:
            m = np.zeros((n, n))
            for y in range(9):
                for x in range(9):
                    if 0 <= y + dy < 9 and 0 <= x + dx < 9:
                        m[q[i + y, j + x], q[i + y + dy, j + x + dx]] += 1
                        m[q[i + y + dy, j + x + dx], q[i + y, j + x]] += 1
            parts.append(m / m.sum())
        want = dict(zip(glcm.MEASURES, glcm.measures(np.array(parts)).sum(0), strict=True))
        assert np.allclose(one.loc[(i, j), names].to_numpy(float), [want[k] for k in names], atol=2e-6)


def test_correlation_of_all_pairs(spark, data, raster):
    got = catalog.QUERIES["A22_correlation"](spark, data).toPandas()
    want = np.corrcoef(raster.T)
    assert len(got) == 64 * 63 // 2 and (got.i < got.j).all()
    assert np.allclose(got.r, want[got.i, got.j], atol=2e-6)


@pytest.mark.parametrize("tile", [16, 40, 256])
def test_fused_chain_is_one_filter_after_the_other(spark, tile):
    rng = np.random.default_rng(11)
    cells = [(r, c, float(rng.integers(0, 9))) for r in range(37) for c in range(45) if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "row long, col int, v double")
    long = focal.disk_filter(focal.median_filter(focal.gaussian_filter(focal.median_filter(df, 11), 25, 3.5), 5), 5)
    short = focal.disk_filter(focal.median_filter(df, 15), 5)
    for fused, steps in ((focal.smooth_long(df, tile=tile), long), (focal.smooth_short(df, tile=tile), short)):
        a, b = ({(r["row"], r["col"]): r["v"] for r in x.collect()} for x in (fused, steps))
        assert a.keys() == b.keys() and len(a) == len(cells)
        assert max(abs(a[k] - b[k]) for k in a) < 1e-12
