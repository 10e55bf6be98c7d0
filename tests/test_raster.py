"""Focal, texture, resampling and distance operators against plain numpy on small grids."""

import numpy as np
import pytest

from cairnmap.operators import focal, glcm


def frame(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row long, col int, v double")


def grid(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[column]
    return out


def brute_stats(a, w=7):
    r = w // 2
    out = np.zeros((4, *a.shape))
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            if a[i, j] == 0:
                continue
            v = a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1].ravel()
            v = v[v != 0]
            m = v.mean()
            s = np.sqrt(((v - m) ** 2).mean() + 1e-4)
            out[:, i, j] = s, s / (m + 1e-4), (((v - m) / s) ** 3).mean(), (((v - m) / s) ** 4).mean()
    return out


def test_constant_window(spark):
    s = focal.focal_stats(frame(spark, np.full((7, 7), 3.0))).where("row = 3 and col = 3").first()
    assert s["std"] == pytest.approx(0.01, abs=1e-7) and s["cv"] == pytest.approx(0.01 / 3.0001, abs=1e-7)
    assert s["skew"] == pytest.approx(0, abs=1e-6) and s["kurt"] == pytest.approx(0, abs=1e-6)


def test_stats_match_brute_force_for_any_stripe(spark):
    a = np.random.default_rng(1).normal(size=(23, 17)).round(3)
    a[2, 2] = a[0, 0] = 0
    for stripe in (4096, 5):
        got = focal.focal_stats(frame(spark, a), stripe=stripe)
        for k, name in enumerate(("std", "cv", "skew", "kurt")):
            assert np.allclose(grid(got, name, a.shape), brute_stats(a)[k], atol=1e-6)


def test_all_nodata(spark):
    a = np.zeros((5, 5))
    assert focal.focal_stats(frame(spark, a)).where("std <> 0 or cv <> 0").count() == 0
    assert focal.skip_empty_tiles(frame(spark, a), 4).count() == 0
    assert focal.median_filter(frame(spark, a), 3).where("v <> 0").count() == 0


def test_tiles_do_not_change_results(spark):
    a = np.random.default_rng(2).normal(size=(20, 20))
    df = frame(spark, a)
    for f in (lambda n: focal.median_filter(df, 5, n), lambda n: focal.disk_filter(df, 3, n), lambda n: focal.gaussian_filter(df, 5, 1.0, n)):
        assert np.allclose(grid(f(64), "v", a.shape), grid(f(7), "v", a.shape))


def test_kernels_sum_to_one():
    assert sum(focal.disk_kernel(5).values()) == pytest.approx(1)
    assert sum(focal.gaussian_kernel(25, 3.5).values()) == pytest.approx(1)


def test_resample_centre_rule(spark):
    a = np.arange(35.0).reshape(7, 5)
    got = focal.resample(frame(spark, a), 2)
    rows = [int(np.ceil((i - 0.5) * 7 / 4)) - 1 for i in range(1, 5)]
    cols = [int(np.ceil((i - 0.5) * 5 / 3)) - 1 for i in range(1, 4)]
    assert np.array_equal(grid(got, "v", (4, 3)), a[np.ix_(rows, cols)])


def test_distance(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((15, 12)) < 0.06).astype(float)
    a[4, 7] = 1
    src = np.argwhere(a > 0)
    want = np.array([[np.sqrt(((src - [i, j]) ** 2).sum(1)).min() for j in range(12)] for i in range(15)]) * 0.2
    assert np.allclose(grid(focal.nearest_distance(frame(spark, a), 0.2), "dist", a.shape), want)
    assert focal.nearest_distance(frame(spark, np.zeros((4, 4)))).where("dist is not null").count() == 0


def test_quantiser_ties_and_levels(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (0.5,), (3.0,)], "v double").select(glcm.level_of(__import__("pyspark").sql.functions.col("v"), [1.0, 2.0]).alias("q"))
    assert [r["q"] for r in rows.collect()] == [0, 1, 0, 2]


def test_flat_texture(spark):
    t = glcm.textures(frame(spark, np.full((9, 9), 2.0)), [0.0, 1.0, 3.0]).where("row = 4 and col = 4").first()
    assert t["asm"] == pytest.approx(4) and t["contrast"] == 0
    h = glcm.textures(frame(spark, np.full((9, 9), 2.0)), [0.0, 1.0, 3.0], mode="haralick").where("row = 4 and col = 4").first()
    assert h["asm"] == pytest.approx(1)


def test_textures_match_direct_counting(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 12))
    cuts = [-1.0, -0.3, 0.2, 0.9]
    got = {(r["row"], r["col"]): r for r in glcm.textures(frame(spark, a), cuts, window=5, size=5).collect()}
    pad = np.pad(a, 2)
    q = np.searchsorted(cuts, pad)
    for i, j in ((0, 0), (6, 5), (11, 11)):
        w = q[i : i + 5, j : j + 5]
        parts = []
        for dy, dx in glcm.DIRECTIONS:
            m = np.zeros((5, 5))
            for y in range(5):
                for x in range(5):
                    if 0 <= y + dy < 5 and 0 <= x + dx < 5:
                        m[w[y, x], w[y + dy, x + dx]] += 1
                        m[w[y + dy, x + dx], w[y, x]] += 1
            parts.append(m / m.sum())
        want = glcm.measures(np.array(parts)).sum(0)
        assert np.allclose([got[i, j][k] for k in glcm.MEASURES], want)


def test_measures_by_hand():
    p = np.array([[[0.5, 0.25], [0.25, 0.0]]])
    m = dict(zip(glcm.MEASURES, glcm.measures(p)[0], strict=True))
    assert m["asm"] == pytest.approx(0.375) and m["contrast"] == pytest.approx(0.5) and m["idm"] == pytest.approx(0.75)
    assert m["sum_average"] == pytest.approx(2 * 0.5 + 3 * 0.5)
    mu = 2 * 0.25
    assert m["variance"] == pytest.approx(0.75 * mu**2 + 0.25 * (1 - mu) ** 2)
    minus = np.array([1.0, 0.5])  # the diagonal counted twice
    assert m["difference_variance"] == pytest.approx(minus.var())


def test_rotation_keeps_summed_textures(spark):
    a = np.random.default_rng(5).normal(size=(11, 11))
    cuts = [-0.5, 0.0, 0.5]
    one = grid(glcm.textures(frame(spark, a), cuts, 9), "entropy", a.shape)
    two = grid(glcm.textures(frame(spark, np.rot90(a).copy()), cuts, 9), "entropy", a.shape)
    assert np.allclose(np.rot90(one), two)
