"""Sources, sinks, lookups, votes, sampling and models on hand-made inputs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnmap.operators import boosting, lookup, metrics, sampling, selection, votes
from cairnmap.sources import geotiff, tables
from cairnmap.streaming import votes as streaming


@pytest.mark.parametrize("dtype", [*geotiff.DTYPES, 8, 16, 32, -16, -32, 1])
@pytest.mark.parametrize("orientation", [1, 2, 3, 4, 5, 6, 7, 8])
def test_geotiff_round_trip(dtype, orientation):
    a = np.random.default_rng(1).integers(0, 2 if dtype == 1 else 100, (8, 16)).astype(float)
    geo = geotiff.Georeference(10.5, 45.25, 0.5, -0.25, {1024: 2, 2048: 4326, 2049: "WGS 84", 2057: 6378137.0})
    b, g, nodata = geotiff.decode(geotiff.encode(a, geo, dtype, nodata=-9999, orientation=orientation))
    assert np.array_equal(b[:, :, 0], a) and g == geo and nodata == -9999
    assert g.bounds(8, 16) == (45.25, 10.5, 18.5, 43.25)


def test_geotiff_errors_and_extras():
    with pytest.raises(ValueError):
        geotiff.encode(np.zeros((2, 2)), dtype="Complex64")
    with pytest.raises(ValueError):
        geotiff.encode(np.zeros((2, 3)), dtype=1)
    with pytest.raises(ValueError):
        geotiff.decode(b"no tiff")
    a = geotiff.decode(geotiff.encode(np.array([[np.nan, 1.0]]), nan_to=0))[0]
    assert a[0, 0, 0] == 0
    assert len(geotiff.encode(np.zeros((4, 4, 3)), dtype=8)) > 48
    assert geotiff.decode(geotiff.encode(np.ones((2, 8)), dtype=8, colormap=np.eye(256, 3)))[0].sum() == 16


def test_geotiff_through_spark(spark, tmp_path):
    cells = spark.range(12).select(F.lit("ndvi").alias("band"), F.floor(F.col("id") / 4).alias("row"), (F.col("id") % 4).cast("int").alias("col"), (F.col("id") * 1.5).alias("v"))
    geotiff.write(cells, str(tmp_path / "maps"), geotiff.Georeference(1, 2, 3, -4))
    back = geotiff.read(spark, str(tmp_path / "maps"))
    assert {(r["row"], r["col"]): r["v"] for r in back.collect()} == {(i // 4, i % 4): i * 1.5 for i in range(12)}
    m = geotiff.metadata(spark, str(tmp_path / "maps")).first()
    assert (m["n_rows"], m["n_cols"], m["top"], m["left"], m["right"], m["bottom"]) == (3, 4, 2, 1, 13, -10)
    assert geotiff.read(spark, str(tmp_path / "maps"), ["other"]).count() == 0


def test_side_cars_and_csv(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("0.5\n0\n0\n-0.25\n10\n20\n")
    w = tables.read_world_files(spark, str(tmp_path / "a.tfw")).first()
    assert (w["file"], w["px_w"], w["px_h"], w["x"], w["y"]) == ("a", 0.5, -0.25, 10, 20)
    (tmp_path / "b.tif.aux.xml").write_text('<PAMDataset><MDI key="STATISTICS_MINIMUM">1.5</MDI><MDI key="STATISTICS_MAXIMUM">2</MDI><MDI key="STATISTICS_MEAN">1.7</MDI><MDI key="STATISTICS_STDDEV">0.1</MDI></PAMDataset>')
    s = tables.read_statistics(spark, str(tmp_path / "b.tif.aux.xml")).first()
    assert (s["file"], s["minimum"], s["maximum"], s["mean"], s["stddev"]) == ("b", 1.5, 2, 1.7, 0.1)
    df = spark.createDataFrame([("x", 1.5), ("y", 2.5)], "name string, v double")
    tables.write_report(df, str(tmp_path / "r"), ["name"])
    back = tables.read_csv(spark, str(tmp_path / "r"), "ID int, name string, v double").orderBy("ID").collect()
    assert [tuple(r) for r in back] == [(1, "x", 1.5), (2, "y", 2.5)]
    assert tables.column_list(df, "name") == ["x", "y"]
    with pytest.raises(ValueError):
        tables.column_list(df, "name", 1)
    assert tables.raster_paths("d", ["a"]) == ["d/a.tif"]


def test_training_set_and_ragged(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "a int, b int, f double")
    assert [tuple(r) for r in tables.training_set(df, ["f"], one_hot=["a", "b"]).collect()] == [(1, [2.0]), (0, [3.0])]
    with pytest.raises(ValueError):
        tables.training_set(df, ["g"], label="a")
    r = tables.ragged(spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "run int, features array<string>")).collect()
    assert [tuple(x) for x in r] == [(0, "a", "c"), (1, "b", None)]


def test_lookup_modes(spark):
    names = spark.createDataFrame([(1, "b"), (2, "zzz")], "id long, name string")
    classes = lookup.classes_of(["a", "b"], spark)
    assert {r["id"]: r["class_id"] for r in lookup.name_to_id(names, classes).collect()} == {1: 1, 2: 0}
    with pytest.raises(Exception, match="unknown class"):
        lookup.name_to_id(names, classes, strict=True).collect()


def test_hierarchy_with_only_child(spark):
    rel = spark.createDataFrame([(0, 1, 0), (1, 2, 1), (2, 5, 2), (2, 3, 3)], "upper int, lower int, pos int")
    h = {r["upper"]: list(r["lowers"]) for r in lookup.hierarchy(rel).collect()}
    assert h == {0: [1], 1: [2], 2: [5, 3]}
    base = spark.createDataFrame([(1, 0), (2, 2), (3, 2)], "id long, upper int")
    p = spark.createDataFrame([(1, 1, 0.1), (2, 3, 0.5), (2, 5, 0.5), (3, 5, 0.6)], "id long, lower int, p double")
    got = {r["id"]: (r["lower"], r["p"]) for r in lookup.map_down(base, p, rel).collect()}
    assert got == {1: (1, 1.0), 2: (3, 0.5), 3: (5, 0.6)}


def test_nodata_corner_nan(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 1.0)], "row long, col int, v double")
    assert all(r["live"] for r in lookup.nodata_mask(df).collect())


def test_votes_ties_and_weights(spark):
    v = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (2, 1, 0)], "run int, id long, pred int")
    w = spark.createDataFrame([(0, 0.4), (1, 0.4), (2, 0.2)], "run int, weight double")
    assert votes.hard_vote(v, w).first()["pred"] == 1
    assert votes.combine_votes(votes.partial_votes(v, w, 2)).first()["pred"] == 1
    e = spark.createDataFrame([(0, 0.5), (1, 0.8)], "run int, e double")
    assert {r["run"]: r["weight"] for r in votes.ensemble_weights(e, 2, 0.6).collect()} == {0: 0.0, 1: 1.0}
    with pytest.raises(ValueError):
        votes.ensemble_weights(e, 2, 0.9)
    inst = votes.instance_weights(spark.createDataFrame([(0,), (0,), (1,)], "y int"))
    assert inst.agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_streaming_votes(spark, tmp_path):
    v = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (2, 1, 1)], "run int, id long, pred int")
    v.write.parquet(str(tmp_path / "in"))
    w = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.3)], "run int, weight double")
    q = streaming.running_votes(spark.readStream.schema(v.schema).parquet(str(tmp_path / "in")), w).writeStream.outputMode("complete").format("memory").queryName("votes").start()
    q.processAllAvailable()
    q.stop()
    assert streaming.decide(spark.table("votes")).first()["pred"] == 1


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0, 0), (2, 2), (2, 0)], "y int, p int")
    assert [r["n"] for r in metrics.histogram(df).orderBy("class_id").collect()] == [1, 0, 2]
    assert np.isnan(metrics.evaluate(df, "balanced-accuracy").first()["value"])
    with pytest.raises(ValueError):
        metrics.evaluate(df, "accuarcy")
    assert [tuple(r) for r in metrics.confusion_square(df).orderBy("y").collect()] == [(0, 1, 0), (2, 1, 1)]


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("y"))
    got = sampling.stratified_split(df, 0.7).groupBy("y").agg(F.sum(F.col("train").cast("int")).alias("n")).collect()
    assert {r["y"]: r["n"] for r in got} == {0: 23, 1: 23, 2: 23}
    folds = sampling.stratified_folds(df, 4, repeats=2)
    assert folds.count() == 200 and folds.groupBy("repeat", "fold", "y").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    a, b = sampling.random_split(df, 0.5)
    assert a.join(b, "id").count() == 0 and a.count() + b.count() == 100


def test_smote_fills_the_deficit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0 if i < 40 else 1, rng.normal(size=3).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    out = sampling.smote(df, -1)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 40, 1: 40}
    lo, hi = np.min([r[2] for r in rows[40:]], 0), np.max([r[2] for r in rows[40:]], 0)
    for r in out.where("synthetic").collect():
        assert (np.array(r["x"]) >= lo - 1e-9).all() and (np.array(r["x"]) <= hi + 1e-9).all()
    assert out.where("synthetic").orderBy("x").collect() == sampling.smote(df, -1).where("synthetic").orderBy("x").collect()


@pytest.mark.parametrize("method", ["softmax", "category", "binary"])
def test_boosting_beats_the_majority(method):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    k = 2 if method == "binary" else 3
    y = (x[:, 0] > 0).astype(int) if k == 2 else np.digitize(x[:, 0] + x[:, 1], [-0.7, 0.7])
    p = boosting.Params(objective="binary" if k == 2 else "softmax", n_classes=k, rounds=25, depth=3)
    m = boosting.fit_one(x[:300], y[:300], method, p)
    got = boosting.predict_one(m, x[300:], method, k)
    assert (got.argmax(1) == y[300:]).mean() > 0.8
    again = boosting.predict_one(boosting.Booster.load(m.dump()), x[300:], method, k)
    assert np.array_equal(got, again) and m.split_counts(4 + (method == "category"))[0] > 0


def test_boosting_options():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x[:, 1] > 0.2).astype(int)
    for kind in range(5):
        p = boosting.params_of(kind, 2, rounds=15, alpha=0.1, gamma=0.01, max_step=0.7, subsample=0.8, colsample=0.7)
        m = boosting.Booster(p).fit(x, y)
        out = m.predict(x)
        out = out[:, 1] if out.ndim == 2 else out
        assert ((out > 0.5) == y).mean() > 0.85
    with pytest.raises(ValueError):
        boosting.params_of(9)


def test_redundant_features_use_the_signed_correlation(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    x = np.column_stack((a, -a, a + rng.normal(size=200) * 1e-3, rng.normal(size=200)))
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id long, y int, x array<double>")
    r = selection.correlation(df, 4)
    assert np.allclose(r, np.corrcoef(x.T))
    assert selection.drop_redundant(r, ["a", "b", "c", "d"]) == ["a", "b", "d"]


def test_final_set(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.6), (4, 1.0), (5, 0.7)], "iter int, metric double")
    assert [r["iter"] for r in selection.strong_maxima(s).orderBy("iter").collect()] == [2, 4]
    sets = spark.createDataFrame([(2, "a"), (4, "a"), (4, "b"), (5, "c")], "iter int, var string")
    assert sorted(r["var"] for r in selection.final_set(sets, s).collect()) == ["a", "b"]


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_floating_selection_finds_the_telling_features(spark, mode):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4))
    y = (x[:, 1] + x[:, 3] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), r.tolist()) for i, r in enumerate(x)], "id long, y int, x array<double>")
    p = boosting.Params(objective="softmax", n_classes=2, depth=2, rounds=8)
    series, sets = selection.floating_selection(df, ["a", "b", "c", "d"], p, max_iterations=2, max_backtracks=3, k=3, mode=mode)
    assert series.count() == 2
    assert {r["var"] for r in sets.where("iter = 2").collect()} == {"b", "d"}


@pytest.mark.parametrize("gap", [False, True])
def test_report_is_each_metric_by_itself(spark, gap):
    rng = np.random.default_rng(6)
    y = rng.choice([0, 1, 3] if gap else [0, 1, 2, 3], 300)
    p = np.where(rng.random(300) < 0.7, y, rng.integers(0, 6, 300))
    df = spark.createDataFrame([(int(a), int(b), float(s)) for a, b, s in zip(y, p, rng.random(300), strict=True)], "y int, p int, s double")
    names = tuple(m for m in metrics.METRICS if m != "confmat")
    got = {r["metric"]: r["value"] for r in metrics.report(df, names).collect()}
    assert tuple(got) == tuple(m for m in names if m != "auc") + ("auc",)
    for m in names:
        alone = metrics.evaluate(df, m).first()["value"]
        assert got[m] == pytest.approx(alone, nan_ok=True) and (not gap or "-" not in m or np.isnan(alone))
    assert all(r["value"] is None for r in metrics.report(df.limit(0)).collect())
    with pytest.raises(ValueError):
        metrics.report(df, ("nonsense",))


def test_sweep_by_hold_out_repeats_and_categories(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 3))
    y = (x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), r.tolist()) for i, r in enumerate(x)], "id long, y int, x array<double>")
    params = boosting.Params(objective="softmax", n_classes=2, depth=2, rounds=6)
    train, valid = df.where("id < 160"), df.where("id >= 160")
    held = {r["pos"]: r["e"] for r in selection.sweep(train, [], [0, 1], params, valid=valid, metric="accuracy").collect()}
    model = boosting.fit_one(x[:160][:, [1]], y[:160], "softmax", replace(params, seed=1))
    assert held[1] == pytest.approx((boosting.predict_one(model, x[160:][:, [1]], "softmax", 2).argmax(1) == y[160:]).mean())
    assert held[1] > 0.9 > held[0]
    for method, repeats in (("softmax", 2), ("category", 1)):
        got = {r["pos"]: r["e"] for r in selection.sweep(df, [], [0, 1], params, k=3, method=method, repeats=repeats, weighted=True).collect()}
        assert got[1] > 0.8 > got[0]
