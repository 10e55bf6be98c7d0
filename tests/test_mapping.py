"""Maps from models: class shares, suppression, NoData, held-out scores and the best set of a selection."""

import numpy as np
import pytest

from cairnmap.operators import boosting, mapping, votes
from cairnmap.plans import catalog, views
from cairnmap.sources import geotiff, tables


@pytest.fixture(scope="module")
def ensemble(spark, data):
    p = boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=3)
    return boosting.train_ensemble(views.samples(spark, data, 7), 7, 3, p, metric="accuracy")


def test_shares_are_the_votes(spark, data, ensemble):
    s = views.samples(spark, data, 7)
    got = {r["id"]: r for r in mapping.class_shares(s, ensemble, 10).collect()}
    runs = boosting.run_predictions(s, ensemble, 10)
    best = {r["id"]: r for r in votes.hard_vote(runs.select("run", "id", "pred"), ensemble.select("run", "weight")).collect()}
    assert got.keys() == best.keys()
    for i, r in got.items():
        assert abs(sum(r["votes"]) - 1) < 1e-9 and abs(sum(r["probs"]) - 1) < 1e-9
        assert int(np.argmax(np.round(r["votes"], 12))) == best[i]["pred"] and abs(max(r["votes"]) - best[i]["votes"]) < 1e-9


def test_map_of_saved_ensemble_and_files(spark, data, ensemble, tmp_path):
    cells = views.bands(spark, data).selectExpr("pixel div 10 as row", "cast(pixel % 10 as int) as col", *[f"case when pixel = 3 then 0 when pixel = 14 then cast('nan' as double) else b{i} end as b{i}" for i in range(1, 8)])
    names = [f"b{i}" for i in range(1, 8)]
    tables.save_ensemble(ensemble, str(tmp_path / "models"))
    saved = tables.load_ensemble(spark, str(tmp_path / "models"))
    one = mapping.class_map(cells, names, saved, 10, 10, least_share=0.5).collect()
    assert len(one) == 500
    by = {(r["row"], r["col"]): r for r in one}
    assert by[0, 3]["class"] == by[1, 4]["class"] == 0 and by[0, 3]["share"] == 0
    top = max(r["share"] for r in one)
    assert all((r["class"] == 0) == (r["share"] == 0) and (r["share"] == 0 or r["share"] >= 0.5 * top) and 0 <= r["u"] <= 1 for r in one)
    mapping.write_map(mapping.class_map(cells, names, saved, 10, 10), str(tmp_path / "map"), geotiff.Georeference(1, 2, 0.5, -0.5))
    files = geotiff.metadata(spark, str(tmp_path / "map")).collect()
    assert sorted(r["band"] for r in files) == ["class", "p", "share", "u"] and all(r["left"] == 1 and r["top"] == 2 for r in files)
    assert geotiff.read(spark, str(tmp_path / "map"), ["class"]).where("v between 0 and 10").count() == 500


def test_hold_out_scores_unseen_rows(spark, data):
    s = views.samples(spark, data, 7)
    p = boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=3)
    got = mapping.hold_out(s, [0, 3, 5], p, share=0.7).collect()
    n = {r["y"]: r["count"] for r in s.groupBy("y").count().collect()}
    assert len(got) == sum(k - int(k * 0.7) for k in n.values()) and len({r["id"] for r in got}) == len(got)
    assert {r["id"]: r["y"] for r in got}.items() <= {r["id"]: r["y"] for r in s.collect()}.items()


def test_best_set(spark):
    series = spark.createDataFrame([(1, 0.5), (2, 0.79), (3, 0.8), (4, 0.8)], "iter int, metric double")
    sets = spark.createDataFrame([(i, f"v{k}") for i in range(1, 5) for k in range(i)], "iter int, var string")
    assert {r["var"] for r in mapping.best_set(sets, series).collect()} == {"v0", "v1", "v2"}
    assert {r["iter"] for r in mapping.best_set(sets, series, gain=0.02).collect()} == {2}


def test_refit_report_and_map(spark, data):
    got = catalog.QUERIES["L18_L20_selected_map"](spark, data).collect()
    live = views.bands(spark, data).count()
    assert len(got) == live and all(0 <= r["class"] <= 10 for r in got)
    s = views.samples(spark, data, 7)
    ensemble, report = mapping.refitted(s, [f"b{i}" for i in range(1, 8)], ["b2", "b5"], boosting.Params(objective="softmax", n_classes=10, depth=2, rounds=3))
    assert {r["metric"] for r in report.collect()} == {"accuracy", "kappa", "balanced-accuracy", "linear-accuracy"} and ensemble.count() == 2
