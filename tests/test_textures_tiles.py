"""The relational textures: one shuffle, of cells; the same for any tile size."""

import numpy as np

from cairnmap.operators import glcm


def test_pairs_are_counted_where_they_arise(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 6, (21, 13)) / 4.0
    df = spark.createDataFrame([(i + 3, j, float(a[i, j])) for i in range(21) for j in range(13) if (i, j) != (7, 7)], "row long, col int, v double")
    cuts = [0.1, 0.3, 0.6, 1.1]
    one, two = (glcm.textures_relational(df, cuts, size=n) for n in (5, 64))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    one, two = (t.toPandas().set_index(["row", "col"]).sort_index() for t in (one, two))
    want = glcm.textures(df, cuts).where("asm > 0").toPandas().set_index(["row", "col"]).sort_index()
    assert one.index.equals(want.index) and two.index.equals(want.index)
    assert np.allclose(one, two, atol=1e-12) and np.allclose(one, want[list(one.columns)], atol=1e-9)
