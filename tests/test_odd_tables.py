"""Queries over tables made for one odd case each, against their SQL in DuckDB."""

import numpy as np
import pandas as pd
import pytest

from cairnmap.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL over embeddings given as (vec_id, first components), the rest random."""
    import duckdb

    def run(name, rows):
        rng = np.random.default_rng(1)
        e = [(i, np.concatenate((head, rng.normal(0, 0.1, 64 - len(head)))).astype(np.float32).tolist(), i % 10) for i, head in rows]
        pd.DataFrame(e, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "int64", "label": "int32"}).to_parquet(tmp_path / "embeddings.parquet")
        con = duckdb.connect()
        con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
        return catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name]).df()

    return run


def test_map_of_files_has_the_cells_of_the_scene_only(both, same):
    # The last row is short, two cells are missing and one is NoData.
    got, want = both("S4_S5_S9_S10_K1_K2_K9_map_of_files", [(i, [0.0] if i == 8 else []) for i in range(33) if i not in (4, 17)])
    assert len(want) == 31 and (want["class"] == 0).sum() == 1
    same(got, want)


def test_indices_over_zero(both, same):
    # b4 + b5 = -0.5 is the denominator of v_savi: infinities of both signs and NaN.
    got, want = both("B1_to_B17_A19_P8_indices", [(0, [0.1, 0.1, 0.1, -0.3, -0.2]), (1, [0.1, 0.1, 0.1, -0.2, -0.3]), (2, [0.1, 0.1, 0.1, -0.25, -0.25]), (3, [0.1, 0.1, 0.1, 0.0, -0.5]), (4, [])])
    assert list(np.isinf(want.sort_values("pixel")["v_savi"])) == [True, True, False, False, False]
    same(got, want)
