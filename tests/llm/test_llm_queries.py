"""Registered queries of the corpus operators against DuckDB, and held-out accuracy of the classifiers."""

import zlib

import pytest

from cairnmap.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, data, duck, same, name):
    same(queries.QUERIES[name](spark, data), duck.sql(queries.oracles()[name]).df())


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("name", "label", "mod", "rest", "threshold", "least"), [("op5_quality", "quality", 5, 0, 0.3, 0.8), ("op6_toxicity", "toxic", 3, 1, 0.7, 0.85)])
def test_held_out_accuracy(spark, name, label, mod, rest, threshold, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and list(got.columns[:4]) == ["doc_id", "held_out", "score", "predicted"]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert auc(both[label] == 1, both.score) > least
