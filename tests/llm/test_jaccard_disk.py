"""What the Jaccard join stores is removed once it is used."""

import os

from cairnmap.llm import common, jaccard


def test_keys_and_texts_are_gone_when_the_join_is_planned(spark, monkeypatch):
    kept = []

    def checkpoint(df):
        out = common.checkpoint(df)
        stored = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        kept.append((set(out.columns), stored.get().removeprefix("file:")))
        return out

    monkeypatch.setattr(jaccard, "checkpoint", checkpoint)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, f"x{i % 30}"])) for i in range(60)] + [(100, None), (101, "a b"), (102, "")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in (100, 101, 102))
    heavy = [path for columns, path in kept if columns & {"payload", "text", "bits", "g"} and "_id" not in columns]
    assert len(heavy) >= 3 and not any(os.path.exists(p) for p in heavy)
