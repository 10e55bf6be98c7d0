"""Quality by compression: zstandard dictionaries of good and of bad text.

Both dictionaries are trained on whole labelled texts. A text that the dictionary of good
text compresses better than that of bad text is likely good: the difference of the two
compressed sizes, divided by the text's own size, goes through a logistic calibration to
a score from 0 to 1. Nothing else enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, tune


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = 64 << 20) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of each class, those of smallest hash: the bounded sample a classifier is fitted on.

    The rows are chosen by id before any text is moved; whole texts then arrive in the
    order of the hash until they exceed ``sample_bytes``, the bound on the driver's
    memory. ``keep`` is a condition on column _id.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)").distinct()
    every = id_text(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text").alias("t"))
    ids = every.select("_id").where(keep).distinct()
    order = F.xxhash64("_id", F.lit(label))
    picked: list = []
    for y in (0, 1):
        picked += known.where(F.col("y") == y).join(ids, "_id", "left_semi").orderBy(order, "_id").limit(rows).select("_id", "y").collect()
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame([(r["_id"], r["y"]) for r in picked], "_id long, y int")  # at most 2 * rows ids
    out, size = [], 0
    for r in every.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "y", "t").toLocalIterator():
        size += len(r["t"].encode("utf-8", "surrogatepass"))
        if out and size > sample_bytes:
            break
        out.append((r["t"], r["y"]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: float
    scale: float
    weights: np.ndarray
    level: int
    piece: int

    def sizer(self) -> Sizer:
        return Sizer(self.good, self.bad, self.level, self.piece)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = bent((x - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(np.column_stack((z, np.ones(len(z)))) @ self.weights, -30, 30)))


def bent(z: np.ndarray) -> np.ndarray:
    """The difference and hinges of it, so that the calibration may bend."""
    z = np.clip(z, -6, 6)
    return np.column_stack([z, *(np.maximum(z - k, 0) for k in (-3, -1.5, -0.5, 0.5))])


class Sizer:
    """Compressed sizes of a text under both dictionaries; piece by piece, so that the dictionary stays near."""

    def __init__(self, good: bytes, bad: bytes, level: int, piece: int):
        self.piece = piece
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, texts: list[str]) -> np.ndarray:
        """(size under bad - size under good) / size, 0 for empty texts."""
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            parts = pieces(t, self.piece)
            good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.by)
            out[i] = (bad - good) / (sum(map(len, parts)) + 16)
        return out


def pieces(text: str, size: int) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def dictionary_of(texts: list[str], size: int, piece: int) -> bytes:
    """A dictionary trained on all pieces of the texts; of too few to train on, the pieces themselves."""
    parts = [p for t in texts for p in pieces(t, piece)]
    try:
        return zstandard.train_dictionary(size, parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[-size:].rjust(8)


def fit(rows: list[tuple[str, int]], level: int = 3, piece: int = 512, dictionary: int = 110 << 10) -> Model:
    """Dictionaries from two thirds of the sample, calibration on the rest; every text whole, equal ones once."""
    rows = list(dict.fromkeys(rows))
    build, rest = [r for i, r in enumerate(rows) if i % 3 < 2], rows[2::3] or rows
    good, bad = (dictionary_of([t for t, k in build if k == y], dictionary, piece) for y in (1, 0))
    model = Model(good, bad, 0.0, 1.0, np.zeros(1), level, piece)
    x = model.sizer().difference([t for t, _ in rest]) if rest else np.zeros(1)
    low, model.mean, high = (float(v) for v in np.quantile(x, (0.1, 0.5, 0.9)))
    model.scale = (high - low) / 2 + 1e-6
    model.weights = logistic(bent((x - model.mean) / model.scale), np.array([k for _, k in rest] or [0.5], float), ridge=0.01)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, score, predicted for every row; empty and null texts are scored like any text of no bytes."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of fixed size and a few numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        sizer = m.sizer()
        for pdf in batches:
            s = m.score(sizer.difference(pdf["text"].tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": s, "predicted": (s >= threshold).astype("int32")})

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, threshold: float = 0.3, rows: int = 2000, sample_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: learned from at most ``rows`` labelled texts of each class outside the held-out fold.

    The sample ends at ``sample_bytes`` of whole texts. Null labels and labels other than
    0 and 1 are ignored; without any label every score is one half. A document labelled
    twice differently teaches both. Repeated rows and rows with null ids are scored each.
    """
    model = fit(labelled(docs, labels, label, remainder("_id", folds) != held_out, rows, id_col, text_col, sample_bytes))
    return score(docs, model, threshold, id_col, text_col).select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
