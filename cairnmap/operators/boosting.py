"""Gradient-boosted trees in numpy, one model per Arrow group, and ensembles of them.

Second-order boosting over quantile histograms with L1 and L2 penalties on leaves, a
split cost, minimal child weight, bounded leaf steps, row and column sampling, dropout of
trees, and early stopping on the training loss. Spark deals models over tasks; each
group holds one run's bounded training sample.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, sampling, votes


@dataclass(frozen=True)
class Params:
    """objective: binary (logistic), softmax, or regression on 0..1 (logistic link). dropout: share of trees left out of a round."""

    objective: str = "binary"
    n_classes: int = 2
    depth: int = 4
    eta: float = 0.3
    lam: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child: float = 1.0
    max_step: float = 0.0
    pos_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    rounds: int = 60
    stop: int = 10
    dropout: float = 0.0
    skip_dropout: float = 0.4
    bins: int = 32
    seed: int = 1


def params_of(kind: int, n_classes: int = 2, **more) -> Params:
    """Kinds: 0 logistic, 1 softmax, 2 logistic with tree dropout, 3 softmax with tree dropout, 4 logistic regression target."""
    table = {0: ("binary", 0.0), 1: ("softmax", 0.0), 2: ("binary", 0.2), 3: ("softmax", 0.2), 4: ("regression", 0.0)}
    if kind not in table:
        raise ValueError(f"unknown kind of booster: {kind}")
    objective, drop = table[kind]
    return Params(objective=objective, n_classes=n_classes if objective == "softmax" else 2, dropout=drop, **more)


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.value.append(0.0)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, cut, left, value = (np.array(a) for a in (self.feature, self.cut, self.left, self.value))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if not len(inner):
                return value[at]
            n = at[inner]
            at[inner] = left[n] + (x[inner, f[n]] > cut[n])


class Booster:
    def __init__(self, params: Params):
        self.p = params
        self.trees: list[list[Tree]] = []
        self.weight: list[float] = []

    def _leaf(self, g: float, h: float) -> float:
        p = self.p
        g = np.sign(g) * max(abs(g) - p.alpha, 0.0)
        v = -g / (h + p.lam)
        return float(np.clip(v, -p.max_step, p.max_step)) if p.max_step else float(v)

    def _tree(self, b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Tree:
        p, tree, n_bins = self.p, Tree(), self.p.bins
        stack = [(tree.add(), rows, 0)]
        while stack:
            node, r, depth = stack.pop()
            sg, sh = g[r].sum(), h[r].sum()
            tree.value[node] = self._leaf(sg, sh)
            if depth >= p.depth or len(r) < 2:
                continue

            def gain(a, b_):
                a = np.sign(a) * np.maximum(np.abs(a) - p.alpha, 0)
                return a * a / (b_ + p.lam)

            flat = (b[np.ix_(r, cols)] + np.arange(len(cols)) * n_bins).ravel()
            hg = np.bincount(flat, np.repeat(g[r], len(cols)), len(cols) * n_bins).reshape(len(cols), n_bins).cumsum(1)[:, :-1]
            hh = np.bincount(flat, np.repeat(h[r], len(cols)), len(cols) * n_bins).reshape(len(cols), n_bins).cumsum(1)[:, :-1]
            score = (gain(hg, hh) + gain(sg - hg, sh - hh) - gain(sg, sh)) / 2 - p.gamma
            score[(hh < p.min_child) | (sh - hh < p.min_child)] = -np.inf
            k = int(score.argmax())
            if not score.size or score.flat[k] <= 1e-12:
                continue
            c, cut = divmod(k, n_bins - 1)
            f = int(cols[c])
            if cut >= len(edges[f]):
                continue
            go = b[r, f] <= cut
            left = tree.add()
            right = tree.add()
            tree.feature[node], tree.cut[node], tree.left[node] = f, float(edges[f][cut]), left
            stack += [(left, r[go], depth + 1), (right, r[~go], depth + 1)]
        return tree

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Booster:
        p, rng = self.p, np.random.default_rng(self.p.seed)
        n, m = x.shape
        w = np.ones(n) if w is None else w * n / w.sum()
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, p.bins) / p.bins)) for j in range(m)]
        b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if m else np.zeros((n, 0), int)
        k = p.n_classes if p.objective == "softmax" else 1
        hot = np.eye(k)[y.astype(int)] if k > 1 else y[:, None].astype(float)
        if k == 1 and p.objective == "binary":
            w = w * np.where(y == 1, p.pos_weight, 1.0)
        outs: list[np.ndarray] = []
        best, since = np.inf, 0
        for _ in range(p.rounds):
            drop: list[int] = []
            if p.dropout and outs and rng.random() >= p.skip_dropout:
                drop = np.flatnonzero(rng.random(len(outs)) < p.dropout).tolist()
            z = np.zeros((n, k))
            for i, o in enumerate(outs):
                if i not in drop:
                    z += self.weight[i] * o
            pr = self._link(z)
            g, h = (pr - hot) * w[:, None], np.maximum(pr * (1 - pr), 1e-12) * w[:, None] * (2 if k > 1 else 1)
            rows = np.sort(rng.permutation(n)[: max(1, int(n * p.subsample))]) if p.subsample < 1 else np.arange(n)
            cols = np.sort(rng.permutation(m)[: max(1, int(m * p.colsample))]) if p.colsample < 1 else np.arange(m)
            trees = [self._tree(b, edges, g[:, c], h[:, c], rows, cols) for c in range(k)]
            outs.append(np.column_stack([t.predict(x) for t in trees]))
            self.trees.append(trees)
            self.weight.append(p.eta)
            if drop:  # the new trees and those left out share their place
                scale = 1 / (1 + p.eta)
                self.weight[-1] = p.eta * scale
                for i in drop:
                    self.weight[i] *= scale
            pr = self._link(sum(a * o for a, o in zip(self.weight, outs, strict=True)))
            q = np.clip(pr, 1e-12, 1 - 1e-12)
            loss = -(w[:, None] * (hot * np.log(q) + (0 if k > 1 else (1 - hot) * np.log(1 - q)))).sum() / w.sum()
            if loss < best - 1e-9:
                best, since = loss, 0
            else:
                since += 1
                if since >= p.stop:
                    break
        return self

    def _link(self, z: np.ndarray) -> np.ndarray:
        if z.shape[1] == 1:
            return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(n, classes) probabilities, or (n,) for a single output."""
        k = self.p.n_classes if self.p.objective == "softmax" else 1
        z = np.zeros((len(x), k))
        for weight, trees in zip(self.weight, self.trees, strict=True):
            z += weight * np.column_stack([t.predict(x) for t in trees])
        out = self._link(z)
        return out if k > 1 else out[:, 0]

    def split_counts(self, n_features: int) -> np.ndarray:
        """How often each feature splits: its score."""
        return np.bincount([f for ts in self.trees for t in ts for f in t.feature if f >= 0], minlength=n_features)

    def dump(self) -> bytes:
        return pickle.dumps((self.p, [[(t.feature, t.cut, t.left, t.value) for t in ts] for ts in self.trees], self.weight))

    @classmethod
    def load(cls, raw: bytes) -> Booster:
        p, trees, weight = pickle.loads(raw)
        out = cls(p)
        out.trees, out.weight = [[Tree(*t) for t in ts] for ts in trees], weight
        return out


def _expanded(x: np.ndarray, n_classes: int) -> np.ndarray:
    """Each row once for each class, the class appended as a feature."""
    return np.column_stack((np.repeat(x, n_classes, 0), np.tile(np.arange(n_classes), len(x))))


def fit_one(x: np.ndarray, y: np.ndarray, method: str, p: Params, w: np.ndarray | None = None) -> Booster:
    """method: softmax, category (one binary model of whether row and class belong together) or binary.

    Weights of rows are for softmax and binary. A weighted category model weighs pairs that
    belong together by how many do not for each that does; instance weights play no part,
    since every row meets every class there.
    """
    if method == "category":
        hit = (np.repeat(y, p.n_classes) == np.tile(np.arange(p.n_classes), len(y))).astype(float)
        ratio = 1.0 if w is None else float((hit == 0).sum() / max(hit.sum(), 1))
        return Booster(replace(p, objective="binary", pos_weight=ratio)).fit(_expanded(x, p.n_classes), hit)
    return Booster(replace(p, objective="softmax" if method == "softmax" else p.objective)).fit(x, y, w)


def predict_one(model: Booster, x: np.ndarray, method: str, n_classes: int) -> np.ndarray:
    """(n, classes) probabilities; for binary (n, 2)."""
    if method == "category":
        return model.predict(_expanded(x, n_classes)).reshape(-1, n_classes)
    p = model.predict(x)
    return p if p.ndim == 2 else np.column_stack((1 - p, p))


def class_weights(y: np.ndarray) -> np.ndarray:
    n = np.bincount(y.astype(int))
    w = (len(y) - n[y.astype(int)]) / len(y)
    return w / w.sum() if w.sum() else np.full(len(y), 1 / len(y))


def train_ensemble(samples: DataFrame, n_features: int, runs: int, params: Params, method: str = "softmax", metric: str = "kappa", train_share: float = 0.7, column_rate: float = 0.7, clusters: DataFrame | None = None, power: float = 2, threshold: float = 0.0, weighted: bool = False, seed: int = 1) -> DataFrame:
    """run, metric, weight, features, model: base models fitted in parallel, one group for each run.

    Every run draws columns (by cluster where given) and a stratified share of the samples
    (id, y, x); the rest scores it. A run that fails scores 0. The sample table is the
    bounded training set of the maps, replicated to runs; models stay in the table.
    """
    spark = samples.sparkSession
    if clusters is None:
        clusters = spark.createDataFrame([(str(i), i, 0) for i in range(n_features)], "var string, pos int, cluster int")
    drawn = sampling.draw_columns(clusters.select("var", "pos", "cluster"), column_rate, [-1], runs, seed)
    cols = drawn.join(F.broadcast(clusters.select("var", "pos")), "var").groupBy("run").agg(F.array_sort(F.collect_list("pos")).alias("features"))
    rows = samples.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).join(F.broadcast(cols), "run")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        run, feats = int(pdf["run"].iloc[0]), list(pdf["features"].iloc[0])
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf["x"].to_numpy())[:, feats], pdf["y"].to_numpy(int)
        rng = np.random.default_rng(seed * 1009 + run)
        train = np.zeros(len(y), bool)
        for c in np.unique(y):
            at = rng.permutation(np.flatnonzero(y == c))
            train[at[: int(len(at) * train_share)]] = True
        try:
            model = fit_one(x[train], y[train], method, replace(params, seed=seed * 7919 + run), class_weights(y[train]) if weighted else None)
            p = predict_one(model, x[~train], method, params.n_classes).argmax(1)
            score, raw = local_metric(y[~train], p, metric), model.dump()
        except (ValueError, FloatingPointError, IndexError):
            score, raw = 0.0, b""
        return pd.DataFrame([(run, float(score), [int(f) for f in feats], raw)], columns=["run", "e", "features", "model"])

    # What the models are is needed for weights and predictions alike: they are fitted once.
    fitted = rows.groupBy("run").applyInPandas(fit, "run int, e double, features array<int>, model binary").persist()
    return fitted.join(F.broadcast(votes.ensemble_weights(fitted.select("run", "e"), power, threshold)), "run")


def local_metric(y: np.ndarray, p: np.ndarray, metric: str) -> float:
    if metric == "accuracy":
        return float((y == p).mean())
    if metric == "kappa":
        n = len(y)
        k = max(y.max(), p.max()) + 1
        po, pe = (y == p).mean(), (np.bincount(y, minlength=k) * np.bincount(p, minlength=k)).sum() / n / n
        return float((po - pe) / (1 - pe)) if pe < 1 else 0.0
    if metric not in metrics.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    raise ValueError(f"metric {metric} is not for runs")


def models_of(ensemble: DataFrame, most: int = 256 << 20) -> list[tuple[int, float, list[int], bytes]]:
    """run, weight, features and model of the runs of positive weight; refuses more than ``most`` bytes of models."""
    live = ensemble.where("weight > 0").select("run", "weight", "features", "model")
    size = live.agg(F.sum(F.length("model"))).first()[0] or 0
    if size > most:
        raise ValueError("the ensemble is too large to broadcast; predict it in parts of runs")
    return [(r["run"], r["weight"], list(r["features"]), bytes(r["model"])) for r in live.orderBy("run").collect()]


def run_predictions(rows: DataFrame, ensemble: DataFrame, n_classes: int, method: str = "softmax") -> DataFrame:
    """run, id, pred, prob (of class 1), probs for each row and each run of positive weight.

    The ensemble goes to the rows: models are broadcast after their size is checked.
    """
    models = rows.sparkSession.sparkContext.broadcast(models_of(ensemble))

    def run(batches):
        known = [(k, f, Booster.load(raw)) for k, _, f, raw in models.value if raw]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            for k, f, model in known:
                p = predict_one(model, x[:, f], method, n_classes)
                yield pd.DataFrame({"run": k, "id": pdf["id"], "pred": p.argmax(1), "prob": p[:, min(1, p.shape[1] - 1)], "probs": list(p)})

    return rows.select("id", "x").mapInPandas(run, "run int, id long, pred int, prob double, probs array<double>")


def predict_ensemble(rows: DataFrame, ensemble: DataFrame, n_classes: int, method: str = "softmax") -> DataFrame:
    """id, pred, votes: weighted votes of the runs."""
    return votes.hard_vote(run_predictions(rows, ensemble, n_classes, method).select("run", "id", "pred"), ensemble.select("run", "weight"))


def predict_binary_ensemble(rows: DataFrame, ensemble: DataFrame, threshold: float = 0.5) -> DataFrame:
    """id, p, pred: the weighted mean probability and whether it reaches the threshold."""
    return votes.soft_vote(run_predictions(rows, ensemble, 2, "binary").select("run", "id", "prob"), ensemble.select("run", "weight"), threshold)


def feature_scores(ensemble: DataFrame, names: list[str]) -> DataFrame:
    """feature, score: split counts over the runs, 0 for features that never split."""

    def counts(batches):
        for pdf in batches:
            for feats, raw in zip(pdf["features"], pdf["model"], strict=True):
                if raw:
                    n = Booster.load(bytes(raw)).split_counts(len(feats))[: len(feats)]
                    yield pd.DataFrame({"pos": np.asarray(feats, int), "n": n.astype(int)})

    got = ensemble.select("features", "model").mapInPandas(counts, "pos int, n long").groupBy("pos").agg(F.sum("n").alias("n"))
    every = ensemble.sparkSession.createDataFrame(list(enumerate(names)), "pos int, feature string")
    return every.join(got, "pos", "left").select("feature", F.coalesce("n", F.lit(0)).alias("score"))


def hierarchical(samples: DataFrame, rows: DataFrame, relation: DataFrame, n_features: int, params: Params, runs: int = 3, seed: int = 1) -> DataFrame:
    """id, upper, lower, p: for every row the child class within its upper class.

    samples: id, upper, lower, x; rows: id, upper, x. Each upper class with several
    children has its own model, fitted in one group for each parent and run; an only
    child is a constant with probability 1.
    """
    kids = relation.select("upper", "lower").distinct().groupBy("upper").agg(F.array_sort(F.collect_list("lower")).alias("lowers"))
    many = kids.where(F.size("lowers") > 1)
    train = samples.join(F.broadcast(many), "upper").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        lowers = list(pdf["lowers"].iloc[0])
        local = {c: i for i, c in enumerate(lowers)}
        x, y = np.stack(pdf["x"].to_numpy()), pdf["lower"].map(local).to_numpy(int)
        model = fit_one(x, y, "softmax", replace(params, n_classes=len(lowers), seed=seed + int(pdf["run"].iloc[0]), subsample=0.8))
        return pd.DataFrame([(int(pdf["upper"].iloc[0]), int(pdf["run"].iloc[0]), [int(c) for c in lowers], model.dump())], columns=["upper", "run", "lowers", "model"])

    models = train.groupBy("upper", "run").applyInPandas(fit, "upper int, run int, lowers array<int>, model binary")
    shared = rows.sparkSession.sparkContext.broadcast([(r["upper"], list(r["lowers"]), bytes(r["model"])) for r in models.collect()])  # upper classes x runs

    def predict(batches):
        by: dict[int, list] = {}
        for up, lowers, raw in shared.value:
            by.setdefault(up, []).append((lowers, Booster.load(raw)))
        for pdf in batches:
            for up, part in pdf.groupby("upper"):
                if up not in by:
                    continue
                x = np.stack(part["x"].to_numpy())
                p = sum(m.predict(x) for _, m in by[up]) / len(by[up])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "upper": int(up), "lower": np.array(by[up][0][0])[p.argmax(1)], "p": p.max(1)})

    several = rows.join(F.broadcast(many.select("upper")), "upper", "left_semi").select("id", "upper", "x").mapInPandas(predict, "id long, upper int, lower int, p double")
    single = rows.join(F.broadcast(kids.where(F.size("lowers") == 1)), "upper").select("id", "upper", F.element_at("lowers", 1).alias("lower"), F.lit(1.0).alias("p"))
    return several.unionByName(single)
