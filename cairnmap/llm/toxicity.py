"""Toxic spans by a linear-chain conditional random field over two tags.

Only documents carry labels, so the tokens to learn from are labelled first: in toxic
documents the tokens whose word or affixes are far more frequent in toxic documents than
in clean ones; in clean documents none. The field has a weight for each word and affix
and one for each pair of neighbouring tags; it is fitted to these tokens, the tokens of
toxic documents are labelled anew by what it believes, and it is fitted again. At
scoring, forward-backward marginals of every token of the whole text are summed; a
logistic calibration turns sum and density into the document's score, and runs of
likely tokens are the offending spans.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, tune
from .quality import labelled, logistic, remainder

#: Bytes that belong to words: digits, ASCII letters (lower case after lower()), all beyond ASCII.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Numbers that summary() gives for a document.
N_SUMMARY = 4


def tokens(text: str) -> list[str]:
    """Words in lower case, accents and case of other letters folded by str.lower()."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split()


def features(word: str) -> list[str]:
    """The word and its affixes."""
    n = len(word)
    return [word, *(f"{word[:k]}*" for k in range(3, 9) if k < n), *(f"*{word[-k:]}" for k in (4, 5) if k < n)]


#: Log weight of a chain's first token being toxic against its not being so.
START = -2.0


def both_ways(emission: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward passes over padded chains: ratios of the two tags' sums, and the emissions' ratios.

    emission: (T, B) log weight of the toxic tag against the other; trans: 2 x 2 log
    weights from tag to tag.
    """
    steps, n = emission.shape
    w = np.exp(trans)
    e = np.exp(np.clip(emission, -30, 30))
    fwd, bwd = np.empty((steps, n)), np.empty((steps, n))
    r = np.full(n, np.exp(START))
    for t in range(steps):
        r = e[t] * ((w[0, 1] + w[1, 1] * r) / (w[0, 0] + w[1, 0] * r)) if t else e[0] * r
        np.clip(r, 1e-12, 1e12, out=r)
        fwd[t] = r
    r = np.ones(n)
    for t in range(steps - 1, -1, -1):
        bwd[t] = r
        x = e[t] * r
        nxt = (w[1, 0] + w[1, 1] * x) / (w[0, 0] + w[0, 1] * x)
        r = np.where(t < length, nxt, 1.0)  # beyond the end of a chain nothing is known
    return fwd, bwd, e


def odds(emission: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of the toxic tag for each token."""
    fwd, bwd, _ = both_ways(emission, length, trans)
    fwd *= bwd
    return np.log(np.clip(fwd, 1e-12, 1e12))


def expected(emission: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, and the expected number of each pair of neighbouring tags over all chains."""
    fwd, bwd, e = both_ways(emission, length, trans)
    inside = np.arange(1, len(e))[:, None] < length
    w, x = np.exp(trans), e[1:] * bwd[1:]
    mass = np.stack((np.full_like(x, w[0, 0]), w[0, 1] * x, w[1, 0] * fwd[:-1], w[1, 1] * fwd[:-1] * x))
    mass *= inside / mass.sum(0)
    r = np.clip(fwd * bwd, 1e-12, 1e12)
    return r / (1 + r), mass.sum((1, 2)).reshape(2, 2)


def padded(chains: list[np.ndarray], size: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of chains of like length: their indices, (T, B) values and lengths; at most ``size`` cells, or one chain."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(chains[order[end]]) * (end - at + 1) <= size:
            end += 1
        group = order[at:end]
        length = np.array([len(chains[i]) for i in group])
        top = int(length.max())
        if top:
            x = np.zeros((top, len(group)), chains[0].dtype)
            for k, i in enumerate(group):
                x[: length[k], k] = chains[i]
            yield group, x, length
        at = end


@dataclass
class Model:
    weights: dict[str, float]
    bias: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.array([[0.0, -1.0], [-0.5, 0.0]]))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(N_SUMMARY + 1))
    cache: dict[str, float] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Of each word, remembered: a corpus has far more words than distinct ones."""
        cache, get = self.cache, self.weights.get
        if len(cache) > 400_000:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.bias + sum(get(f, 0.0) for f in features(w))
        return np.fromiter(map(cache.__getitem__, words), float, len(words))

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(docs)
        chains = [self.emissions(d) for d in docs]
        for group, x, length in padded(chains):
            p = 1 / (1 + np.exp(-odds(x, length, self.trans)))
            for k, i in enumerate(group):
                out[i] = p[: length[k], k]
        return out

    def document(self, marginals: list[np.ndarray]) -> np.ndarray:
        return np.array([summary(p) for p in marginals]).reshape(-1, N_SUMMARY)

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.column_stack((self.document(marginals), np.ones(len(marginals))))
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def summary(p: np.ndarray) -> tuple[float, ...]:
    """Expected number of toxic tokens, their density, the number of sure ones and the surest one, on log scales."""
    s = float(p.sum())
    top = min(1 - 1e-4, float(p.max())) if len(p) else 1e-4
    return np.log(s + 0.05), np.log((s + 0.05) / (len(p) + 20)), np.log1p(float((p > 0.9).sum())), np.log(top + 1e-4) - np.log(1 - top + 1e-4)


class Sample:
    """A labelled sample as numbers: words of each text, and each word's features, in the order of their first use."""

    def __init__(self, rows: list[tuple[str, int]]):
        index: dict[str, int] = {}
        self.texts: list[tuple[np.ndarray, int]] = []
        for text, y in dict.fromkeys(rows):  # equal texts teach once
            ids = np.array([index.setdefault(w, len(index)) for w in tokens(text)], np.int32)
            if len(ids):
                self.texts.append((ids, y))
        names: dict[str, int] = {}
        per = [[names.setdefault(f, len(names)) for f in features(w)] for w in index]
        self.n_words, self.names = len(index), list(names)
        self.size = np.array([len(x) for x in per], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.feature = np.array([f for x in per for f in x], np.int32)

    def document_frequency(self, texts: list[np.ndarray]) -> np.ndarray:
        """In how many of the texts each feature is."""
        out = np.zeros(len(self.names), np.int64)
        for ids in texts:
            w = np.unique(ids)
            n = self.size[w]
            at = np.repeat(self.begin[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[np.unique(self.feature[at])] += 1
        return out


def fit(rows: list[tuple[str, int]], chain: int = 256, epochs: int = 24, rounds: int = 2) -> Model:
    """Fit to labelled texts, all of each: long ones are cut into chains of ``chain`` tokens while learning.

    Two thirds teach the field, all the calibration, those the field has not seen thrice.
    The weights climb the chains' log likelihood by its exact gradient.
    """
    sample = Sample(rows)
    docs = list(sample.texts)
    random.Random(7).shuffle(docs)
    rest = docs[: len(docs) // 3]
    if len(rest) > 20:
        docs = docs[len(docs) // 3 :]
    y = np.array([k for _, k in docs], float)
    if not docs or y.min() == y.max():
        model = Model({})
        model.calibration = np.array([0.0] * N_SUMMARY + [10.0 if docs and y.max() else -10.0])
        return model
    n_bad, n_good = y.sum(), (1 - y).sum()
    # Features by how many documents of each class they are in.
    clean, toxic = (sample.document_frequency([d for d, k in docs if k == c]) for c in (0, 1))
    lift = np.where(toxic >= max(2, round(0.004 * n_bad)), np.log((toxic + 0.5) / (n_bad + 1)) - np.log((clean + 1.0) / (n_good + 2)), -9.0)
    # Frequent words of clean documents learn that they are clean; the rest has no weight of its own.
    plain = np.array([f[0] != "*" and f[-1] != "*" for f in sample.names])
    often = np.where(plain & (clean >= 0.01 * n_good), clean, 0)
    chosen = (lift > 0.7) | ((often > 0) & (often >= np.sort(often)[-min(len(often), 20_000)]))
    number = np.cumsum(chosen) - 1
    vocab = {f: int(number[i]) for i, f in enumerate(sample.names) if chosen[i]}
    words = range(sample.n_words)
    used = chosen[sample.feature]
    row, col = np.repeat(np.arange(sample.n_words), sample.size)[used], number[sample.feature[used]]
    seed = np.maximum.reduceat(lift[sample.feature], sample.begin)
    chains, owner = [], []
    for i, (ids, _) in enumerate(docs):
        chains += [ids[k : k + chain] for k in range(0, len(ids), chain)]
        owner += [i] * -(-len(ids) // chain)
    of = np.array(owner)
    groups = [(np.array(g), x.astype(np.int64), ln) for g, x, ln in padded(chains, 1 << 18)]
    theta = np.zeros(len(vocab))
    model = Model({}, bias=-4.0)
    bias, trans = model.bias, model.trans.copy()
    target = None
    for turn in range(rounds):
        # Tokens of toxic documents: at first by lift, then by the field; at least one in each document.
        labels, top, best = [], np.full(len(docs), -np.inf), {}
        emission = bias + np.bincount(row, theta[col], len(words)) if len(col) else np.full(len(words), bias)
        for n, (g, x, ln) in enumerate(groups):
            inside = np.arange(len(x))[:, None] < ln
            belief = seed[x] - 2.0 if target is None else odds(emission[x], ln, trans)
            belief = np.where(inside, belief, -99.0)
            labels.append(((belief > 0) & inside & (y[of[g]] == 1), inside))
            at = belief.argmax(0)
            for k, (d, t, v) in enumerate(zip(of[g].tolist(), at.tolist(), belief[at, np.arange(len(g))].tolist(), strict=True)):
                if v > top[d]:
                    top[d], best[d] = v, (n, t, k)
        for d, (n, t, k) in best.items():
            labels[n][0][t, k] |= y[d] == 1
        target = labels
        acc = np.full(len(vocab), 1e-3)
        acc_b, acc_t = 1e-3, np.full((2, 2), 1e-3)
        total = sum(int(ln.sum()) for _, _, ln in groups)
        for _ in range(epochs if turn == 0 else epochs // 2):
            emission = bias + (np.bincount(row, theta[col], len(words)) if len(col) else 0.0) * np.ones(len(words))
            grad_w = np.zeros(len(words))
            gb, gt = 0.0, np.zeros((2, 2))
            for (_, x, ln), (lab, inside) in zip(groups, target, strict=True):
                p, pairs = expected(emission[x], ln, trans)
                d = np.where(inside, p - lab, 0.0)
                grad_w += np.bincount(x.ravel(), d.ravel(), len(words))
                gb += d.sum()
                code = 2 * lab[:-1].astype(np.int8) + lab[1:]
                gt += pairs - np.bincount(code[inside[1:]], minlength=4).reshape(2, 2)
            g = (np.bincount(col, grad_w[row], len(vocab)) if len(col) else np.zeros(len(vocab))) + 0.3 * theta
            acc += g * g
            theta -= 0.5 * g / np.sqrt(acc)
            acc_b += gb * gb
            bias -= 0.2 * gb / np.sqrt(acc_b)
            gt += 1e-3 * total * 0.01 * trans
            acc_t += gt * gt
            trans -= 0.1 * gt / np.sqrt(acc_t)
            trans -= trans[0, 0]
    model.bias, model.trans = float(bias), trans
    model.weights = {f: float(theta[i]) for f, i in vocab.items() if abs(theta[i]) > 1e-4}
    emission = bias + np.bincount(row, theta[col], len(words)) if len(col) else np.full(len(words), bias)
    summaries: list = [None] * len(sample.texts)
    for g, x, ln in padded([d for d, _ in docs + rest] if len(rest) > 20 else [d for d, _ in docs], 1 << 18):
        p = 1 / (1 + np.exp(-odds(emission[x], ln, trans)))
        for k, i in enumerate(g):
            summaries[i] = summary(p[: ln[k], k])
    labels = [k for _, k in docs]
    x = summaries[: len(docs)]
    if len(rest) > 20:
        x, labels = x + summaries[len(docs) :] * 3, labels + [k for _, k in rest] * 3
    model.calibration = logistic(np.array(x), np.array(labels, float), ridge=0.5)
    model.cache.clear()
    return model


def spans_of(text: str, p: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Character offsets of runs of tokens whose marginal reaches the threshold."""
    import regex

    hot = np.flatnonzero(p >= threshold).tolist()
    if not hot:
        return []
    at = [(m.start(), m.end()) for m in regex.finditer(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text)]
    if len(at) != len(p):  # lower() changed the number of words: report the text as a whole
        return [(0, len(text))]
    out: list[list[int]] = []
    last = -2
    for i in hot:
        if i == last + 1:
            out[-1][1] = at[i][1]
        else:
            out.append([at[i][0], at[i][1]])
        last = i
    return [(a, b) for a, b in out]


def score(docs: DataFrame, model: Model, threshold: float = 0.7, span_threshold: float = 0.5, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, spans of every row. Empty and null texts have no tokens and get a low score."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # weights of the bounded sample's features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        ids: list = []
        texts: list[str] = []
        words: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            out: list[np.ndarray] = [np.zeros(0)] * len(words)
            for group, x, length in padded(words):
                p = 1 / (1 + np.exp(-odds(x, length, m.trans)))
                for k, i in enumerate(group):
                    out[i] = p[: length[k], k].copy()
            s = m.score(out)
            spans = [[{"start": a, "end": b} for a, b in spans_of(t, q, span_threshold)] for t, q in zip(texts, out, strict=True)] if with_spans else [[] for _ in ids]
            return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "score": s, "predicted": (s >= threshold).astype("int32"), "spans": spans})

        for pdf in batches:  # chains of like length run together, so many documents are gathered first
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids.append(None if d != d else d)
                texts.append(t if with_spans else "")
                words.append(m.emissions(tokens(t)))
                held += len(words[-1])
                if held > 1_500_000:
                    yield flush()
                    ids, texts, words, held = [], [], [], 0
        if ids:
            yield flush()

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int>>")


def clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below the threshold; no shuffle."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # weights of the bounded sample's features

    def run(batches):
        import pyarrow as pa

        m: Model = shared.value
        held, waiting = 0, []

        def flush():
            words = [w for _, ws in waiting for w in ws]
            out: list[np.ndarray] = [np.zeros(0)] * len(words)
            for group, x, length in padded(words):
                p = 1 / (1 + np.exp(-odds(x, length, m.trans)))
                for k, i in enumerate(group):
                    out[i] = p[: length[k], k].copy()
            fine, at = m.score(out) < threshold, 0
            for batch, ws in waiting:
                yield batch.filter(pa.array(fine[at : at + len(ws)]))
                at += len(ws)

        for batch in batches:
            ws = [m.emissions(tokens(t or "")) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            waiting.append((batch, ws))
            held += sum(map(len, ws))
            if held > 1_500_000:
                yield from flush()
                held, waiting = 0, []
        if waiting:
            yield from flush()

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = 1500, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit to at most ``rows`` labelled texts of each class outside the held-out fold, and at most ``sample_bytes`` of whole texts."""
    return fit(labelled(docs, labels, label, remainder("_id", folds) != held_out, rows, id_col, text_col, sample_bytes))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, threshold: float = 0.7, rows: int = 1500, sample_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start and end in characters of runs of toxic tokens).

    Null labels and labels other than 0 and 1 are ignored; with labels of one class only
    every score follows that class. Repeated rows and rows with null ids are scored each;
    empty and null texts have no tokens.
    """
    model = learn(docs, labels, label, folds, held_out, rows, sample_bytes, id_col, text_col)
    return score(docs, model, threshold, with_spans=with_spans, id_col=id_col, text_col=text_col).select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", "predicted", "spans")
