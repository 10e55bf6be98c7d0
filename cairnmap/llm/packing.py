"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

A piece has one of ``capacity`` lengths, so the whole corpus is a histogram. Best-fit
decreasing runs over that histogram: a segment tree over remaining capacities finds the
tightest open bins in logarithmic time, and bins of like history are kept as ranges of
ids. The plan says which pieces of a length, by rank, go to which bins at which offset;
tasks look it up. What the driver holds is bounded by the capacity, not by the corpus.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, id_text, tune

# Fixed value: how byte-level BPE splits a text before merging (the published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space on which the fast implementation's backtracking matcher would run out of stack.
_LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{_LONG_RUN}}}")


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as the vocabulary file's own tokenizer gives them.

    Where the file is a byte-level BPE whose ids are the ranks of its merges, a faster
    implementation of the same merges is used; texts with the string of a special token
    or with a run of 100,000 white-space characters, and any other kind of file, go
    through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast, self.special = None, []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout"):
            byte = _byte_of()
            vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
            merges = ["".join(m.split(" ", 1) if isinstance(m, str) else m) for m in model["merges"]]
            if sorted(vocab.values()) == list(range(len(vocab))) and all(vocab[m] == 256 + i for i, m in enumerate(merges)):
                import tiktoken

                ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
                self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= _LONG_RUN and _RUN.search(text)):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, whatever the number of its tasks."""
    return Encoder(path)


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over (length: pieces). Returns (segments, number of bins).

    A segment is length, first rank, pieces, first bin, pieces in each bin, offset: the
    pieces of that length with these ranks go to consecutive bins, so many to each, from
    that offset on. Placing pieces one at a time into the tightest bin fills a bin with
    as many of one length as fit before the next bin is touched, so whole ranges move.
    """
    size = 1
    while size < capacity + 1:
        size *= 2
    tree = [0] * (2 * size)  # open bins by remaining capacity, summed upwards
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(r: int, n: int) -> None:
        i = r + size
        while i:
            tree[i] += n
            i //= 2

    def tightest(least: int) -> int:
        """The smallest remaining capacity of an open bin that is at least ``least``, or -1."""
        i = least + size
        if tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - size
            i //= 2
        return -1

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            bins[r].append((first, n))
            add(r, n)

    segments, n_bins = [], 0
    for length in sorted((k for k, c in histogram.items() if c > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = tightest(length)
            if r < 0:
                r, k = capacity, capacity // length
                first, n = n_bins, -(-left // k)
                n_bins += n
            else:
                first, n = bins[r].pop()
                add(r, -n)
                k = r // length
            full = min(n, left // k)
            if full:
                segments.append((length, rank, full * k, first, k, capacity - r))
                put(r - k * length, first, full)
                rank, left = rank + full * k, left - full * k
            used = full
            if left and used < n:
                segments.append((length, rank, left, first + used, left, capacity - r))
                put(r - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            put(r, first + used, n - used)
    return np.array(segments, np.int64).reshape(-1, 6), n_bins


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the task and the rank of the piece among the task's of that length."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = encode(text)
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                n = len(ids)
                cut = n % capacity or min(n, capacity)
                at, number = 0, 0
                while at < n:
                    part = ids[at:cut]
                    size = cut - at
                    rows.append((None if d != d else d, number, at, size, zlib.crc32(part.tobytes()), task, int(ranks[size]), part.astype("int32") if with_ids else None))
                    ranks[size] += 1
                    at, cut, number = cut, cut + capacity, number + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out if with_ids else out.drop(columns="ids")

    return id_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Documents of more than ``capacity`` tokens are cut into pieces of that many, the first
    of which may be shorter. Repeated rows are packed each; rows with null ids too.
    """
    got = checkpoint(pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col))  # ranks are fixed from here on
    by_task = got.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    segments, _ = plan(histogram, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(segments)  # each length opens at most three ranges, each range takes at most some 45 lengths

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = shared.value
        key = seg[:, 0] * (1 << 45) + seg[:, 1]
        order = np.argsort(key)
        seg, key = seg[order], key[order]
        for pdf in batches:
            rank = (pdf["rank"] + pdf["before"]).to_numpy(np.int64)
            length = pdf["length"].to_numpy(np.int64)
            s = seg[np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1]
            inside = rank - s[:, 1]
            out = pdf.drop(columns=["rank", "before", "task"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"] = s[:, 3] + inside // s[:, 4]
            out["offset"] = s[:, 5] + inside % s[:, 4] * length
            yield out

    joined = got.join(offsets, ["length", "task"]).select(*got.columns, "before")
    names = [c for c in got.columns if c not in ("task", "rank")]
    kinds = dict(got.dtypes)
    return joined.mapInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")
