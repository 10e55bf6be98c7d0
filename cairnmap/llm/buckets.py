"""Strings that travel to hash buckets in packed, compressed blocks.

A map task collects strings with (document, start), drops those it holds more than once
(the first in corpus order stays, the rest is settled in the task) and sends one
compressed block for each bucket. A reduce task reads the blocks of one bucket at a time.
A string that a third of all rows hold therefore reaches its bucket once for each task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, trim

BLOCK = "bucket int, payload binary"
RANGES = "doc_id long, s array<int>, e array<int>"
#: Raw bytes that a map task holds before it sends its blocks.
FLUSH = 80 << 20


class Outbox:
    """Strings of a map task by bucket. ``ties``: keep repeats within the first document too."""

    def __init__(self, n_buckets: int, ties: bool, covered: Callable[[int, int], tuple[int, int]]):
        self.n, self.ties, self.covered = n_buckets, ties, covered
        self.clear()

    def clear(self) -> None:
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.again: list[tuple[bytes, int, int, int]] = []
        self.settled: list[tuple[int, int, int]] = []
        self.raw = 0

    def add(self, s: bytes, doc: int, start: int, size: int, bucket: int) -> None:
        """size: words or bytes of s; doc and start: where it was found."""
        old = self.first.get(s)
        if old is None:
            self.first[s] = (doc, start, bucket)
            self.raw += len(s) + 100
            return
        if self.ties and old[0] == doc:
            self.again.append((s, doc, start, size))
            self.raw += 150
            return
        if (doc, start) == old[:2]:  # a repeated row: the same place
            return
        self.raw += 24
        if (doc, start) < old[:2]:
            self.first[s] = (doc, start, bucket)
            doc, start = old[:2]
        self.settled.append((doc, *self.covered(start, size)))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        by: dict[int, list[tuple[bytes, int, int]]] = {}
        for s, (doc, start, bucket) in self.first.items():
            by.setdefault(bucket, []).append((s, doc, start))
        for s, doc, start, size in self.again:
            d, st, bucket = self.first[s]
            if d == doc:
                by[bucket].append((s, doc, start))
            else:  # a smaller document came later in the task
                self.settled.append((doc, *self.covered(start, size)))
        settled = np.array(self.settled, np.int64).reshape(-1, 3)
        if len(settled):
            settled = settled[np.lexsort((settled[:, 1], settled[:, 0]))]
            gap = np.ones(len(settled), bool)
            gap[1:] = (settled[1:, 0] != settled[:-1, 0]) | (settled[1:, 1] > settled[:-1, 2])
            at = np.flatnonzero(gap)
            settled = np.column_stack((settled[at, 0], settled[at, 1], np.maximum.reduceat(settled[:, 2], at)))
        share = {b: settled[i :: max(1, len(by))] for i, b in enumerate(by)}
        packer = zstandard.ZstdCompressor(level=5)
        for bucket, rows in by.items():
            rest = share[bucket]
            blob = b"".join(r[0] for r in rows)
            head = struct.pack("<QQQ", len(rows), len(rest), len(blob))
            cols = _narrow([r[1] for r in rows], "<i8") + _narrow([r[2] for r in rows], "<i4") + _narrow([len(r[0]) for r in rows], "<i4")
            yield bucket, packer.compress(head + cols + rest.astype("<i8").tobytes() + blob)
        self.clear()


def _narrow(values: list[int], kind: str) -> bytes:
    """Differences, their bytes gathered by place: rows come in order of the texts, so most bytes are zero."""
    d = np.diff(np.array(values, kind), prepend=np.zeros(1, kind)).astype(kind)
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), -1).T).tobytes()


def _widen(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m, size = struct.unpack_from("<QQQ", raw)
    at = 24
    doc, start, length = _widen(raw, "<i8", n, at), _widen(raw, "<i4", n, at + 8 * n), _widen(raw, "<i4", n, at + 12 * n)
    settled = np.frombuffer(raw, "<i8", 3 * m, at + 16 * n).reshape(-1, 3)
    return doc, start, length, settled, raw[len(raw) - size :]


def entries(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a bucket's blocks, in corpus order (document, start): doc, start, settled ranges, strings."""
    docs, starts, settled, views = [], [], [], []
    for p in payloads:
        d, s, ln, rest, blob = _read(p)
        docs.append(d)
        starts.append(s)
        settled.append(rest)
        ends = np.cumsum(ln)
        views += [blob[e - n : e] for e, n in zip(ends.tolist(), ln.tolist(), strict=True)]
    doc, start = np.concatenate(docs), np.concatenate(starts)
    order = np.lexsort((start, doc))
    return doc[order], start[order], np.concatenate(settled), [views[i] for i in order.tolist()]


def in_corpus_order(payloads: list[bytes], sep: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """entries() with the strings in one buffer: doc, start, offset in the buffer, settled ranges, buffer."""
    doc, start, settled, strings = entries(payloads)
    length = np.array([len(x) + len(sep) for x in strings], np.int64)
    return doc, start, np.concatenate(([0], np.cumsum(length)[:-1])), settled, np.frombuffer(sep.join(strings), np.uint8)


def first_of_equals(h: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], key: Callable[[int], bytes]) -> np.ndarray:
    """For each position the first position with an equal string: sorting by hash, then exact comparison.

    same(a, b) compares the strings at a and b exactly; only where equal hashes hide
    different strings are the few concerned regrouped by the strings themselves.
    """
    n = len(h)
    first = np.arange(n)
    order = np.argsort(h, kind="stable")
    sh = h[order]
    eq = sh[1:] == sh[:-1]
    if not eq.any():
        return first
    head = np.concatenate(([True], ~eq))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.flatnonzero(~head)
    member, rep = order[at], order[group[at]]
    back = np.argsort(member, kind="stable")
    member, rep, at = member[back], rep[back], at[back]
    ok = same(member, rep)
    first[member[ok]] = rep[ok]
    if not ok.all():
        for g in np.unique(group[at[~ok]]).tolist():
            seen: dict[bytes, int] = {}
            end = g + 1
            while end < n and sh[end] == sh[g]:
                end += 1
            for i in sorted(order[g:end].tolist()):
                first[i] = seen.setdefault(key(i), i)
    return first


def as_rows(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    """Ranges gathered by document, neighbours merged."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    if not len(doc):
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "s": pd.Series(dtype=object), "e": pd.Series(dtype=object)})
    gap = np.ones(len(doc), bool)
    gap[1:] = (doc[1:] != doc[:-1]) | (s[1:] > e[:-1])
    at = np.flatnonzero(gap)
    e = np.maximum.reduceat(e, at)
    doc, s = doc[at], s[at]
    cut = np.flatnonzero(np.diff(doc)) + 1
    return pd.DataFrame({"doc_id": doc[np.concatenate(([0], cut))], "s": np.split(s.astype(np.int32), cut) if len(cut) else [s.astype(np.int32)], "e": np.split(e.astype(np.int32), cut) if len(cut) else [e.astype(np.int32)]})


def removed(docs: DataFrame, send: Callable, settle: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id and its ranges s, e. send: mapInPandas function to blocks; settle: a bucket's blocks to ranges."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, payloads = None, []
        for pdf in batches:
            for b, p in zip(pdf["bucket"].tolist(), pdf["payload"].tolist(), strict=True):
                if b != bucket and payloads:
                    yield as_rows(*settle(payloads))
                    payloads = []
                bucket = b
                payloads.append(p)
        if payloads:
            yield as_rows(*settle(payloads))
        trim()

    n = partitions(docs.sparkSession)
    blocks = docs.where("doc_id is not null").mapInPandas(send, BLOCK)
    ranges = blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(reduce, RANGES)
    return ranges.groupBy(F.col("doc_id").alias("_id")).agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    return docs.join(ranges, F.col("doc_id") == F.col("_id"), "left").drop("_id")
