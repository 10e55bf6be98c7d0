"""Exact substring dedup over bytes by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: a gram of ``gram`` bytes is a trigger
when its hash is the smallest in some ``length``-byte string, the leftmost on ties. So
each such string holds its trigger at a place that its content alone decides. Cut at the
triggers, a string is the end of a phrase before its trigger and the beginning of what
the parse goes on with. Each trigger goes to a bucket with both: the phrase before it and
the right context that strings starting in the phrase need.

A bucket sorts the phrases, read from the trigger to the left, and the continuations,
read to the right: these are the suffix arrays of dictionary and parse, with the lengths
that neighbours have in common. At each distance of the trigger from a string's start,
equal neighbours on both sides make the classes of equal strings, in corpus order; all
but the first of a class are repeats. Nothing is hashed to decide that. Phrases that a
task meets again with the same context are settled by the parse alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import buckets
from .common import BYTE_VALUES, id_text, mix, partitions, runs, sliding_min, trim, tune, window_hash

#: Bits of a trigger's rank that hold its place in the buffer; the others are its hash.
PLACE = 31


def _sender(length: int, gram: int, n_buckets: int, chunk: int = 2 << 20):
    def covered(start: int, size: int) -> tuple[int, int]:
        return start, start + size

    def phrases(texts: list[bytes], ids: list[int], box: buckets.Outbox) -> None:
        raw = b"".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        if len(buf) < length:
            return
        size = np.array([len(t) for t in texts], np.int64)
        stop = np.cumsum(size)
        base = stop - size
        place = np.uint64((1 << PLACE) - 1)
        rank = mix(window_hash(BYTE_VALUES[buf], gram)) & ~place
        rank |= np.arange(len(rank), dtype=np.uint64) & place
        low = sliding_min(rank, length - gram + 1)
        n_starts = np.maximum(size - length + 1, 0)
        has = np.flatnonzero(n_starts)
        if not len(has):
            return
        whole = np.zeros(len(low) + 1, np.int8)
        whole[base[has]] += 1
        whole[base[has] + n_starts[has]] -= 1
        at = np.flatnonzero(np.cumsum(whole[:-1]))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]])
        head = np.flatnonzero(new)
        first = at[head]
        last = at[np.append(head[1:], len(at)) - 1]
        doc = np.searchsorted(stop, first, side="right")
        where = ((low[first] >> np.uint64(PLACE)) % np.uint64(n_buckets)).astype(np.int64)
        # The distance from the first start to the trigger goes in front, in two bytes.
        to = ((low[first] - first.astype(np.uint64)) & place).tolist()
        marks = [m.to_bytes(2, "big") for m in range(length)]
        for a, b, k, st, bucket, t in zip(first.tolist(), (last + length).tolist(), doc.tolist(), (first - base[doc]).tolist(), where.tolist(), to, strict=True):
            box.add(marks[t] + raw[a:b], ids[k], st, b - a, bucket)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = buckets.Outbox(n_buckets, False, covered)
        texts: list[bytes] = []
        ids: list[int] = []
        held = 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                t = t.encode("utf-8", "surrogatepass")
                texts.append(t)
                ids.append(d)
                held += len(t)
                if held > chunk:
                    phrases(texts, ids, box)
                    texts, ids, held = [], [], 0
                    if box.raw > buckets.FLUSH:
                        yield pd.DataFrame(list(box.blocks()), columns=["bucket", "payload"])
        phrases(texts, ids, box)
        yield pd.DataFrame(list(box.blocks()), columns=["bucket", "payload"])
        trim()

    return send


def _sorted(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and, for each in that order, how many bytes it shares with the one before."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    table = np.frombuffer(b"".join([strings[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(-1, width)
    size = np.array([len(strings[i]) for i in order])
    common = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 15):
        hi = min(len(order), lo + (1 << 15))
        unlike = table[lo:hi] != table[lo - 1 : hi - 1]
        common[lo:hi] = np.where(unlike.any(1), unlike.argmax(1), width)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    return np.array(order, np.int64), common


def _settler(length: int, gram: int):
    def settle(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, start, settled, strings = buckets.entries(payloads)
        far = np.array([int.from_bytes(s[:2], "big") for s in strings], np.int64)  # of the trigger from the first start
        n_starts = np.array([len(s) for s in strings]) - 2 - length + 1
        onward = [s[2 + t :] for s, t in zip(strings, far.tolist(), strict=True)]
        order, common = _sorted(onward, length)
        # A trigger that no other entry has begins no repeat.
        twin = common >= gram
        twin[:-1] |= twin[1:]
        live = np.sort(order[twin])
        if len(live):
            number = np.full(len(strings), -1, np.int64)
            number[live] = np.arange(len(live))
            keep = twin.nonzero()[0]
            # Dropped entries lie between groups of one trigger, so what is left has the same common lengths up to the gram.
            right, right_common = number[order[keep]], np.where(np.diff(keep, prepend=-2) == 1, common[keep], 0)
            left, left_common = _sorted([strings[i][2 : 2 + t][::-1] for i, t in zip(live.tolist(), far[live].tolist(), strict=True)], length)
            top, least = far[live], far[live] - n_starts[live] + 1
            repeat = np.zeros((len(live), length - gram + 1), bool)  # by the number of the start within the entry
            a_class, b_class = np.empty(len(live), np.int64), np.empty(len(live), np.int64)
            # Triggers at one place of one document come from repeated rows and are one.
            at_doc, trigger = doc[live], start[live] + far[live]
            rank = np.lexsort((trigger, at_doc))
            new = np.ones(len(live), np.int64)
            new[1:] = (np.diff(at_doc[rank]) != 0) | (np.diff(trigger[rank]) != 0)
            spot = np.empty(len(live), np.int64)
            spot[rank] = np.cumsum(new)
            for a in range(length - gram + 1):
                on = np.flatnonzero((least <= a) & (a <= top))
                if len(on) < 2:
                    continue
                a_class[left] = np.cumsum(left_common < a)
                b_class[right] = np.cumsum(right_common < length - a)
                both = a_class[on] * (len(live) + 1) + b_class[on]
                by = np.lexsort((spot[on], both))  # in corpus order: the first of a class is the earliest
                head = np.concatenate(([True], both[by[1:]] != both[by[:-1]]))
                first = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
                again = np.empty(len(on), bool)
                again[by] = spot[on[by]] != spot[on[first]]
                at = on[again]
                repeat[at, top[at] - a] = True
            entry = np.repeat(live, repeat.shape[1])
            within = np.tile(np.arange(repeat.shape[1]), len(live))
            lo, hi = runs(repeat.ravel(), entry)
        else:
            entry = within = lo = hi = np.empty(0, np.int64)
        s = start[entry[lo]] + within[lo]
        e = start[entry[hi]] + within[hi] + length
        return np.concatenate((doc[entry[lo]], settled[:, 0])), np.concatenate((s, settled[:, 1])), np.concatenate((e, settled[:, 2]))

    return settle


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, text, s, e in zip(pdf["doc_id"], pdf["text"], pdf["s"], pdf["e"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            n, kept, spans = len(raw), raw, []
            if s is not None and len(s):
                s, e = np.minimum(s, n), np.minimum(e, n)
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                first, last = s[new], e[np.append(new[1:], len(s)) - 1]
                spans = [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b > a]
                parts, at = [], 0
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
            rows.append((d, n, n - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 20, spread: int = 6) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start and end of each removed run of bytes), kept_sha256.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of
    smaller id, or earlier in the same one. All is judged on the input; strings never
    cross documents. Null and empty texts have no bytes; shorter texts lose nothing. Rows
    of one id count as one document, whose equal rows do not remove each other; a null id
    is not judged.
    """
    spark = docs.sparkSession
    tune(spark)
    base = id_text(docs, id_col, text_col)
    ranges = buckets.removed(base, _sender(length, gram, spread * partitions(spark)), _settler(length, gram))
    return buckets.with_ranges(base, ranges).mapInPandas(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept_sha256 string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
