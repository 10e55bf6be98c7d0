"""Substring dedup by super-k-mers: windows of words that share a minimiser travel packed.

Every window of ``window`` words has a minimiser, the smallest hash among its runs of
``m`` words. Consecutive windows with the same minimiser make one string, which goes to
the minimiser's bucket; equal windows have equal minimisers and so meet there. Sorting a
bucket's windows by hash, with an exact comparison of equal hashes, finds for each
window the first document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import buckets
from .common import id_text, mix, partitions, runs, sliding_min, trim, tune, window_hash, word_bounds


def _sender(window: int, m: int, n_buckets: int, chunk: int = 4 << 20):
    def covered(start: int, size: int) -> tuple[int, int]:
        return start, start + size

    def super_kmers(texts: list[bytes], ids: list[int], box: buckets.Outbox) -> None:
        """Text by text normalised to single spaces; a newline between texts."""
        raw = b"\n".join(texts)
        buf = np.frombuffer(raw, np.uint8)
        starts, ends, h = word_bounds(buf)
        if len(h) < window:
            return
        size = np.array([len(t) + 1 for t in texts])
        doc = np.searchsorted(np.cumsum(size), starts, side="right")
        base = np.searchsorted(doc, np.arange(len(texts)))
        low = sliding_min(mix(window_hash(h, m)), window - m + 1)
        whole = doc[: len(low)] == doc[window - 1 :]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        head = np.flatnonzero(new)
        first, last = at[head], at[np.append(head[1:], len(at)) - 1] + window - 1
        where = (low[first] % np.uint64(n_buckets)).astype(np.int64)
        d = doc[first]
        for a, b, k, st, sz, bucket in zip(starts[first].tolist(), ends[last].tolist(), d.tolist(), (first - base[d]).tolist(), (last - first + 1).tolist(), where.tolist(), strict=True):
            box.add(raw[a:b], ids[k], st, sz, bucket)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box = buckets.Outbox(n_buckets, True, covered)
        texts: list[bytes] = []
        ids: list[int] = []
        held = 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                t = b" ".join(t.encode("utf-8", "surrogatepass").split())
                texts.append(t)
                ids.append(d)
                held += len(t)
                if held > chunk:
                    super_kmers(texts, ids, box)
                    texts, ids, held = [], [], 0
                    if box.raw > buckets.FLUSH:
                        yield pd.DataFrame(list(box.blocks()), columns=["bucket", "payload"])
        super_kmers(texts, ids, box)
        yield pd.DataFrame(list(box.blocks()), columns=["bucket", "payload"])
        trim()

    return send


def _settler(window: int):
    def settle(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, start, offset, settled, buf = buckets.in_corpus_order(payloads, b"\n")
        raw = buf.tobytes()
        begins, ends, h = word_bounds(buf)
        entry = np.searchsorted(offset, begins, side="right") - 1
        wh = window_hash(h, window)
        at = np.flatnonzero(entry[: len(wh)] == entry[window - 1 :])
        b, e = begins[at], ends[at + window - 1]

        def same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.fromiter((raw[p:q] == raw[s:t] for p, q, s, t in zip(b[x].tolist(), e[x].tolist(), b[y].tolist(), e[y].tolist(), strict=True)), bool, len(x))

        first = buckets.first_of_equals(wh[at], same, lambda i: raw[b[i] : e[i]])
        of = entry[at]
        dup = doc[of[first]] < doc[of]
        lo, hi = runs(dup, of)
        word = at - np.searchsorted(entry, of)  # of the window's first word within its entry
        s = start[of[lo]] + word[lo]
        t = start[of[hi]] + word[hi] + window
        return np.concatenate((doc[of[lo]], settled[:, 0])), np.concatenate((s, settled[:, 1])), np.concatenate((t, settled[:, 2]))

    return settle


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, text, s, e in zip(pdf["doc_id"], pdf["text"], pdf["s"], pdf["e"], strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            n, kept = len(words), words
            if s is not None and len(s):
                delta = np.zeros(n + 1, np.int64)
                np.add.at(delta, np.minimum(s, n), 1)
                np.add.at(delta, np.minimum(e, n), -1)
                gone = np.cumsum(delta[:n]) > 0
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
            rows.append((d, n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, m: int = 8, spread: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, one space between), kept_sha256.

    A word goes if a window over it also starts in a document with a smaller id; all is
    judged on the input. Words are runs of anything but space and \\t to \\r. Null and
    empty texts have no words; texts shorter than a window lose nothing; repeats within
    one document stay. ``spread`` buckets for each shuffle partition bound what a task
    holds at once. Rows of one id count as one document; a null id is not judged.
    """
    spark = docs.sparkSession
    tune(spark)
    base = id_text(docs, id_col, text_col)
    ranges = buckets.removed(base, _sender(window, m, spread * partitions(spark)), _settler(window))
    return buckets.with_ranges(base, ranges).mapInPandas(_apply, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
f as (select h, min(doc_id) as m from win group by h),
gone as (select doc_id, p from win join f using (h) where m < doc_id),
g as (select distinct doc_id, unnest(range(p, p + 50)) as q from gone),
x as (select doc_id, q, w[q] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as q from d)),
k as (select x.doc_id, count(*) as n, string_agg(word, ' ' order by x.q) as kept from x anti join g on x.doc_id = g.doc_id and x.q = g.q group by x.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)"""
