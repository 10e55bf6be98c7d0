"""Benchmark decontamination with a generalised suffix automaton over item words.

Each block of items becomes one automaton over words. Documents stream through them, word
by word; the automaton's state and the longest matching length say which of the last
words occur in an item. Spans of at least ``window`` matching words are contaminated.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpoint, fresh, id_text, merged, tune

#: Words are runs of digits, a-z and anything beyond ASCII; in UTF-8 bytes, so that lower() is of ASCII only.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[str, int, list[bytes]]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            ends.append((item, len(words), words))
        # long_items: items that hold the window-long suffix of a state; short: whole short items that end there.
        self.long_items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, n, words in ends:
            state = 0
            for w in words:
                state = self.next[state][w]
                s = state
                while self.link[s] >= 0 and self.length[self.link[s]] >= window:
                    s = self.link[s]
                if self.length[s] >= window:
                    self.long_items.setdefault(s, set()).add(item)
            if 0 < n < window:
                s = state  # a prefix of an item: the longest string of its state may be longer, the item itself belongs to it
                while self.length[self.link[s]] >= n:
                    s = self.link[s]
                self.short.setdefault(s, []).append((n, item))
        n_states = len(self.next)
        #: For each state: the ancestor that holds the window-long suffix, and the states with short items above it.
        self.anchor = [0] * n_states
        self.shorts: list[tuple] = [()] * n_states
        for s in sorted(range(1, n_states), key=self.length.__getitem__):
            up = self.link[s]
            self.anchor[s] = (self.anchor[up] or s) if self.length[up] >= window else (s if self.length[s] >= window else 0)
            own = tuple(self.short.get(s, ()))
            self.shorts[s] = self.shorts[up] + own

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # the string is known from an earlier item
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of words inside occurrences of windows, and the items of these windows."""
        nxt, link, length, window, anchor, shorts = self.next, self.link, self.length, self.window, self.anchor, self.shorts
        state = matched = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        anchors: set[int] = set()
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                while state:
                    state = link[state]
                    to = nxt[state].get(w)
                    if to is not None:
                        matched = length[state] + 1
                        break
                else:
                    matched = 0
                    continue
            else:
                matched += 1
            state = to
            if matched >= window:
                anchors.add(anchor[state])
                spans.append((i + 1 - matched, i + 1))
            if shorts[state]:
                for n, item in shorts[state]:
                    if n <= matched:
                        spans.append((i + 1 - n, i + 1))
                        found.add(item)
        for s in anchors:
            found |= self.long_items.get(s, set())
        return merged(spans), found


def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.lower())]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


Found = tuple[int, list[tuple[int, int]], list[str]]

#: The automaton that this worker process used last, by its block.
_last: dict[bytes, Automaton] = {}


def automaton_of(block: bytes, window: int) -> Automaton:
    """Built from a packed block; with one block a worker builds it once, with more it holds one at a time."""
    key = hashlib.blake2b(block + bytes([window % 256]), digest_size=16).digest()
    if key not in _last:
        _last.clear()
        _last[key] = Automaton(pickle.loads(zlib.decompress(block)), window)
    return _last[key]


def find(texts: list[str], blocks: list[bytes], window: int, known: list[Found] | None = None) -> list[Found]:
    """Number of words, merged spans and sorted items of each text over all blocks, and what was known before."""
    words = [words_of(t) for t in texts]
    found = known or [(len(w), [], []) for w in words]
    for block in blocks:
        sa = automaton_of(block, window)
        for i, w in enumerate(words):
            spans, items = sa.hits(w)
            if spans:
                n, old, names = found[i]
                found[i] = n, merged(old + spans) if old else spans, sorted({*names, *items})
    return found


def packed_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[bytes]:
    """Items in packed blocks of at most block_words words (or one item); the driver holds one block's words at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield zlib.compress(pickle.dumps(block), 1)
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield zlib.compress(pickle.dumps(block), 1)


def _passes(blocks: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    """Blocks in groups of at most ``most`` packed bytes, the bound on what one pass broadcasts; one group at least."""
    group: list[bytes] = []
    size = n = 0
    for b in blocks:
        if group and size + len(b) > most:
            yield group
            group, size, n = [], 0, n + 1
        group.append(b)
        size += len(b)
    if group or not n:
        yield group


#: Rows of this many bytes of text are held while the blocks take their turns.
HOLD = 32 << 20


def _step(shared, schema, text_col: str, window: int, before: str | None, after: str, finish: Callable | None):
    """mapInArrow function: the batches with what was found in column ``after`` (or changed by ``finish``), row by row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)
    kind = pa.struct([("n", pa.int64()), ("s", pa.list_(pa.int32())), ("e", pa.list_(pa.int32())), ("i", pa.list_(pa.string()))])

    def run(batches):
        blocks: list[bytes] = shared.value

        def flush(waiting):
            texts, known = [], []
            for b in waiting:
                texts += [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                if before:
                    known += [(x["n"], list(zip(x["s"], x["e"], strict=True)), x["i"]) for x in b.column(b.schema.get_field_index(before)).to_pylist()]
            found, at = find(texts, blocks, window, known or None), 0
            for b in waiting:
                part, some = found[at : at + b.num_rows], texts[at : at + b.num_rows]
                at += b.num_rows
                if finish:
                    if before:
                        b = b.drop_columns([before])
                    b = finish(b, some, part)
                else:
                    cell = pa.array([{"n": n, "s": [x for x, _ in spans], "e": [x for _, x in spans], "i": names} for n, spans, names in part], kind)
                    b = b.append_column(after, cell) if not before else b.set_column(b.schema.get_field_index(before), after, cell)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, out_schema, strict=True)], schema=out_schema)

        waiting, held = [], 0
        for b in batches:
            if len(blocks) < 2:
                yield from flush([b])
                continue
            waiting.append(b)
            held += b.nbytes
            if held > HOLD:
                yield from flush(waiting)
                waiting, held = [], 0
        if waiting:
            yield from flush(waiting)

    return run


_CELL = "n bigint, s array<int>, e array<int>, i array<string>"


def _over_blocks(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_words: int, broadcast_bytes: int, schema: StructType, finish: Callable) -> DataFrame:
    """Rows of docs that finish() makes of each batch with its texts and what all blocks found in them.

    One pass over docs for each ``broadcast_bytes`` of packed items; what a pass found goes
    on with its row through a checkpoint. Rows are never joined, so ids play no part.
    """
    spark, cell = docs.sparkSession, fresh(docs, "found")[0]
    tune(spark)
    now, before = docs, None
    groups = _passes(packed_blocks(items, item_col, item_text_col, block_words), broadcast_bytes)
    group = next(groups)
    while True:
        following = next(groups, None)
        shared = spark.sparkContext.broadcast(group)  # at most broadcast_bytes
        if following is None:
            return now.mapInArrow(_step(shared, schema, text_col, window, before, cell, finish), schema)
        wide = StructType([*docs.schema.fields, StructField(cell, StructType.fromDDL(_CELL))]) if before is None else now.schema
        now = checkpoint(now.mapInArrow(_step(shared, wide, text_col, window, before, cell, None), wide))
        before, group = cell, following
        shared.unpersist()


_OUT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, clean string"


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, with_text: bool = True, block_words: int = 100_000, broadcast_bytes: int = 256 << 20
) -> DataFrame:
    """doc_id, n_words, spans of contaminated words, items with occurring windows, clean text: one row for each row of docs.

    Items go into blocks of ``block_words`` words, each an automaton; a task holds one
    automaton at a time and some rows, over which the blocks take turns, so documents are
    read once and without a shuffle for each ``broadcast_bytes`` of packed items. An item
    of fewer than ``window`` words is one window; items without words have none; a null
    item id is written as an empty string. A null or empty text has no words. Every row is
    judged by itself, with repeated and null ids too, and alike whatever the block size.
    """
    import pyarrow as pa

    base = id_text(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(batch, texts: list[str], found: list[Found]):
        clean = [cleaned(t, spans) if spans else t for t, (_, spans, _) in zip(texts, found, strict=True)] if with_text else [None] * len(texts)
        columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], span), pa.array([i for _, _, i in found], pa.list_(pa.string())), pa.array(clean, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "spans", "items", "clean"])

    return _over_blocks(base, items, "text", item_col, item_text_col, window, block_words, broadcast_bytes, StructType.fromDDL(_OUT), finish)


def clean(docs: DataFrame, items: DataFrame, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 100_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """docs without the contaminated spans; rows of which at least ``coverage`` of the words is contaminated go.

    All columns stay; each row is cleaned by itself, so repeated and null ids need no
    rule. A null text stays null, and goes with no one.
    """
    import pyarrow as pa

    def finish(batch, texts: list[str], found: list[Found]):
        at = batch.schema.get_field_index(text_col)
        old = batch.column(at).to_pylist()
        new = [cleaned(t, spans) if spans else o for o, t, (_, spans, _) in zip(old, texts, found, strict=True)]
        stay = [not spans or sum(e - s for s, e in spans) < n * coverage for n, spans, _ in found]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.column(at).type)).filter(pa.array(stay, pa.bool_()))

    return _over_blocks(docs, items, text_col, item_col, item_text_col, window, block_words, broadcast_bytes, docs.schema, finish)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from decontaminate()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with i as (select item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, unnest([array_to_string(w[p : p + least(10, len(w)) - 1], ' ') for p in range(1, greatest(len(w) - 9, 1) + 1)]) as win, least(10, len(w)) as k from i where len(w) > 0),
d as (select doc_id, {_WORDS} as w from documents),
ks as (select distinct k from iw),
dw as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as p, unnest([array_to_string(w[p : p + k - 1], ' ') for p in range(1, len(w) - k + 2)]) as win from d, ks where len(w) >= k),
h as (select doc_id, p, k, item_id from dw join iw using (win, k)),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from h)) group by doc_id),
e as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join e using (doc_id)"""
