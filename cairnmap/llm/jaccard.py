"""Exact Jaccard join on word shingles by parity sketches.

A document's shingles are hashed to M blocks of a bit sketch; a shingle flips one bit of
its block, so the Hamming distance of two sketches never exceeds the symmetric
difference of the sets. Similarity bounds that difference by D; of M blocks at least
M - D are then untouched, and equal in both documents. Each size band fixes M; a
document sends the D + 1 blocks that hold most shingles (an order that depends on a
block's content only, so that both documents agree on it), and equal blocks meet in a
bucket. Candidates are pruned by Hamming distance where groups are large and verified on
their texts.

Groups do not become all pairs: a group of more than ``small`` documents gives links to
its smallest member only. Groups that then still span components are dealt in pairs of
blocks, of which one side lies outside the group's largest component; of what the
sketches allow between different components each document offers its smallest partners,
more of them each round, until none is left out: what is verified in one round makes most
of the rest needless in the next.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, fresh, id_text, mix, partitions, sweep, trim, tune, window_hash, word_bounds

BLOCK = "bucket int, payload binary"
SALTS = 32


class Shape:
    """Bands of set sizes and the numbers of blocks that the similarity asks for."""

    def __init__(self, words: int, percent: int, growth: float = 1.5):
        self.words, self.percent, self.growth = words, percent, growth

    def differ(self, a: int, b: int) -> int:
        """The largest symmetric difference of sets of these sizes that are similar enough."""
        # 100 * i >= p * (a + b - i)  <=>  a + b - 2 i <= (a + b) (100 - p) / (100 + p)
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest(self, n: int) -> int:
        """The largest set similar enough to one of n shingles."""
        return n * 100 // self.percent

    def band(self, n: int) -> int:
        b = 0
        while self.floor(b + 1) <= n:
            b += 1
        return b

    def floor(self, b: int) -> int:
        """The smallest size in band b."""
        n = 1
        for _ in range(b):
            n = max(n + 1, int(n * self.growth))
        return n

    def blocks(self, b: int) -> int:
        """M of a band: room for the largest difference within it, and slack to leave out sparse blocks."""
        top = self.floor(b + 1) - 1
        return self.differ(top, self.largest(top)) * 13 // 10 + 2


def shingles(raw: bytes, k: int, shape_words: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of lower-cased words joined by single spaces."""
    buf = np.frombuffer(raw, np.uint8)
    _, _, h = word_bounds(buf)
    return shingle_hashes(h, k)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if not len(h):
        return h
    # A shorter sequence is one shingle; its number of words keeps it apart from parts of longer ones.
    return np.unique(mix(window_hash(h, k))) if len(h) >= k else mix(window_hash(h, len(h)) + np.uint64(len(h)))


def normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def sketch(hashes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of m blocks of 64 bits: parity words, counts of shingles, and exclusive-or of the hashes."""
    spread = hashes * np.uint64(0xD6E8FEB86659FD93)
    block = ((spread >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, own = block[order], hashes[order]
    count = np.bincount(block, minlength=m)
    words, total = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    words[block[at]] = np.bitwise_xor.reduceat(np.uint64(1) << (own & np.uint64(63)), at)
    total[block[at]] = np.bitwise_xor.reduceat(own, at)
    return words, count, total


def keys(hashes: np.ndarray, shape: Shape, limits: list[tuple[int, int, int]]) -> np.ndarray:
    """The block keys of a set: for its own band, and for the band below if a smaller set there may be similar."""
    n = len(hashes)
    out = []
    for band, m, differ in limits:
        words, count, total = sketch(hashes, m)
        content = mix(total ^ mix(words + np.arange(m, dtype=np.uint64)))
        order = np.lexsort((content, count))[::-1][: differ + 1]
        out.append(mix(content[order] + np.uint64(0x1000003) * order.astype(np.uint64) + mix(np.full(1, band + 1, np.uint64))))
    return np.concatenate(out) if n else np.empty(0, np.uint64)


def limits_of(n: int, shape: Shape) -> list[tuple[int, int, int]]:
    """(band, blocks, D) for which a set of n shingles sends keys."""
    b = shape.band(n)
    out = [(b, shape.blocks(b), shape.differ(n, shape.largest(n)))]
    if b and shape.largest(shape.floor(b) - 1) >= n:  # as the larger of a pair: the partner lies in the band below
        out.append((b - 1, shape.blocks(b - 1), shape.differ(n, shape.floor(b) - 1)))
    return out


def _chunks(batches: Iterator[pd.DataFrame], size: int = 4 << 20):
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for pdf in batches:
        for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            ids.append(d)
            texts.append(normal(t))
            held += len(texts[-1])
            if held > size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text, from one pass over all."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, _, h = word_bounds(buf)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(starts, ends[:-1]))


#: One pass over the texts gives both: of each row (doc_id, n_shingles, copy), and blocks of keys for the buckets.
SENT = "doc_id long, n_shingles long, copy binary, bucket int, payload binary"


def _sender(shape: Shape, n_buckets: int, flush: int = 1_500_000):
    """Number of shingles and digest of the normal text of each row; keys with document ids by bucket.

    Of equal texts within a task only the smallest id sends keys.
    """

    def rows_of(ids: list[int], n: list[int], copy: list[bytes | None]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pd.array([None if d != d else d for d in ids], "Int64"), "n_shingles": pd.array(n, "Int64"), "copy": copy, "bucket": pd.array([None] * len(ids), "Int32"), "payload": None})

    def blocks(ids: list[np.ndarray], ks: list[np.ndarray]) -> pd.DataFrame:
        k = np.concatenate(ks)
        d = np.concatenate(ids)
        bucket = (k % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((d, k, bucket))
        k, d, bucket = k[order], d[order], bucket[order]
        keep = np.ones(len(k), bool)
        keep[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d, bucket = k[keep], d[keep], bucket[keep]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        packer = zstandard.ZstdCompressor(level=1)
        payloads = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(k)], strict=True):
            known, index = np.unique(d[a:b], return_inverse=True)
            gap = np.diff(k[a:b], prepend=np.uint64(0))
            columns = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T).tobytes()  # by byte, so that the high bytes compress
            which = np.ascontiguousarray(index.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            payloads.append(packer.compress(struct.pack("<QQ", b - a, len(known)) + np.diff(known, prepend=0).astype("<i8").tobytes() + columns + which))
        none = pd.array([None] * len(at), "Int64")
        return pd.DataFrame({"doc_id": none, "n_shingles": none, "copy": None, "bucket": bucket[at].astype(np.int32), "payload": payloads})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[int, list] = {}
        ids: list[np.ndarray] = []
        ks: list[np.ndarray] = []
        held = 0
        sent: dict[bytes, int] = {}
        for docs, texts in _chunks(batches):
            copy = [blake2b(t, digest_size=16).digest() if t else None for t in texts]
            sets = [shingle_hashes(h, shape.words) for h in _word_hashes(texts)]
            yield rows_of(docs, [len(x) for x in sets], copy)
            for c, d in zip(copy, docs, strict=True):
                if c is not None and d == d and d < sent.get(c, d + 1):
                    sent[c] = d
            # A copy of a text that a smaller id of the task has is known by its digest and need not be sent.
            for c, d, x in zip(copy, docs, sets, strict=True):
                if c is None or d != d or sent[c] != d:
                    continue
                n = len(x)
                limits = sizes.get(n)
                if limits is None:
                    limits = sizes[n] = limits_of(n, shape)
                k = keys(x, shape, limits)
                ks.append(k)
                ids.append(np.full(len(k), int(d), np.int64))
                held += len(k)
            if held > flush:
                yield blocks(ids, ks)
                ids, ks, held = [], [], 0
        if held:
            yield blocks(ids, ks)
        trim()

    return run


def _read(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, m = struct.unpack_from("<QQ", raw)
    at = 16
    known = np.cumsum(np.frombuffer(raw, "<i8", m, at))
    at += 8 * m
    k = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, -1).T).view("<u8").ravel())
    at += 8 * n
    index = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T).view("<u4").ravel()
    return k.astype(np.uint64), known[index]


def _meeter(small: int):
    """Of a bucket: pairs of small groups, links of larger ones to their smallest member, and the larger groups themselves (g)."""

    def groups(payloads: list[bytes]) -> pd.DataFrame:
        parts = [_read(p) for p in payloads]
        k, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(head, len(k)))
        a, b = [], []
        for n in range(2, small + 1):
            at = head[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    a.append(d[at + i])
                    b.append(d[at + j])
        big = np.flatnonzero(size > small)
        at = np.repeat(head[big], size[big])
        within = np.arange(len(at)) - np.repeat(np.cumsum(size[big]) - size[big], size[big])
        member, low, key = d[at + within], d[at], k[at].astype(np.int64)
        pairs = np.unique(np.column_stack((np.concatenate([*a, low]), np.concatenate([*b, member]))), axis=0) if len(at) or a else np.empty((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        # Larger groups of the same members are one group.
        rows = pd.DataFrame({"a": member, "g": key})
        return pd.concat([pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "g": pd.array([None] * len(pairs), "Int64")}), pd.DataFrame({"a": rows["a"], "b": pd.array([None] * len(rows), "Int64"), "g": rows["g"]})])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, payloads = None, []
        for pdf in batches:
            for x, p in zip(pdf["bucket"].tolist(), pdf["payload"].tolist(), strict=True):
                if x != bucket and payloads:
                    yield groups(payloads)
                    payloads = []
                bucket = x
                payloads.append(p)
        if payloads:
            yield groups(payloads)
        trim()

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union for sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (len(a) + len(b) - i)


def _verifier(shape: Shape):
    """Streams texts sorted by pair centre: the centre's own texts first, then its partners'; any two of them may be similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, own = None, []
        for pdf in batches:
            a, b = [], []
            for c, s, d, t in zip(pdf["a"].tolist(), pdf["salt"].tolist(), pdf["b"].tolist(), pdf["text"].tolist(), strict=True):
                h = shingles(normal(t), shape.words, shape.words)
                if centre != (c, s):
                    centre, own = (c, s), []
                if d == c:
                    own.append(h)
                elif any(similar(x, h, shape.percent) for x in own):
                    a.append(c)
                    b.append(d)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")
        trim()

    return run


def verified(pairs: DataFrame, docs: DataFrame, shape: Shape, share: int = 64) -> DataFrame:
    """Of candidate pairs (a, b) those whose texts are similar enough.

    Each partner's text goes to its centre once; a centre's text once for each ``share``
    of its partners at the least, so that a hot centre spreads over tasks.
    """
    n = partitions(docs.sparkSession)
    slot = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("a", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("slot"))
    salted = pairs.withColumn("slot", slot).join(hot, ["a", "slot"], "left").select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.ceil(F.coalesce("n", F.lit(1)) / share)).cast("int").alias("salt"))
    wanted = salted.unionByName(salted.select("a", F.col("a").alias("b"), "salt").distinct())
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), "text")
    return (
        wanted.join(texts, F.col("b") == F.col("_id")).select("a", "salt", "b", (F.col("a") != F.col("b")).alias("after"), "text").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "after").select("a", "salt", "b", "text").mapInPandas(_verifier(shape), "a long, b long").distinct()
    )


def _sketcher(shape: Shape):
    """Sketches of whole texts for each band a document may meet in: doc_id, band, its n and parity words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _chunks(batches):
            rows = []
            for d, h in zip(ids, _word_hashes(texts), strict=True):
                s = shingle_hashes(h, shape.words)
                if len(s):
                    m = max(8, shape.blocks(0), 2 * len(s) // 64)
                    m = 1 << (m - 1).bit_length()
                    rows.append((d, len(s), sketch(s, m)[0].tobytes()))
            yield pd.DataFrame(rows, columns=["_id", "n", "bits"])

    return run


def _fold(bits: np.ndarray, m: int) -> np.ndarray:
    """A sketch of fewer blocks: blocks that fall together are added bit by bit, modulo two."""
    return np.bitwise_xor.reduce(bits.reshape(-1, m), axis=0) if len(bits) > m else bits


def _pruner(shape: Shape, width: int):
    """Pairs of blocks of a group, sorted by (g, i, j, side): what the sketches allow between different components.

    Of that, each document offers its ``width`` smallest partners in the other block;
    ``more`` marks that some pair was offered by neither side.
    """

    def near(x: list, y: list) -> tuple[list[tuple[int, int]], bool]:
        same = not y
        x = sorted(x, key=lambda r: r[0])
        y = x if same else sorted(y, key=lambda r: r[0])
        out, more = [], False
        id_y, n_y, c_y = (np.array([r[k] for r in y]) for k in range(3))
        m = min(len(r[3]) for r in [*x, *y])
        bits = np.array([_fold(r[3], m) for r in y])
        taken = np.zeros(len(y), np.int64)
        for d, n, c, w in x:
            at = np.flatnonzero((c_y != c) & (np.minimum(n, n_y) * 100 >= np.maximum(n, n_y) * shape.percent) & (id_y != d))
            if not len(at):
                continue
            far = np.bitwise_count(bits[at] ^ _fold(w, m)).sum(1)
            at = at[far <= (n + n_y[at]) * (100 - shape.percent) // (100 + shape.percent)]
            offer = taken[at] < width
            offer[:width] = True
            more |= not offer.all()
            taken[at] += 1
            out += [(min(d, o), max(d, o)) for o in id_y[at[offer]].tolist()]
        return out, more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sides = None, ([], [])

        def flush() -> pd.DataFrame:
            pairs, more = near(*sides) if len(sides[0]) + len(sides[1]) > 1 and sides[0] else ([], False)
            pairs = sorted(set(pairs))
            return pd.DataFrame({"a": pd.array([p[0] for p in pairs] + [None] * more, "Int64"), "b": pd.array([p[1] for p in pairs] + [None] * more, "Int64")})

        for pdf in batches:
            for g, i, j, side, d, n, c, w in zip(*(pdf[k].tolist() for k in ("g", "i", "j", "side", "a", "n", "c", "bits")), strict=True):
                if (g, i, j) != key:
                    if key is not None and (key[1] == key[2] or sides[1]):
                        yield flush()
                    key, sides = (g, i, j), ([], [])
                sides[side].append((d, n, c, np.frombuffer(w, np.uint64)))
        if key is not None and (key[1] == key[2] or sides[1]):
            yield flush()
        trim()

    return run


def _blocks(size: Column) -> Column:
    """Number of blocks of so many documents: sqrt(size) / 4 for large ones, so that a block's rows and its copies grow alike."""
    return F.greatest(F.lit(1), F.least(F.ceil(size / 256), F.ceil(F.sqrt(size) / 4))).cast("int")


def _in_blocks(rest: DataFrame, shape: Shape, width: int, n: int) -> DataFrame:
    """Rows (a, b) of pairs that blocks of open groups offer, and a row of nulls for each pair of blocks that left some out.

    Documents outside a group's largest component (minor) meet all, those inside only the
    minor ones: blocks 0 to few - 1 are minor ones, the others follow.
    """
    few, many = _blocks(F.col("size") - F.col("n_top")), _blocks(F.col("n_top"))
    minor, h = F.col("c") != F.col("top"), F.xxhash64("a", "g")
    own = F.when(minor, F.pmod(h, few)).otherwise(few + F.pmod(h, many)).cast("int")
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, few + many).otherwise(few) - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "a", "n", "c", "bits")
    return dealt.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "side").mapInPandas(_pruner(shape, width), "a long, b long")


def _settled(comp: DataFrame, met: DataFrame, texts: DataFrame, shape: Shape, width: int = 4) -> DataFrame:
    """Components after all links within larger groups are found; met holds rows (g, a)."""
    n = partitions(texts.sparkSession)
    bits = tested = None
    while True:
        member = met.join(comp, F.col("a") == F.col("id"), "left").select("g", "a", F.coalesce("component", "a").alias("c"))
        # Groups that still span components; of groups with the same members one.
        parts = member.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y"))
        whole = parts.groupBy("g").agg(F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("top"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("size > top.n")
        once = whole.groupBy("size", "x", "y").agg(F.min(F.struct("g", "top")).alias("s")).select("s.g", "size", F.col("s.top.c").alias("top"), F.col("s.top.n").alias("n_top"))
        rest = checkpoint(member.join(once, "g"))
        if rest.isEmpty():
            forget(rest)
            return comp
        if bits is None:  # later rounds need no other documents
            wide = rest.select(F.col("a").alias("_need")).distinct()
            bits = checkpoint(texts.join(wide, F.col("doc_id") == F.col("_need"), "left_semi").mapInPandas(_sketcher(shape), "_id long, n long, bits binary").distinct())
        open_, rest = rest, checkpoint(rest.join(bits, F.col("a") == F.col("_id")).drop("_id"))
        forget(open_)
        sweep(texts.sparkSession)
        found = checkpoint(_in_blocks(rest, shape, width, n))
        forget(rest)
        new, more = found.where("a is not null").distinct(), not found.where("a is null").isEmpty()
        new = checkpoint(new.join(tested, ["a", "b"], "left_anti") if tested is not None else new)
        forget(found)
        sweep(texts.sparkSession)
        tested = new if tested is None else tested.unionByName(new)
        links = verified(new, texts, shape)
        comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
        sweep(texts.sparkSession)
        if not more:
            return comp
        width *= 8


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = 4, spread: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Words are lower-cased (ASCII) runs of anything but space and \\t to \\r; a set holds
    the distinct shingles of ``words`` words, or a shorter text's whole sequence. Two
    documents link when 100 * intersection >= percent * union. Null texts and texts
    without words have no set and link with nothing; a null id is its own, null,
    component. Rows of one id count as one document, which links by any of its texts.
    Shingles are compared by 64-bit hashes. Links between equal texts come from a digest;
    all others are verified.
    """
    spark = docs.sparkSession
    tune(spark)
    shape, n = Shape(words, percent), partitions(spark)
    base = id_text(docs, id_col, text_col)
    sent = checkpoint(base.mapInPandas(_sender(shape, spread * n), SENT))
    counted = checkpoint(sent.where("bucket is null").select("doc_id", "n_shingles", "copy"))
    known = counted.where("doc_id is not null and copy is not null").select("doc_id", "copy")
    # Copied texts only, each dealt over salts: a text that a third of all rows copy does not meet in one task.
    first = known.groupBy("copy").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("times")).where("times > 1").select("copy", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = checkpoint(known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(first, ["copy", "salt"]).select(F.col("doc_id").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    met = sent.where("bucket is not null").select("bucket", "payload").repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_meeter(small), "a long, b long, g long")
    # A copy stands for the smallest of its texts, so that equal texts are verified once; not where an id has other texts too.
    texts_of = known.join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("copy").alias("x"), F.max("copy").alias("y")).where("x = y").select(F.col("doc_id").alias("a"))
    low = copies.join(texts_of, "a").select("a", F.col("b").alias("low"))
    # The smallest member of a large group has a row for each of the others, and is dealt over slots.
    dealt = low.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS // 2 - 1))))
    met = met.withColumn("slot", F.pmod(F.xxhash64(F.coalesce("b", "g")), F.lit(SALTS // 2)).cast("int")).join(dealt, ["a", "slot"], "left").select(F.coalesce("low", "a").alias("a"), "b", "g")
    met = met.withColumn("_id", F.coalesce("b", "a")).join(low.withColumnRenamed("a", "_id"), "_id", "left")  # rows of groups have no b and would all meet
    met = met.select("a", F.when(F.col("b").isNotNull(), F.coalesce("low", "b")).alias("b"), "g")
    met = checkpoint(met.where("g is not null or a <> b").select(F.when(F.col("g").isNull(), F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(F.col("g").isNull(), F.greatest("a", "b")).alias("b"), "g").distinct())
    forget(sent)  # keys are the most of what is stored, and all have met
    sweep(spark)
    pairs = met.where("g is null").select("a", "b")
    # Only texts of documents that met others move again.
    need = met.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "_need")
    texts = checkpoint(base.join(need, F.col("doc_id") == F.col("_need"), "left_semi"))
    links = checkpoint(verified(pairs, texts, shape).unionByName(copies))
    sweep(spark)
    comp = components(links)
    forget(links)
    comp = _settled(comp, met.where("g is not null").select("g", "a"), texts, shape)
    forget(met, texts, copies)
    sweep(spark)
    return counted.join(comp, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of smallest id, all columns as they are.

    Rows of that id all stay, for they are one document; so do rows with null ids and
    documents without words.
    """
    (key,) = fresh(docs, "gone")
    gone = join(docs, words, percent, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [array_to_string(w[p : p + 2], ' ') for p in range(1, len(w) - 1)] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * i >= 90 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
r as (with recursive reach(x, y) as (select doc_id, doc_id from d union select reach.x, e.b from reach join e on e.a = reach.y) select x, min(y) as c from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id from d left join n using (doc_id) join r on r.x = d.doc_id"""
