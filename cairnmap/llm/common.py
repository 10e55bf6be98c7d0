"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
MUL = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240117)
#: A random odd 64-bit value for each byte; separators count as nothing.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
WORD_VALUES = BYTE_VALUES.copy()
WORD_VALUES[[0x20, 0x0A]] = 0

#: Of A-Z to a-z, bytes of other letters stay.
SPACE, NEWLINE = 0x20, 0x0A


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays small too.

    The settings belong to the session and plans run later than they are made, so they
    stay; they are only ever lowered, and results do not depend on them.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(name)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from these that df has not, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def octets(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in df: what the optimiser knows of its files, else counted."""
    try:
        known = int(str(df.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()))
    except AttributeError:  # no JVM behind this session
        known = 0
    if 0 < known < 1 << 60:  # beyond that the optimiser does not know
        return known
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset and one machine does it all."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cairnmap-ckpt-"))
    return sc.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate rows from the shared storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable copy in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a folder of our own is set. Spark removes the files of dropped
    frames where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*frames: DataFrame) -> None:
    """Removes the files of checkpoint()'s frames; neither they nor what was made of them, but for later checkpoints, can be read again."""
    for df in frames:
        stored = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if stored.isDefined():
            discard(df.sparkSession, stored.get())


def sweep(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of frames that are gone; else they stay until the driver's heap happens to be full."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, as doc_id and text; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all bits (in place on a copy)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i, by doubling: no powers, no inverse, k of any size."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, step, width, mul = None, 0, h.astype(np.uint64, copy=True), 1, int(MUL)
    while True:
        if k & width:
            part = step[done : done + n]
            if out is None:
                out = part.copy()
            else:
                out *= np.uint64(mul)
                out += part
            done += width
        if done == k:
            return out
        step = step[:-width] * np.uint64(mul) + step[width:]
        width *= 2
        mul = mul * mul & MASK


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """min(v[i:i+k]) for each i, by doubling."""
    n = len(v) - k + 1
    if n <= 0:
        return v[:0]
    m, width = v, 1
    while width * 2 <= k:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return m[:n].copy() if width == k else np.minimum(m[:n], m[k - width : k - width + n])


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in bytes where single spaces or newlines separate words."""
    sep = (buf == SPACE) | (buf == NEWLINE)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    top = int((ends - starts).max()) + 2
    power = np.cumprod(np.full(top, MUL, np.uint64))
    h = np.empty(len(starts), np.uint64)
    step = 1 << 17
    for lo in range(0, len(starts), step):  # by blocks of words: the arrays over bytes stay small
        s, e = starts[lo : lo + step], ends[lo : lo + step]
        a = int(s[0])
        gap = np.append(s[1:], e[-1]) - s  # to the next word, separators included; these count as nothing
        within = np.arange(int(e[-1]) - a, dtype=np.int32) - np.repeat((s - a).astype(np.int32), gap)
        np.minimum(within, top - 1, out=within)
        values = power[within]
        values *= WORD_VALUES[buf[a : int(e[-1])]]
        h[lo : lo + step] = np.add.reduceat(values, s - a)
    return starts, ends, mix(h)


def trim() -> None:
    """Gives freed memory back at the end of a task, for the worker stays and others run beside it."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back


def runs(flag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one key (keys lie together)."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same positions."""
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _forest(batches):
    """Replaces the links of a task by a spanning forest: at most one link for each id."""
    import pandas as pd

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:  # a bound on memory; the later rounds join what is left
            yield pd.DataFrame([(x, root(x)) for x in parent if root(x) != x], columns=["a", "b"], dtype="int64")
            parent = {}
    yield pd.DataFrame([(x, root(x)) for x in parent if root(x) != x], columns=["a", "b"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a long, b long).

    Large-star and small-star contraction until nothing changes, each round cut by a
    reliable checkpoint; per-task spanning forests first, so that what is shuffled is
    bounded by ids for each task and not by links. No link is sent to the driver.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(_forest, "a long, b long")
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt = checkpoint(nxt)
        # Stars of depth one: no id is both a member and a centre, and each member has one centre.
        forget(edges)
        deep = nxt.select(F.col("b").alias("a")).distinct().join(nxt.select("a").distinct(), "a", "left_semi").limit(1).count()
        many = 0 if deep else nxt.groupBy("a").count().where("count > 1").limit(1).count()
        edges = nxt
        if not deep and not many:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
