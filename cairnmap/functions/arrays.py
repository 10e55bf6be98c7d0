"""Small expressions on class arrays and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(y: Column, n: int) -> Column:
    """n integers, 1 at the class."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == y).cast("int"))


def from_one_hot(a: Column) -> Column:
    """Position of the first 1, counted from 0; null if there is none."""
    at = F.array_position(a, 1)
    return F.when(at > 0, at - 1).cast("int")


def argmax(a: Column) -> Column:
    """Position of the largest element, the lowest on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confusion_index(p: Column) -> Column:
    """1 less the gap between the two largest probabilities."""
    s = F.array_sort(p)
    return 1 - (F.element_at(s, -1) - F.element_at(s, -2))


def joint_uncertainty(base: Column, child: Column) -> Column:
    return 1 - (1 - base) * (1 - child)


def pixel_id(row: Column, col: Column, n_cols: int) -> Column:
    return row * n_cols + col


def row_of(pixel: Column, n_cols: int) -> Column:
    return F.floor(pixel / n_cols)


def col_of(pixel: Column, n_cols: int) -> Column:
    return (pixel % n_cols).cast("int")


def due_time(start: Column, now: Column, done: Column, total: Column) -> list[Column]:
    """Days, hours, minutes that the rest takes at the pace so far; seconds since the epoch in."""
    left = (now - start) / done * (total - done)
    minutes = F.floor(left / 60)
    return [F.floor(minutes / 1440).alias("days"), F.floor(minutes % 1440 / 60).alias("hours"), (minutes % 60).alias("minutes")]


def raster_path(folder: str, name: Column, postfix: str = ".tif") -> Column:
    return F.concat(F.concat_ws("/", F.lit(folder), name), F.lit(postfix))
