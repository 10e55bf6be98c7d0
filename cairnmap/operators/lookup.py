"""Lookups, masks and predicates on classes, hierarchies and rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dimension(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A class catalogue, broadcast only once its size is known to be small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def classes_of(catalog: list[str], spark) -> DataFrame:
    """class_id and name; the id is the place in the catalogue."""
    return spark.createDataFrame(list(enumerate(catalog)), "class_id int, name string")


def name_to_id(df: DataFrame, classes: DataFrame, column: str = "name", strict: bool = False) -> DataFrame:
    """class_id of each name. Unknown names become class 0, or raise when strict."""
    out = df.join(_dimension(classes.select(F.col("name").alias(column), "class_id")), column, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(column), F.lit("null")))).cast("int") if strict else F.lit(0)
    return out.withColumn("class_id", F.coalesce("class_id", unknown))


def id_to_name(df: DataFrame, classes: DataFrame, column: str = "class_id") -> DataFrame:
    return df.join(_dimension(classes.withColumnRenamed("class_id", column)), column)


def in_list(name: Column, values: list[str]) -> Column:
    """1 if the name is one of the values, else 0."""
    return F.coalesce(name.isin(values), F.lit(False)).cast("int")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def class_expansion(samples: DataFrame, n_classes: int, label: str = "y") -> DataFrame:
    """Each row once for each class: class_id and hit (1 for its own). An array is exploded, so nothing is joined."""
    out = samples.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    return out.withColumn("hit", (F.col("class_id") == F.col(label)).cast("int")) if label in samples.columns else out


def hierarchy(pairs: DataFrame) -> DataFrame:
    """upper and its lower classes in order of first appearance (columns upper, lower, pos)."""
    first = pairs.groupBy("upper", "lower").agg(F.min("pos").alias("pos"))
    return first.groupBy("upper").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lower"))), lambda x: x["lower"]).alias("lowers"))


def map_up(base: DataFrame, relation: DataFrame) -> DataFrame:
    """upper class of each lower one; 0 where there is none."""
    rel = relation.groupBy("lower").agg(F.min("upper").alias("upper"))
    return base.join(_dimension(rel), "lower", "left").withColumn("upper", F.coalesce("upper", F.lit(0)))


def map_down(base: DataFrame, child_probs: DataFrame, relation: DataFrame) -> DataFrame:
    """id and lower: the likeliest child of the base class; an only child gets probability 1.

    base: id, upper; child_probs: id, lower, p; ties go to the lowest class.
    """
    rel = relation.select("upper", "lower").distinct()
    alone = rel.groupBy("upper").agg(F.count(F.lit(1)).alias("n"))
    options = base.join(_dimension(rel.join(alone, "upper")), "upper")
    scored = options.join(child_probs, ["id", "lower"], "left").withColumn("p", F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("p", F.lit(0.0))))
    return scored.groupBy("id").agg(F.max_by("lower", F.struct("p", -F.col("lower"))).alias("lower"), F.max("p").alias("p"))


def nodata_mask(df: DataFrame) -> DataFrame:
    """row, col, live: cells that differ from the top-left one. With a NaN there all are live."""
    corner = df.where("row = 0 and col = 0").select("v").first()
    value = None if corner is None else corner[0]
    if value is None or value != value:
        return df.select("row", "col", F.lit(True).alias("live"))
    return df.select("row", "col", (F.isnan("v") | (F.col("v") != value)).alias("live"))


def suppress_low(df: DataFrame, fraction: float, column: str = "p", mask: Column | None = None) -> DataFrame:
    """Probabilities below a fraction of the largest (of masked rows) become 0; the largest is one number."""
    top = df.agg(F.max(F.when(mask, F.col(column)) if mask is not None else F.col(column))).first()[0] or 0.0
    return df.withColumn(column, F.when(F.col(column) < fraction * top, 0.0).otherwise(F.col(column)))


def drop_repeated(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of left of which at least one column's value is absent from that column of right.

    Column by column, not as tuples: a row goes when each of its values occurs somewhere.
    """
    out = left
    for c in columns:
        seen = right.select(F.col(c).alias(c)).where(F.col(c).isNotNull()).distinct().withColumn(f"_in_{c}", F.lit(True))
        out = out.join(seen, c, "left")
    every = F.lit(True)
    for c in columns:
        every = every & F.coalesce(f"_in_{c}", F.lit(False))
    return out.where(~every).select(*left.columns)


def mosaic(blocks: DataFrame) -> DataFrame:
    """row, col, v of blocks (ylabel, xlabel, r, c, v) laid side by side; NaN becomes 0.

    Offsets are running sums of block heights and widths over the labels.
    """
    size = blocks.groupBy("ylabel", "xlabel").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ys = size.groupBy("ylabel").agg(F.max("h").alias("h")).withColumn("y0", F.coalesce(F.sum("h").over(before.orderBy("ylabel")), F.lit(0)))
    xs = size.groupBy("xlabel").agg(F.max("w").alias("w")).withColumn("x0", F.coalesce(F.sum("w").over(before.orderBy("xlabel")), F.lit(0)))
    return blocks.join(_dimension(ys), "ylabel").join(_dimension(xs), "xlabel").select((F.col("r") + F.col("y0")).alias("row"), (F.col("c") + F.col("x0")).cast("int").alias("col"), F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("v"))


def stack(long: DataFrame, bands: list[str]) -> DataFrame:
    """row, col and a column for each band, from (band, row, col, v): one aggregation instead of joins."""
    return long.groupBy("row", "col").pivot("band", bands).agg(F.first("v"))
