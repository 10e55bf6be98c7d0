"""Tables beside rasters: CSV scans and reports, catalogues, side-cars, model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are inferred only where no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def column_list(df: DataFrame, name: str, limit: int = 100_000) -> list:
    """A dimension column in order; refuses tables beyond the limit, which belong in a DataFrame."""
    rows = df.select(name).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values in {name}: keep it as a DataFrame")
    return [r[0] for r in rows]


def raster_paths(folder: str, names: list[str], postfix: str = ".tif") -> list[str]:
    return [f"{folder}/{n}{postfix}" for n in names]


def training_set(df: DataFrame, names: list[str], label: str | None = None, one_hot: list[str] | None = None) -> DataFrame:
    """y and the feature columns x: the label column, or the place of the 1 among class columns."""
    if (label is None) == (one_hot is None):
        raise ValueError("give either a label column or the class columns")
    missing = [c for c in [*names, *(one_hot or [label])] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    y = F.col(label) if label else (F.array_position(F.array(*[F.col(c).cast("int") for c in one_hot]), 1) - 1).cast("int")
    return df.select(y.alias("y"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """ID from 1 in the given order, for reports that people read: bounded tables."""
    return df.select(F.row_number().over(Window.orderBy(*order)).alias("ID"), *df.columns)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    with_row_id(df, order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def ragged(lists: DataFrame) -> DataFrame:
    """pos and a column run<i> for each run of (run, features): shorter lists end in nulls."""
    long = lists.select("run", F.posexplode("features").alias("pos", "var"))
    return long.groupBy("pos").pivot("run").agg(F.first("var")).orderBy("pos")


def save_ensemble(ensemble: DataFrame, path: str) -> None:
    ensemble.write.mode("overwrite").parquet(path)


def load_ensemble(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def importance(scores: DataFrame) -> DataFrame:
    """feature, score, the largest first."""
    return scores.orderBy(F.col("score").desc(), "feature")


def read_world_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, px_w, rot_y, rot_x, px_h, x, y from six-line world files; x and y are the centre of the first pixel."""
    t = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("file"), F.split(F.trim("value"), r"\s+").alias("v"))
    return t.select("file", *[F.element_at("v", i + 1).cast("double").alias(n) for i, n in enumerate(["px_w", "rot_y", "rot_x", "px_h", "x", "y"])])


def read_statistics(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, minimum, maximum, mean, stddev from XML statistics side-cars."""
    t = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.tif)?\.aux\.xml$", 1).alias("file"), "value")

    def of(key: str):
        return F.regexp_extract("value", rf'key="STATISTICS_{key}">([^<]*)<', 1).cast("double").alias(key.lower())

    return t.select("file", of("MINIMUM"), of("MAXIMUM"), of("MEAN"), of("STDDEV"))
