"""Views over the given tables that stand in for rasters, samples, votes and hierarchies.

Each view is a DataFrame here and a DuckDB common table expression in SQL, with the same
columns and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band: a vector for each row, a component for each column; zero is NoData."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("row"), F.posexplode("embedding").alias("col", "x")).select("row", "col", F.round(F.col("x").cast("double"), 3).alias("v"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven bands for each pixel."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("pixel"), *[F.round(F.element_at("embedding", i).cast("double"), 3).alias(f"b{i}") for i in range(1, 8)])


def samples(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Labelled samples: id, class y, features x."""
    e = table(spark, sf_dir, "embeddings")
    x = F.slice("embedding", 1, n).cast("array<double>")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("y"), F.transform(x, lambda v: F.round(v, 3)).alias("x"))


def wide(df: DataFrame, n: int) -> DataFrame:
    """Samples with a column for each feature."""
    return df.select("id", "y", *[F.element_at("x", i + 1).alias(f"x{i}") for i in range(n)])


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth y, prediction p that errs on every fifth id, probability s of class 1 against the rest."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("y"))
    p = F.when(F.col("id") % 5 == 0, (F.col("y") + 1) % 10).otherwise(F.col("y")).cast("int")
    return e.select("id", "y", p.alias("p"), ((F.col("id") * 7919 % 101) / 101 * 0.6 + F.when(F.col("y") >= 5, 0.4).otherwise(0.0)).alias("s"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven runs that each predict a class of five for each id."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("c"))
    runs = o.select("id", "c", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("run"))
    return runs.select("run", "id", ((F.col("id") * F.col("run") + F.col("c")) % 5).cast("int").alias("pred"), ((F.col("id") * 31 + F.col("run") * 17) % 97 / 97).alias("prob"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of each run: a share of right votes, and an offset that sets runs apart."""
    return votes(spark, sf_dir).groupBy("run").agg(F.avg((F.col("pred") == F.col("id") % 5).cast("double")).alias("a")).select("run", F.round(F.lit(0.3) + F.col("run") * 0.05 + F.col("a"), 6).alias("e"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("upper"), F.col("n_nationkey").cast("int").alias("lower"), F.col("n_nationkey").cast("int").alias("pos"))


def base_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("int").alias("lower"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("name"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = e.groupBy(F.to_date("ts").alias("d")).agg(F.round(F.avg(F.col("value").cast("decimal(20,6)")).cast("double"), 3).alias("metric"))
    return d.select((F.datediff("d", F.lit("2024-01-01").cast("date")) + 1).cast("int").alias("iter"), "metric")


SQL = {
    "v_raster": "select vec_id::bigint as row, (i - 1)::integer as col, round(embedding[i]::double, 3) as v from embeddings, range(1, 65) t(i)",
    "v_bands": "select vec_id::bigint as pixel, " + ", ".join(f"round(embedding[{i}]::double, 3) as b{i}" for i in range(1, 8)) + " from embeddings",
    "v_samples": "select vec_id::bigint as id, label::integer as y, [round(e::double, 3) for e in embedding] as x from embeddings",
    "v_long": "select vec_id::bigint as id, label::integer as y, (i - 1)::integer as f, round(embedding[i]::double, 3) as v from embeddings, range(1, 65) t(i)",
    "v_pred": "select vec_id::bigint as id, label::integer as y, (case when vec_id % 5 = 0 then (label + 1) % 10 else label end)::integer as p, (vec_id * 7919 % 101) / 101.0::double * 0.6::double + case when label >= 5 then 0.4::double else 0.0::double end as s from embeddings",
    "v_votes": "select r::integer as run, o_orderkey::bigint as id, ((o_orderkey * r + o_custkey) % 5)::integer as pred, ((o_orderkey * 31 + r * 17) % 97) / 97.0::double as prob from orders, range(1, 8) t(r)",
    "v_metrics": "select run, round(0.3::double + run * 0.05::double + avg((pred = id % 5)::integer::double), 6) as e from v_votes group by run",
    "v_hier": "select n_regionkey::integer as upper, n_nationkey::integer as lower, n_nationkey::integer as pos from nation",
    "v_base": "select c_custkey::bigint as id, c_nationkey::integer as lower from customer",
    "v_names": "select c_custkey::bigint as id, c_mktsegment as name from customer",
    "v_series": "select (date_diff('day', date '2024-01-01', ts::date) + 1)::integer as iter, round(avg(value::decimal(20,6)), 3)::double as metric from events group by ts::date",
}
_NEEDS = {"v_metrics": ["v_votes"]}


def sql(body: str, *views: str) -> str:
    """The body with the views it reads in front; a body may begin with further ``name as (...)`` and a final select."""
    order: list[str] = []
    for v in views:
        order += [n for n in [*_NEEDS.get(v, []), v] if n not in order]
    head = ", ".join(f"{v} as ({SQL[v]})" for v in order)
    body = body.strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
