"""Inputs: the test tables as vectors and points, hash-random synthetic vectors, and metric files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prng, vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or one of this machine where it names none (tests)."""
    context = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or f"file:///tmp/checkpoints/{context.applicationId}"


def vectors(spark: SparkSession, sf_dir: str, clients: int = 1) -> DataFrame:
    """(vec_id, client, label, x) of the embeddings; client deals rows out round robin."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.pmod("vec_id", F.lit(clients)).cast("int").alias("client"), "label", vec.as_double("embedding").alias("x"))


def contiguous_clients(df: DataFrame, id: str, clients: int, n: int) -> DataFrame:
    """Rows 0..n-1 in contiguous blocks of n // clients; rows beyond the last whole block are dropped."""
    size = max(1, n // clients)
    return df.withColumn("client", F.floor(F.col(id) / size).cast("int")).where(F.col("client") < clients)


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, value) of the events, a sparse gradient per day."""
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "value")


def gaussian(entity: Column, i: Column) -> Column:
    """Standard normal by Box-Muller from two hash uniforms."""
    u = prng.uniform(prng.DATA, entity, 2 * i)
    v = prng.uniform(prng.DATA, entity, 2 * i + 1)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * math.pi) * v)


def synthetic(spark: SparkSession, distribution: str, d: int, trials: int, first: int = 0) -> DataFrame:
    """(trial, x): vectors of d independent coordinates. Names: lognormal, normal, exponential."""
    key = F.concat_ws("-", F.lit(distribution), F.lit(str(d)), F.col("trial").cast("string"))
    draw = {"lognormal": lambda i: F.exp(gaussian(key, i)), "normal": lambda i: gaussian(key, i), "exponential": lambda i: -F.log(1 - prng.uniform(prng.DATA, key, i))}
    if distribution not in draw:
        raise ValueError(f"unknown distribution {distribution!r}")
    rows = spark.range(first, first + trials).withColumnRenamed("id", "trial")
    return rows.select("trial", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), draw[distribution]).alias("x"))


def metrics_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns of a metrics CSV (header, one row per round), as numbers; the others aren't parsed."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])


def parse_pairs(df: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """Cells such as "0.12, 0.03" as two numbers."""
    parts = F.split(column, ",")
    return df.withColumns({n: F.trim(F.get(parts, F.lit(i))).try_cast("double") for i, n in enumerate(names)})


def write_results(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
