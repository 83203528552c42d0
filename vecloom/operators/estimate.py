"""Mean estimation and its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec


def nmse(x: Column, xhat: Column) -> Column:
    """Squared error over squared norm; 0 for a zero vector that is met."""
    return vec.ratio(vec.squared_distance(x, xhat), vec.norm2_squared(x))


def sign_nmse(y: Column) -> Column:
    """NMSE of the sign codec from the rotated vector alone: no inverse transform is needed."""
    d = F.size(y)
    return F.when(vec.norm1(y) == 0, 0.0).otherwise(d * vec.ratio(vec.norm2_squared(y), vec.norm1(y) * vec.norm1(y)) - 1)


def two_means_nmse(y: Column, m: Column) -> Column:
    """The same for the two-means codec and its split m."""
    energy = m["n0"] * m["c0"] * m["c0"] + m["n1"] * m["c1"] * m["c1"]
    return F.when(energy == 0, 0.0).otherwise(vec.ratio(vec.norm2_squared(y), energy) - 1)


def coordinates(df: DataFrame, keys: list[str], x: str = "xhat") -> DataFrame:
    """(keys, i, v): one row per coordinate; null vectors have none.

    The outer form, since Spark infers a filter on the array from the other and computes the array once more for it.
    """
    return df.select(*keys, F.posexplode_outer(x).alias("i", "v")).where("i IS NOT NULL")


def mean_estimate(df: DataFrame, keys: list[str], x: str = "xhat", weight: str | None = None) -> DataFrame:
    """(keys, i, mean) of decoded vectors, weighted on demand. Sums are combined before the shuffle: what travels is a row per task,
    group and coordinate, however many vectors there are. Null vectors and weights don't count; a group of weight 0 has mean 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = coordinates(df.withColumn("__w", w.cast("double")), [*keys, "__w"], x)
    sums = long.where("__w IS NOT NULL").groupBy(*keys, "i").agg(F.sum(F.col("__w") * F.col("v")).alias("s"), F.sum("__w").alias("w"))
    return sums.select(*keys, "i", vec.ratio(F.col("s"), F.col("w")).alias("mean"))


def vectors_of(long: DataFrame, keys: list[str], value: str, out: str = "x") -> DataFrame:
    """Arrays again, in the order of i; a vector has a fixed number of coordinates, so a group is bounded."""
    pairs = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out))


def estimate_error(df: DataFrame, keys: list[str], x: str = "x", xhat: str = "xhat") -> DataFrame:
    """(keys, nmse) of the mean of several decoded copies of one vector per group."""
    est = vectors_of(mean_estimate(df, keys, xhat), keys, "mean", "__est")
    one = df.groupBy(*keys).agg(F.first(x).alias("__x"))
    return one.join(est, keys).select(*keys, nmse(F.col("__x"), F.col("__est")).alias("nmse"))


def trials(df: DataFrame, keys: list[str], value: str = "nmse") -> DataFrame:
    """Mean and sample deviation over the rows of each group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("trials"))


def rolling_mean(df: DataFrame, order: str, value: str, rows: int = 150, keys: list[str] | None = None) -> DataFrame:
    """Mean of the last ``rows`` rows of each run, null until there are so many."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) == rows, F.avg(value).over(w)))


def epochs(df: DataFrame, order: str, first: int, last: int, value: str, factor: float = 1.0) -> DataFrame:
    """Rounds first to last of a series, scaled (100 for percentages)."""
    return df.where(F.col(order).between(first, last)).withColumn(value, F.col(value) * factor)


def report(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row per ``row``, one column per name in ``columns``."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))
