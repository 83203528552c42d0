"""Count sketches in long form, (row, bucket, value): linear, so they are summed as they come and only then decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prng


def _hashed(df: DataFrame, key: str, rows: int, cols: int) -> DataFrame:
    r, k = F.col("row"), F.col(key)
    return df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("bucket", prng.bucket(r, k, cols)).withColumn("sign", _sign(r, k))


def _sign(row: Column, key: Column) -> Column:
    return F.when(F.substring(prng.digest(prng.SIGN, row, key), 1, 1) < "8", 1.0).otherwise(-1.0)


def sketch(df: DataFrame, key: str, value: str, rows: int, cols: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, row, bucket, value) of a sparse vector (key, value); repeated keys add up, null keys and values don't count.

    The aggregation combines before the shuffle: at most rows * cols rows leave a task for each group.
    """
    hashed = _hashed(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(*groups, key, value), key, rows, cols)
    return hashed.groupBy(*groups, "row", "bucket").agg(F.sum(F.col("sign") * F.col(value)).alias("value"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of the sum."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "bucket").agg(F.sum("value").alias("value"))


#: Cells of a sketch that are broadcast at most; a larger one is joined by its cells.
BROADCAST_CELLS = 1 << 20


def unsketch(table: DataFrame, keys: DataFrame, key: str, rows: int, cols: int) -> DataFrame:
    """(key, estimate): the median over the rows of each key's signed buckets; empty buckets are 0."""
    cells = F.broadcast(table) if rows * cols <= BROADCAST_CELLS else table
    found = _hashed(keys.select(key).distinct(), key, rows, cols).join(cells.select("row", "bucket", "value"), ["row", "bucket"], "left")
    return found.groupBy(key).agg(F.percentile(F.col("sign") * F.coalesce("value", F.lit(0.0)), F.lit(0.5)).alias("estimate"))


def mean_of_sketches(df: DataFrame, key: str, value: str, client: str, rows: int, cols: int) -> DataFrame:
    """(key, estimate) of the clients' mean vector: their sketches are summed as they are, decoded once and divided by their number."""
    table = sketch(df, key, value, rows, cols)
    n = df.where(F.col(client).isNotNull()).agg(F.count_distinct(client).alias("n"))
    return unsketch(table, df, key, rows, cols).crossJoin(F.broadcast(n)).select(key, (F.col("estimate") / F.greatest("n", F.lit(1))).alias("estimate"))  # n: one row


def abs_top_k(df: DataFrame, key: str, value: str, k: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of largest magnitude, ties by key; with groups, k of each.

    Without groups each task keeps k rows and sends only those. With groups the rank is over partitions of the groups.
    """
    if not groups:
        return df.orderBy(F.abs(value).desc(), key).limit(k)
    from pyspark.sql import Window

    w = Window.partitionBy(*groups).orderBy(F.abs(value).desc(), F.col(key))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def next_prime(n: int) -> int:
    """The smallest prime above n."""
    n += 1
    while n < 2 or any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def spec(size: int, rows: int = 5, cols: int | None = None, momentum: float = 0.9, lr: float = 1.0, k: int = 100, size_threshold: int = 10_000) -> dict | None:
    """Parameters of a sketched variable of ``size`` coordinates; None (identity) if it isn't larger than the threshold."""
    if size <= size_threshold:
        return None
    return {"rows": rows, "cols": cols or next_prime(size // 32), "momentum": momentum, "lr": lr, "k": k}


def fetch_step(momentum: DataFrame, error: DataFrame, gradient: DataFrame, keys: DataFrame, key: str, rows: int, cols: int, k: int, rho: float = 0.9, eta: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One server step on sketches: (update (key, value), momentum, error).

    m <- rho m + g; e' <- e + eta m; the update is the k largest estimates of e'; e <- e' in the buckets that the update's own sketch
    leaves at 0, and 0 in the others.
    """
    m = momentum.select("row", "bucket", F.col("value") * rho).toDF("row", "bucket", "value").unionByName(gradient.select("row", "bucket", "value"))
    m = m.groupBy("row", "bucket").agg(F.sum("value").alias("value"))
    e = merge(error.select("row", "bucket", "value"), m.select("row", "bucket", (F.col("value") * eta).alias("value")))
    update = abs_top_k(unsketch(e, keys, key, rows, cols), key, "estimate", k).select(key, F.col("estimate").alias("value"))
    hit = sketch(update, key, "value", rows, cols).where("value <> 0").select("row", "bucket")
    return update, m, e.join(hit, ["row", "bucket"], "left_anti")


def spec_step(specs: dict[str, dict | None], state: dict[str, tuple[DataFrame, DataFrame]], gradients: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, tuple[DataFrame, DataFrame]]]:
    """One server step over several variables: (update (variable, key, value), state by variable).

    ``gradients`` hold (key, value); a variable without a spec passes its summed gradient through, the others take a sketched step
    with their own table and the (momentum, error) that ``state`` holds for them.
    """
    updates, after = None, {}
    for name, g in gradients.items():
        s = specs[name]
        if s is None:
            part = g.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.sum("value").alias("value"))
        else:
            table = sketch(g, "key", "value", s["rows"], s["cols"])
            empty = table.where(F.lit(False))
            m, e = state.get(name, (empty, empty))
            part, m, e = fetch_step(m, e, table, g, "key", s["rows"], s["cols"], s["k"], s["momentum"], s["lr"])
            after[name] = (m, e)
        part = part.select(F.lit(name).alias("variable"), "key", "value")
        updates = part if updates is None else updates.unionByName(part)
    return updates, after
