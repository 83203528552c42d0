"""Streaming faces of linear operators: sketches and means add up, so update mode is exact."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sketch import _hashed
from ..sources.tables import shared_folder


def windowed_sketch(events: DataFrame, key: str, value: str, ts: str, window: str, delay: str, rows: int, cols: int) -> DataFrame:
    """(window_start, row, bucket, value) of a stream: a count sketch per tumbling window, late rows within ``delay`` included."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    hashed = _hashed(events.withWatermark(ts, delay).where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(ts, key, value), key, rows, cols)
    sums = hashed.groupBy(F.window(ts, window).alias("w"), "row", "bucket").agg(F.sum(F.col("sign") * F.col(value)).alias("value"))
    return sums.select(F.col("w.start").alias("window_start"), "row", "bucket", "value")


def running_mean(messages: DataFrame, key: str, x: str) -> DataFrame:
    """(key, i, n, mean) of a stream of decoded vectors."""
    return messages.select(key, F.posexplode_outer(x).alias("i", "v")).where("i IS NOT NULL").groupBy(key, "i").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))


def run_once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process all that is available in update mode and return the latest row of each key, through the shared checkpoint folder.

    A batch writes only what it changed, to a folder of its own, so a batch that runs again replaces what it wrote. Rows beyond the
    watermark are dropped with their windows' state, as the delay of the stream says.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    written = []

    def write(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    if not written:  # the input was empty
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(f"{kinds}, batch long").parquet(f"{place}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, "__last.*").select(*stream.columns)
