"""Queries by name: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prng, quant, vec
from ..operators import codecs, estimate, sketch, workloads
from ..sources import tables
from ..streaming import sketches

D = 64
#: Parameters of the sketches over users and parts.
SKETCH = {"rows": 5, "cols": 97}


def _bits(c: str = "msg.bits"):
    return F.array_join(F.transform(c, lambda b: b.cast("string")), "").alias("bits")


def _r(c, digits: int = 6):
    """Rounded, with no negative zero."""
    return (F.round(c, digits) + 0.0)


def _rotated(spark: SparkSession, sf_dir: str, clients: int = 1) -> DataFrame:
    return codecs.rotate(tables.vectors(spark, sf_dir, clients), "x", "y", D)


def sign_encode(spark, sf_dir):
    df = codecs.sign_encode(tables.vectors(spark, sf_dir), D)
    return df.select("vec_id", _r("msg.scale").alias("scale"), _bits())


def sign_nmse(spark, sf_dir):
    return _rotated(spark, sf_dir).select("vec_id", _r(estimate.sign_nmse(F.col("y"))).alias("nmse"))


def _round_trip(name: str):
    def query(spark, sf_dir):
        df = codecs.round_trip(tables.vectors(spark, sf_dir), name, D, row="vec_id")
        return df.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"), _r(vec.total(F.col("xhat")), 4).alias("total"))

    return query


def mean_estimate(spark, sf_dir):
    df = codecs.round_trip(tables.vectors(spark, sf_dir, 10), "sign", D)
    return estimate.mean_estimate(df, ["label"]).select("label", "i", _r("mean").alias("mean"))


def mean_of_ten_clients(spark, sf_dir):
    """NMSE of the mean of ten clients' decodings of the same vector, by label."""
    v = tables.vectors(spark, sf_dir).drop("client").withColumn("client", F.explode(F.sequence(F.lit(0), F.lit(9))))
    error = estimate.estimate_error(codecs.round_trip(v, "sign", D), ["vec_id", "label"])
    return estimate.trials(error, ["label"]).select("label", _r("mean").alias("mean"), _r("std").alias("std"), "trials")


def two_means_encode(spark, sf_dir):
    df = codecs.two_means_encode(tables.vectors(spark, sf_dir), D)
    return df.select("vec_id", _r("msg.c0").alias("c0"), _r("msg.c1").alias("c1"), "msg.n0", "msg.n1", _bits())


def two_means_nmse(spark, sf_dir):
    df = _rotated(spark, sf_dir).withColumn("m", quant.two_means(F.col("y")))
    return df.select("vec_id", _r(estimate.two_means_nmse(F.col("y"), F.col("m"))).alias("nmse"))


def two_means_converged(spark, sf_dir):
    """Lloyd to convergence."""
    df = _rotated(spark, sf_dir).withColumn("m", quant.two_means(F.col("y"), None))
    return df.select("vec_id", "m.n0", "m.n1", _r("m.c0").alias("c0"), _r("m.c1").alias("c1"))


def split_at_mean_encode(spark, sf_dir):
    df = codecs.split_encode(tables.vectors(spark, sf_dir), D)
    return df.select("vec_id", _r("msg.c0").alias("c0"), _r("msg.c1").alias("c1"), "msg.n0", "msg.n1")


def _quantised(spark, sf_dir):
    """(bits, normalisation, vec_id, nmse, levels) for 12 widths and two ranges, all from one rotation of each vector."""
    df = _rotated(spark, sf_dir).withColumn("u", quant.uniforms(F.col("y"), F.concat_ws(".", F.col("client").cast("string"), F.col("vec_id").cast("string"))))
    grid = []
    for norm in ("minmax", "sqrt2norm"):
        low, span = quant.quantiser_range(F.col("y"), norm)
        df = df.withColumn(f"low_{norm}", low).withColumn(f"span_{norm}", span)
        for b in range(1, 13):
            grid.append(F.struct(F.lit(b).alias("bits"), F.lit(norm).alias("normalisation"), F.col(f"low_{norm}").alias("low"), F.col(f"span_{norm}").alias("span"),
                                 quant.levels_from(F.col("y"), F.col("u"), F.col(f"low_{norm}"), F.col(f"span_{norm}"), b).alias("levels")))
    rows = df.select("vec_id", "y", F.explode(F.array(*grid)).alias("q")).select("vec_id", "y", "q.*")
    back = vec.let(lambda s: F.transform(s["levels"], lambda q: s["low"] + s["span"] * q / s["top"]), levels=F.col("levels"), low=F.col("low"), span=F.col("span"), top=F.pow(F.lit(2.0), F.col("bits")) - 1)
    return rows.withColumn("nmse", estimate.nmse(F.col("y"), back))


def entropy_nmse(spark, sf_dir):
    return _quantised(spark, sf_dir).groupBy("bits", "normalisation").agg(_r(F.avg("nmse")).alias("nmse"))


def entropy_bits(spark, sf_dir):
    hist = quant.histogram(_quantised(spark, sf_dir), ["bits", "normalisation"], "levels")
    return quant.entropy_bits(hist, ["bits", "normalisation"]).select("bits", "normalisation", "n_symbols", _r("entropy").alias("entropy"))


def huffman_bits(spark, sf_dir):
    hist = quant.histogram(_quantised(spark, sf_dir), ["bits", "normalisation"], "levels")
    coded = quant.huffman_bits(hist.withColumnRenamed("bits", "width"), ["width", "normalisation"])
    return coded.select(F.col("width").alias("bits"), "normalisation", _r(F.col("bits") / F.col("n_symbols")).alias("bits_per_coordinate"))


def terngrad_layered(spark, sf_dir):
    layers = [40, 24]
    df = codecs.terngrad_layered_decode(codecs.terngrad_layered_encode(tables.vectors(spark, sf_dir), D, layers, row="vec_id"), D, layers)
    return df.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"), _r(vec.total(F.col("xhat")), 4).alias("total"))


def _urr(two_level: bool):
    def query(spark, sf_dir):
        r = codecs.haar_rotation(D)
        df = codecs.urr_decode(codecs.urr_encode(tables.vectors(spark, sf_dir), r, two_level=two_level), r, two_level)
        return df.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"))

    return query


def bitpack(spark, sf_dir):
    df = codecs.sign_encode(tables.vectors(spark, sf_dir), D).withColumn("w", quant.pack(F.col("msg.bits"), D))
    word = F.get("w", F.lit(0))
    return df.select("vec_id", word.bitwiseAND(F.lit(2**32 - 1)).alias("low"), F.shiftrightunsigned(word, 32).alias("high"), (quant.unpack(F.col("w"), D) == F.col("msg.bits")).alias("round_trip"))


def size_gated(spark, sf_dir):
    """Vectors of 16 to 64 coordinates (by vec_id); those of more than 32 are sent by the sign codec, the others as they are."""
    v = tables.vectors(spark, sf_dir).withColumn("x", F.slice("x", F.lit(1), (F.pmod("vec_id", F.lit(49)) + 16).cast("int")))
    df = codecs.size_gated(v, "sign", D, threshold=32, row="vec_id")
    return df.select("vec_id", F.size("xhat").alias("n"), _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"))


def random_zero(spark, sf_dir):
    """Signs of the embeddings' coordinates rounded to tenths, of which many are 0 and fall by a coin, and their scale."""
    v = tables.vectors(spark, sf_dir).withColumn("y", F.transform("x", lambda c: F.rint(c * 10) / 10))
    v = v.withColumn("bits", quant.sign_bits_random_zero(F.col("y"), F.concat_ws(".", F.col("client").cast("string"), F.col("vec_id").cast("string"))))
    return v.select("vec_id", _r(quant.unbiased_scale(F.col("y"), quant.signs_of(F.col("bits"))), 4).alias("scale"), _bits("bits"))


def packed_kashin(spark, sf_dir):
    """The Kashin codec with its bits packed on the way."""
    p = vec.kashin_dim(D)
    df = codecs.packed(codecs.kashin_encode(tables.vectors(spark, sf_dir), D, row="vec_id"), p)
    back = codecs.kashin_decode(codecs.unpacked(df, p), D)
    return back.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"), _r(vec.total(F.col("xhat")), 4).alias("total"))


def packed_terngrad(spark, sf_dir):
    """Clipped ternary values with magnitudes and signs packed on the way."""
    df = codecs.packed_ternary(codecs.terngrad_encode(tables.vectors(spark, sf_dir), D, row="vec_id", variant="population"), D)
    back = codecs.terngrad_decode(codecs.unpacked_ternary(df, D), D)
    return back.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"), _r(vec.total(F.col("xhat")), 4).alias("total"))


def report_cells(spark, sf_dir):
    """Norms by label written as "mean, deviation" cells of a report and read back."""
    norms = tables.vectors(spark, sf_dir).select("label", _r(vec.norm2_squared(F.col("x"))).alias("s"))
    cells = norms.groupBy("label").agg(F.concat_ws(", ", F.round(F.avg("s"), 4).cast("string"), F.round(F.stddev_samp("s"), 4).cast("string")).alias("cell"))
    return tables.parse_pairs(cells, "cell", ("mean", "std")).select("label", "mean", "std")


def count_sketch(spark, sf_dir):
    return sketch.sketch(tables.user_values(spark, sf_dir), "user_id", "value", **SKETCH).select("row", "bucket", _r("value", 4).alias("value"))


def part_sketch(spark, sf_dir):
    return sketch.sketch(tables.table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", 3, 211).select("row", "bucket", _r("value", 4).alias("value"))


def unsketch_topk(spark, sf_dir):
    users = tables.user_values(spark, sf_dir)
    table = sketch.sketch(users, "user_id", "value", **SKETCH)
    top = sketch.abs_top_k(sketch.unsketch(table, users, "user_id", **SKETCH).withColumn("estimate", _r("estimate", 4)), "user_id", "estimate", 20)
    return top.select("user_id", "estimate")


def fetchsgd(spark, sf_dir):
    """Two steps, the gradient of each being the values of half a month; the second update."""
    users = tables.user_values(spark, sf_dir)
    empty = spark.createDataFrame([], "row int, bucket long, value double")
    m, e, update = empty, empty, None
    for part in ("day < DATE '2024-01-16'", "day >= DATE '2024-01-16'"):
        g = sketch.sketch(users.where(part), "user_id", "value", **SKETCH).withColumn("value", F.round("value", 6))
        update, m, e = sketch.fetch_step(m, e, g, users, "user_id", k=10, **SKETCH)
    return update.select("user_id", _r("value", 4).alias("value"))


def _model(spark, values: np.ndarray) -> DataFrame:
    rows = [(c, i, float(v)) for c, row in enumerate(values) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, i int, value double").select("cluster", "i", _r("value").alias("value"))


def _kmeans(rounds: int, codec: str):
    def query(spark, sf_dir):
        return _model(spark, workloads.kmeans(tables.vectors(spark, sf_dir, 10), 10, D, rounds, codec)[0])

    return query


def _power(rounds: int, codec: str, lr: float):
    def query(spark, sf_dir):
        v, _ = workloads.power_iteration(tables.vectors(spark, sf_dir, 10), D, rounds, codec, lr)
        return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, value double").select("i", _r("value").alias("value"))

    return query


def _federated(codec: str, weighted: bool):
    def query(spark, sf_dir):
        return _model(spark, workloads.federated_round(tables.vectors(spark, sf_dir, 10), np.zeros((10, D + 1)), codec, 1.0, weighted))

    return query


def kmeans_objective(spark, sf_dir):
    """Sum of squared distances to the centres before each of three rounds."""
    _, history = workloads.kmeans(tables.vectors(spark, sf_dir, 10), 10, D, 3)
    return spark.createDataFrame(list(enumerate(history)), "round int, objective double").select("round", _r("objective", 4).alias("objective"))


def power_trace(spark, sf_dir):
    """Eigenvalue and error of each of three rounds with sign messages and feedback."""
    _, history = workloads.power_iteration(tables.vectors(spark, sf_dir, 10), D, 3, "sign", 0.5)
    rows = [(k, value, error) for k, (value, error) in enumerate(history)]
    return spark.createDataFrame(rows, "round int, value double, error double").select("round", _r("value", 4).alias("value"), _r("error", 4).alias("error"))


def _training(codec: str):
    """Three rounds of momentum steps by ten clients' gradients: the weights."""
    def query(spark, sf_dir):
        return _model(spark, workloads.training(tables.vectors(spark, sf_dir, 10), 10, D, 3, codec)[0])

    return query


def training_accuracy(spark, sf_dir):
    """Accuracy after each of three rounds."""
    _, history = workloads.training(tables.vectors(spark, sf_dir, 10), 10, D, 3)
    return spark.createDataFrame(list(enumerate(history)), "round int, accuracy double").select("round", _r("accuracy").alias("accuracy"))


def fetchsgd_variables(spark, sf_dir):
    """Two steps over two variables, the gradients of each being the values of half a month: by user sketched as its size
    asks, by hour of the day as it is. The second update."""
    e = tables.table(spark, sf_dir, "events")
    keys = {"user": F.col("user_id"), "hour": F.hour("ts").cast("long")}
    size = {name: int(e.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0]) for name, c in keys.items()}
    specs = {name: sketch.spec(n, k=10, size_threshold=24) for name, n in size.items()}
    state, update = {}, None
    for part in ("ts < TIMESTAMP_NTZ '2024-01-16'", "ts >= TIMESTAMP_NTZ '2024-01-16'"):
        gradients = {name: e.where(part).select(c.alias("key"), "value") for name, c in keys.items()}
        update, state = sketch.spec_step(specs, state, gradients)
    return update.select("variable", "key", _r("value", 4).alias("value"))


def sketch_mean(spark, sf_dir):
    """Mean of the users' values over days as clients, from one summed sketch; the 20 largest."""
    means = sketch.mean_of_sketches(tables.user_values(spark, sf_dir), "user_id", "value", "day", **SKETCH).withColumn("estimate", _r("estimate", 4))
    return sketch.abs_top_k(means, "user_id", "estimate", 20)


def packed_sign(spark, sf_dir):
    """The sign codec with its bits packed on the way."""
    df = codecs.packed(codecs.sign_encode(tables.vectors(spark, sf_dir), D), D)
    back = codecs.sign_decode(codecs.unpacked(df, D), D)
    return back.select("vec_id", _r(estimate.nmse(F.col("x"), F.col("xhat"))).alias("nmse"), _r(vec.total(F.col("xhat")), 4).alias("total"))


def table_nmse(spark, sf_dir):
    """Mean and deviation of the error of ten clients' mean by dimension and codec, over 10 synthetic lognormal vectors each."""
    out = None
    for d in (128, 1024, 8192):
        v = tables.synthetic(spark, "lognormal", d, 10).withColumn("client", F.explode(F.sequence(F.lit(0), F.lit(9))))
        for name in ("sign", "two_means", "hadamard_sq", "kashin_sq"):
            error = estimate.estimate_error(codecs.round_trip(v, name, d, row="trial"), ["trial"])
            part = error.select(F.lit(d).alias("dim"), F.lit(name).alias("codec"), "nmse")
            out = part if out is None else out.unionByName(part)
    return estimate.trials(out, ["dim", "codec"]).select("dim", "codec", _r("mean", 5).alias("mean"), _r("std", 5).alias("std"), "trials")


def accuracy_epochs(spark, sf_dir):
    """Hourly share of purchases as a percentage, hours 100 to 200 of the series: the shape of an accuracy curve's cut-out."""
    e = tables.table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).alias("hour")
    share = e.select(hour, (F.col("event_type") == "purchase").cast("long").alias("p")).groupBy("hour").agg((F.sum("p") / F.count("p")).alias("share"))
    return estimate.epochs(share, "hour", 100, 200, "share", 100.0).select("hour", _r("share").alias("share"))


def codec_report(spark, sf_dir):
    """Mean NMSE by dimension and codec over 50 synthetic lognormal vectors each, one column per codec."""
    names = ["sign", "two_means", "hadamard_sq", "kashin_sq", "terngrad"]
    out = None
    for d in (16, 64, 128):
        v = tables.synthetic(spark, "lognormal", d, 50).withColumn("client", F.lit(0))
        for name in names:
            part = codecs.round_trip(v, name, d, row="trial").select(F.lit(d).alias("dim"), F.lit(name).alias("codec"), estimate.nmse(F.col("x"), F.col("xhat")).alias("nmse"))
            out = part if out is None else out.unionByName(part)
    means = out.groupBy("dim", "codec").agg(_r(F.avg("nmse")).alias("nmse"))
    return estimate.report(means, "dim", "codec", "nmse", names)


def figure_nmse(spark, sf_dir):
    """Closed-form NMSE of the sign and the two-means codec by distribution and dimension, 4 to 2048, over 40 vectors each."""
    out = None
    for d in (2**k for k in range(2, 12)):
        v = None
        for dist in ("lognormal", "normal", "exponential"):
            part = tables.synthetic(spark, dist, d, 40).select(F.lit(dist).alias("distribution"), F.lit(0).alias("client"), "x")
            v = part if v is None else v.unionByName(part)
        y = vec.held(codecs.rotate(v, "x", "y", d), "m", quant.two_means(F.col("y")))
        each = F.array(F.struct(F.lit("sign").alias("codec"), estimate.sign_nmse(F.col("y")).alias("nmse")), F.struct(F.lit("two_means").alias("codec"), estimate.two_means_nmse(F.col("y"), F.col("m")).alias("nmse")))
        rows = y.select("distribution", F.lit(d).alias("dim"), F.inline(each))
        out = rows if out is None else out.unionByName(rows)
    return estimate.trials(out, ["distribution", "dim", "codec"]).select("distribution", "dim", "codec", _r("mean", 5).alias("mean"), _r("std", 5).alias("std"))


def rolling_metric(spark, sf_dir):
    hourly = tables.table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return estimate.rolling_mean(hourly, "hour", "cents", 24, ["event_type"]).select("event_type", "hour", _r("rolling").alias("rolling"))


def streaming_sketch(spark, sf_dir):
    """The daily count sketches of the events, computed as a stream that is run until its input ends; rows may be a month late."""
    batch = tables.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = sketches.run_once(sketches.windowed_sketch(stream, "user_id", "value", "ts", "1 day", "31 days", 3, 31), ["window_start", "row", "bucket"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "row", "bucket", _r("value", 4).alias("value"))


QUERIES = {
    "sign_encode": sign_encode, "sign_nmse": sign_nmse, "two_means_encode": two_means_encode, "two_means_nmse": two_means_nmse, "two_means_converged": two_means_converged,
    "split_at_mean_encode": split_at_mean_encode,
    **{f"{n}_roundtrip": _round_trip(n) for n in ("identity", "sign", "sign_coin", "two_means", "split_at_mean", "hadamard_sq", "kashin_sq", "terngrad", "terngrad_clipped", "terngrad_population", "hadamard_4bit", "two_means_lloyd")},
    "terngrad_layered_roundtrip": terngrad_layered, "urr_sign": _urr(False), "urr_two_means": _urr(True), "bitpack": bitpack, "size_gated_encode": size_gated,
    "mean_estimate": mean_estimate, "mean_of_ten_clients": mean_of_ten_clients,
    "entropy_nmse": entropy_nmse, "entropy_bits": entropy_bits, "huffman_bits": huffman_bits,
    "count_sketch": count_sketch, "part_sketch": part_sketch, "unsketch_topk": unsketch_topk, "fetchsgd": fetchsgd, "streaming_sketch": streaming_sketch,
    "kmeans_round": _kmeans(1, "identity"), "kmeans_3_rounds": _kmeans(3, "identity"), "kmeans_round_sign": _kmeans(1, "sign"), "kmeans_round_two_means": _kmeans(1, "two_means"),
    "power_iteration_2": _power(2, "identity", 1.0), "power_iteration_feedback_2": _power(2, "sign", 0.5),
    "federated_round": _federated("identity", True), "federated_round_unweighted": _federated("identity", False), "federated_round_sign": _federated("sign", True),
    "kmeans_objective": kmeans_objective, "power_trace": power_trace, "training_3_rounds": _training("identity"), "training_3_rounds_sign": _training("sign"),
    "training_accuracy": training_accuracy, "fetchsgd_variables": fetchsgd_variables, "random_zero": random_zero, "packed_kashin": packed_kashin,
    "packed_terngrad": packed_terngrad, "report_cells": report_cells, "sketch_mean": sketch_mean, "packed_sign": packed_sign, "table_nmse": table_nmse, "accuracy_epochs": accuracy_epochs,
    "codec_report": codec_report, "figure_nmse": figure_nmse, "rolling_metric": rolling_metric,
}
