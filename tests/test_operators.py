"""Codecs, estimation, sketches and workloads: invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import quant, vec
from vecloom.operators import codecs, estimate, sketch, workloads
from vecloom.sources import tables
from vecloom.streaming import sketches


def vectors(spark, rows, clients=3):
    return spark.createDataFrame([(i, i % clients, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, client int, x array<double>")


def decoded(df):
    rows = df.orderBy("vec_id").collect()
    return np.array([r.x for r in rows]), np.array([r.xhat for r in rows])


@pytest.mark.parametrize("name", list(codecs.CODECS))
@pytest.mark.parametrize("d", [16, 48, 128])
def test_round_trips(spark, name, d):
    x = np.vstack([np.random.default_rng(d).normal(size=(6, d)), np.zeros((1, d)), np.full((1, d), -2.0), np.eye(d)[:1]])
    a, b = decoded(codecs.round_trip(vectors(spark, x), name, d, row="vec_id"))
    assert b.shape == a.shape and np.isfinite(b).all() and np.allclose(b[6], 0)
    if name == "identity":
        assert np.array_equal(a, b)
    if name in ("sign", "two_means", "split_at_mean") and vec.is_power(d):
        assert np.allclose((a * b).sum(1), (a * a).sum(1), atol=1e-6)


def test_closed_forms_are_the_real_errors(spark):
    df = vectors(spark, np.random.default_rng(0).normal(size=(8, 64)))
    real = {r.vec_id: r.e for r in codecs.round_trip(df, "sign", 64).select("vec_id", estimate.nmse(F.col("x"), F.col("xhat")).alias("e")).collect()}
    closed = {r.vec_id: r.e for r in codecs.rotate(df, "x", "y", 64).select("vec_id", estimate.sign_nmse(F.col("y")).alias("e")).collect()}
    assert all(abs(real[k] - closed[k]) < 1e-7 for k in real)


def test_mean_over_clients_lowers_the_error(spark):
    x = np.random.default_rng(1).normal(size=(10, 64))
    df = vectors(spark, x).drop("client").withColumn("client", F.explode(F.sequence(F.lit(0), F.lit(9))))
    sent = codecs.round_trip(df, "sign", 64)
    one = sent.agg(F.avg(estimate.nmse(F.col("x"), F.col("xhat")))).first()[0]
    ten = estimate.estimate_error(sent, ["vec_id"]).agg(F.avg("nmse")).first()[0]
    assert 0.4 < one < 0.7 and ten < one / 6


def test_weighted_mean(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [4.0, 5.0], 2.0), ("b", [1.0, 1.0], 0.0), ("c", None, 1.0), ("a", [9.0, 9.0], None)], "k string, xhat array<double>, w double")
    got = {(r.k, r.i): r["mean"] for r in estimate.mean_estimate(df, ["k"], weight="w").collect()}
    assert got == {("a", 0): 3.0, ("a", 1): 4.0, ("b", 0): 0.0, ("b", 1): 0.0}


def test_rotation_is_orthogonal():
    r = codecs.haar_rotation(24)
    assert np.allclose(r @ r.T, np.eye(24)) and np.linalg.det(r) > 0
    with pytest.raises(ValueError):
        codecs.haar_rotation(1 << 13)


def test_registry():
    with pytest.raises(ValueError):
        codecs.codec("nothing")
    assert codecs.codec("kashin_sq").bits(64) == 2 and codecs.codec("sign").bits(48) == 64 / 48
    with pytest.raises(ValueError):
        codecs.terngrad_layered_encode(None, 4, [1, 2])


def test_size_gate(spark):
    df = vectors(spark, np.random.default_rng(2).normal(size=(3, 16)))
    small, large = (decoded(codecs.size_gated(df, "sign", 16, threshold=t)) for t in (16, 15))
    assert np.array_equal(*small) and not np.allclose(*large)


def test_size_gate_by_row(spark):
    df = spark.createDataFrame([(0, 0, [1.0, -2.0]), (1, 0, [3.0] * 4), (2, 0, None), (3, 0, [])], "vec_id long, client int, x array<double>")
    got = {r.vec_id: r.xhat for r in codecs.size_gated(df, "sign", 8, threshold=2).collect()}
    assert got[0] == [1.0, -2.0] and len(got[1]) == 4 and got[2] is None and got[3] == []


def test_packed_messages(spark):
    df = vectors(spark, np.vstack([np.random.default_rng(4).normal(size=(4, 100)), np.zeros((1, 100))]))
    sent = codecs.terngrad_encode(df, 100, row="vec_id")
    packed = codecs.packed_ternary(sent, 100)
    assert [len(r.msg.words) + len(r.msg.signs) for r in packed.collect()] == [4] * 5
    assert [r.msg.bits for r in codecs.unpacked_ternary(packed, 100).orderBy("vec_id").collect()] == [r.msg.bits for r in sent.orderBy("vec_id").collect()]


def test_coin_of_zeros(spark):
    y = np.array([[0.0] * 256, [1.0, -1.0] * 128])
    rows = vectors(spark, y).withColumn("b", quant.sign_bits_random_zero(F.col("x"), F.col("vec_id"))).orderBy("vec_id").collect()
    assert 90 < sum(rows[0].b) < 166 and rows[1].b == [1, 0] * 128


def test_specs_of_variables(spark):
    g = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, -9.0), (None, 1.0)], "key long, value double")
    update, state = sketch.spec_step({"small": None, "large": {"rows": 5, "cols": 97, "momentum": 0.9, "lr": 1.0, "k": 1}}, {}, {"small": g, "large": g})
    assert {(r.variable, r.key, r.value) for r in update.collect()} == {("small", 1, 6.0), ("small", 2, -9.0), ("large", 2, -9.0)} and set(state) == {"large"}


def test_training_learns(spark):
    rows = [(i, i % 2, i % 2, [1.0 if i % 2 else -1.0, 0.3]) for i in range(12)]
    points = spark.createDataFrame(rows, "vec_id long, client int, label int, x array<double>")
    _, history = workloads.training(points, 2, 2, 2, "identity")
    assert history[-1] == 100.0


def test_sketch_is_linear(spark):
    a = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    b = spark.range(100, 300).select(F.col("id").alias("k"), F.lit(2.0).alias("v"))
    both = {(r.row, r.bucket): r.value for r in sketch.sketch(a.union(b), "k", "v", 3, 31).collect()}
    merged = {(r.row, r.bucket): r.value for r in sketch.merge(sketch.sketch(a, "k", "v", 3, 31), sketch.sketch(b, "k", "v", 3, 31)).collect()}
    assert both.keys() == merged.keys() and all(abs(both[k] - merged[k]) < 1e-9 for k in both)


def test_heavy_keys_are_found(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") < 5, 1000.0 * (F.col("id") + 1)).otherwise(1.0).alias("v"))
    table = sketch.sketch(df, "k", "v", 5, 97)
    top = sketch.abs_top_k(sketch.unsketch(table, df, "k", 5, 97), "k", "estimate", 5).collect()
    assert {r.k for r in top} == {0, 1, 2, 3, 4} and all(abs(r.estimate - 1000 * (r.k + 1)) < 100 for r in top)
    empty = spark.createDataFrame([], "row int, bucket long, value double")
    update, _, error = sketch.fetch_step(empty, empty, table, df, "k", 5, 97, 5)
    assert {r.k for r in update.collect()} == {0, 1, 2, 3, 4} and error.agg(F.max(F.abs("value"))).first()[0] < 100


def test_top_k_by_group(spark):
    df = spark.createDataFrame([("a", 1, -5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 1, 0.0)], "g string, k int, v double")
    assert sorted((r.g, r.k) for r in sketch.abs_top_k(df, "k", "v", 1, ("g",)).collect()) == [("a", 1), ("b", 1)]


def test_spec():
    assert sketch.spec(100) is None and sketch.spec(32_000)["cols"] == 1009 and sketch.spec(32_000, cols=7)["cols"] == 7


@pytest.mark.parametrize("codec", ["identity", "sign"])
def test_kmeans_lowers_its_objective(spark, codec):
    r = np.random.default_rng(4)
    points = vectors(spark, np.vstack([r.normal(c, 0.1, size=(20, 8)) for c in (-0.5, 0.5)]), 4)
    centres, history = workloads.kmeans(points, 3, 8, 4, codec)
    assert centres.shape == (3, 8) and history[-1] < history[0]
    if codec == "identity":
        used = np.abs(centres).sum(1) > 0
        assert min(np.abs(centres[used] - 0.5).max(1)) < 0.2


def test_kmeans_counts_no_null_points(spark):
    x = np.random.default_rng(10).normal(size=(12, 8))
    points = vectors(spark, x, 4)
    null = spark.createDataFrame([(99, 1, None)], points.schema)
    (centres, history), (same, other) = (workloads.kmeans(p, 3, 8, 2) for p in (points, points.unionByName(null)))
    assert np.allclose(centres, same) and np.allclose(history, other)
    start = workloads.start_centres(3, 8)
    assert np.isclose(history[0], ((x[:, None] - start) ** 2).sum(2).min(1).sum())


def test_two_means_go_on_until_convergence(spark):
    x = [[1.0 + 1.07**k for k in range(300)], [], [2.0, 2.0]]  # a long tail takes many steps
    df = spark.createDataFrame([(v,) for v in x], "y array<double>")
    got = [(r.n0, r.n1) for r in df.select(quant.two_means(F.col("y"), None).alias("m")).select("m.*").collect()]
    v, n0 = np.array(x[0]), -1
    cut = v.mean()
    while n0 != (n0 := int((v < cut).sum())):
        cut = (v[v < cut].mean() + v[v >= cut].mean()) / 2
    assert got[0] == (n0, 300 - n0) and sum(got[1]) == 0 and sum(got[2]) == 2


def test_power_iteration_finds_the_leading_direction(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 8)) * np.array([5, 1, 1, 1, 1, 1, 1, 1])
    v, history = workloads.power_iteration(vectors(spark, x, 4), 8, 6)
    assert abs(v[0]) > 0.97 and history[-1][1] < history[0][1]


def test_federated_training_fits(spark):
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(c, 0.3, size=(15, 4)) for c in (-1, 1)])
    points = vectors(spark, x).withColumn("label", (F.col("vec_id") >= 15).cast("int"))
    w = np.zeros((2, 5))
    for _ in range(3):
        w = workloads.federated_round(points, w)
    assert workloads.accuracy(points, w) == 100.0
    p, velocity = workloads.sgd_step(np.ones(2), np.ones(2), np.zeros(2), 0.1)
    assert np.allclose(p, 1 - 0.1 * 1.0005) and np.allclose(velocity, 1.0005)


def test_sources(spark, tmp_path, sf_dir):
    assert tables.vectors(spark, sf_dir, 10).agg(F.max("client")).first()[0] == 9
    assert [r.client for r in tables.contiguous_clients(spark.range(11), "id", 3, 11).orderBy("id").collect()] == [0] * 3 + [1] * 3 + [2] * 3
    got = np.array([r.x for r in tables.synthetic(spark, "normal", 64, 50).collect()])
    assert abs(got.mean()) < 0.1 and abs(got.std() - 1) < 0.1
    assert (np.array([r.x for r in tables.synthetic(spark, "exponential", 8, 5).collect()]) >= 0).all()
    with pytest.raises(ValueError):
        tables.synthetic(spark, "other", 4, 1)
    (tmp_path / "m.csv").write_text("round,acc,other\n1,0.5,x\n2,bad,y\n")
    assert [r.acc for r in tables.metrics_csv(spark, f"file://{tmp_path}/m.csv", ["acc"]).collect()] == [0.5, None]
    cell = spark.createDataFrame([("0.12, 0.03",), ("x",)], "c string")
    assert [(r.a, r.b) for r in tables.parse_pairs(cell, "c", ("a", "b")).collect()] == [(0.12, 0.03), (None, None)]
    tables.write_results(cell, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_rolling_mean_and_report(spark):
    df = spark.range(5).select(F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    assert [r.rolling for r in estimate.rolling_mean(df, "t", "v", 3).orderBy("t").collect()] == [None, None, 1.0, 2.0, 3.0]
    r = estimate.report(spark.createDataFrame([(4, "a", 1.0), (4, "b", 2.0), (8, "a", 3.0)], "d int, c string, v double"), "d", "c", "v", ["a", "b"]).orderBy("d").collect()
    assert [tuple(x) for x in r] == [(4, 1.0, 2.0), (8, 3.0, None)]


def test_streams(spark, tmp_path):
    spark.range(40).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 5).alias("k"), F.lit(1.0).alias("v")).repartition(3).write.parquet(f"file://{tmp_path}/in")
    batch = spark.read.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = {(r.window_start, r.row, r.bucket): r.value for r in sketches.run_once(sketches.windowed_sketch(stream, "k", "v", "ts", "1 day", "2 days", 2, 7), ["window_start", "row", "bucket"]).collect()}
    want = {(r.d, r.row, r.bucket): r.value for r in sketch.sketch(batch.withColumn("d", F.date_trunc("day", "ts")), "k", "v", 2, 7, ("d",)).collect()}
    assert got == want
    spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "k string, x array<double>").write.parquet(f"file://{tmp_path}/v")
    s = spark.readStream.schema("k string, x array<double>").parquet(f"file://{tmp_path}/v")
    assert {(r.i, r.n, r["mean"]) for r in sketches.run_once(sketches.running_mean(s, "k", "x"), ["k", "i"]).collect()} == {(0, 2, 2.0), (1, 2, 4.0)}


def test_packed_messages_and_timing(spark):
    df = vectors(spark, np.random.default_rng(8).normal(size=(3, 64)))
    sent = codecs.packed(codecs.sign_encode(df, 64), 64)
    assert sent.select("msg.*").columns == ["scale", "words"]
    assert np.array_equal(decoded(codecs.sign_decode(codecs.unpacked(sent, 64), 64))[1], decoded(codecs.round_trip(df, "sign", 64))[1])
    assert codecs.encode_seconds(df, "sign", 64, repeats=1) > 0


def test_more_bits_and_more_steps_are_better(spark):
    df = vectors(spark, np.random.default_rng(9).normal(size=(12, 64)))
    error = lambda name: codecs.round_trip(df, name, 64, row="vec_id").agg(F.avg(estimate.nmse(F.col("x"), F.col("xhat")))).first()[0]
    assert error("hadamard_8bit") < error("hadamard_4bit") < error("hadamard_2bit") < error("hadamard_sq")
    assert error("two_means_lloyd") <= error("two_means") + 1e-9 <= error("sign") + 1e-2


def test_epochs(spark):
    df = spark.range(5).select(F.col("id").alias("e"), F.lit(0.5).alias("v"))
    assert [tuple(r) for r in estimate.epochs(df, "e", 1, 2, "v", 100.0).orderBy("e").collect()] == [(1, 50.0), (2, 50.0)]
