"""Vector functions and quantisers: identities and edge cases."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import prng, quant, vec
from vecloom.operators.sketch import next_prime


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, x array<double>")


def hadamard(d):
    return np.array([[(-1) ** bin(i & j).count("1") for j in range(d)] for i in range(d)]) / math.sqrt(d)


@pytest.mark.parametrize("d", [1, 2, 8, 64, 128, 1024])
def test_fwht(spark, d):
    x = np.random.default_rng(d).normal(size=(5, d))
    df = vec.with_fwht(frame(spark, x), "y", F.col("x"), d)
    got = np.array([r.y for r in df.orderBy("id").collect()])
    assert np.allclose(got, x @ hadamard(d))
    twice = np.array([r.z for r in vec.with_fwht(df, "z", F.col("y"), d).orderBy("id").collect()])
    assert np.allclose(twice, x) and np.allclose((got**2).sum(1), (x**2).sum(1))


def test_kernels_agree(spark):
    x = np.random.default_rng(0).normal(size=(5, 64))
    a, b = np.array([(r.a, r.b) for r in frame(spark, x).select(vec.fwht_expression(F.col("x"), 64).alias("a"), vec.fwht_kernel("x").alias("b")).collect()]).transpose(1, 0, 2)
    assert np.array_equal(a, b)


def test_fwht_wants_a_power_of_two():
    with pytest.raises(ValueError):
        vec.fwht(None, 12)


def test_prng_contract(spark):
    got = spark.range(3).select(prng.signs(F.lit(7), 40).alias("s"), prng.uniform(prng.ROUNDING, F.lit("a"), F.lit(3)).alias("u")).first()
    h = lambda k: hashlib.md5(k.encode()).hexdigest()
    assert got.s == [1.0 if h(f"42:0:7:{i // 32}")[i % 32] < "8" else -1.0 for i in range(40)]
    assert got.u == int(h("42:1:a:0")[24:32], 16) / 2**32


def test_dimensions():
    assert [vec.next_power(n) for n in (1, 2, 3, 640)] == [1, 2, 4, 1024]
    assert [vec.kashin_dim(n) for n in (64, 48, 60, 1)] == [128, 64, 128, 2]
    assert [next_prime(n) for n in (0, 2, 31, 97)] == [2, 3, 37, 101]


def lloyd(x, rounds):
    low = x < x.mean()
    for _ in range(rounds):
        if not 0 < low.sum() < len(x):
            break
        low = x < (x[low].mean() + x[~low].mean()) / 2
    whole = not 0 < low.sum() < len(x)
    return (x.mean(), x.mean()) if whole else (x[low].mean(), x[~low].mean())


@pytest.mark.parametrize("rounds", [0, 1, 3, 20])
def test_two_means(spark, rounds):
    x = np.vstack([np.random.default_rng(rounds).normal(size=(20, 33)), np.full((1, 33), 2.0), np.zeros((1, 33)), np.eye(33)[:1], -np.abs(np.random.default_rng(1).normal(size=(1, 33)))])
    got = [r.m for r in frame(spark, x).select("id", quant.two_means(F.col("x"), rounds).alias("m")).orderBy("id").collect()]
    assert np.allclose([(m.c0, m.c1) for m in got], [lloyd(r, rounds) for r in x]) and all(m.n0 + m.n1 == 33 for m in got)


def test_degenerate_vectors(spark):
    rows = [[0.0] * 8, [3.0] * 8, [1.0] + [0.0] * 7, [-1.0] * 8]
    df = frame(spark, rows)
    got = df.select(quant.sign_scale(F.col("x")).alias("s"), quant.stochastic_levels(F.col("x"), F.lit("e")).alias("q"), quant.spread(F.col("x"), True).alias("sd"), quant.ternary(F.col("x"), quant.largest(F.col("x")), F.lit("e")).alias("t")).collect()
    assert [r.s for r in got] == [0.0, 3.0, 1.0, 1.0]
    assert got[0].q == got[1].q == [0] * 8 and got[0].t == [0] * 8 and got[1].t == [1] * 8 and got[3].t == [-1] * 8 and got[0].sd == 0.0
    one = spark.createDataFrame([([5.0],)], "x array<double>").select(quant.spread(F.col("x"), True).alias("a"), vec.fwht(F.col("x"), 1).alias("b")).first()
    assert (one.a, one.b) == (0.0, [5.0])


def test_random_zero(spark):
    df = frame(spark, [[0.0] * 64 + [1.0, -1.0]])
    bits = df.select(quant.sign_bits_random_zero(F.col("x"), F.lit("z")).alias("b")).first().b
    assert 10 < sum(bits[:64]) < 54 and bits[64:] == [1, 0]


def test_stochastic_rounding_is_unbiased(spark):
    df = spark.range(4000).select(F.array(F.lit(0.0), F.lit(0.3), F.lit(1.0)).alias("x"), F.col("id").cast("string").alias("e"))
    got = df.select(quant.stochastic_levels(F.col("x"), "e").alias("q")).agg(F.avg(F.col("q")[1])).first()[0]
    assert abs(got - 0.3) < 0.03


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=130))
def test_pack(spark, bits):
    d = len(bits)
    df = spark.createDataFrame([(bits,)], "b array<int>").withColumn("w", quant.pack(F.col("b"), d))
    r = df.select("w", quant.unpack(F.col("w"), d).alias("b")).first()
    assert r.b == bits and len(r.w) == math.ceil(d / 64) and r.w[0] & 1 == bits[0]


def test_entropy_and_huffman(spark):
    symbols = [0] * 8 + [1] * 4 + [2] * 2 + [7] * 2
    hist = quant.histogram(spark.createDataFrame([("a", symbols), ("b", [5, 5])], "k string, s array<int>"), ["k"], "s")
    e = {r.k: r.entropy for r in quant.entropy_bits(hist, ["k"]).collect()}
    h = {r.k: (r.n_symbols, r.bits) for r in quant.huffman_bits(hist, ["k"]).collect()}
    assert e == {"a": 1.75, "b": 0.0} and h == {"a": (16, 28), "b": (2, 2)}


def test_unknown_normalisation():
    with pytest.raises(ValueError):
        quant.quantiser_range(None, "other")
