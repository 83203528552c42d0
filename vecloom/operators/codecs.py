"""Codecs: (df with entity and vector columns) -> message struct -> decoded vector.

``encode`` adds the message column ``msg``, ``decode`` reads it back into ``xhat`` and needs nothing but the message and the entity:
rotation and rounding are functions of the seed. The rotation diagonal depends on the entity (a client), rounding on entity and row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prng, quant, vec


def rotate(df: DataFrame, x: str, out: str, d: int, entity: str = "client", size: int | None = None) -> DataFrame:
    """out = H D x over p = size (a power of two, d by default padded) coordinates; D holds the entity's signs."""
    p = size or vec.next_power(d)
    return vec.with_fwht(df, "__h", vec.multiply(vec.pad(F.col(x), p), prng.signs(entity, p)), p).withColumn(out, vec.settle(F.col("__h"))).drop("__h")


def unrotate(df: DataFrame, y: str, out: str, d: int, entity: str = "client", size: int | None = None) -> DataFrame:
    """out = D H y, cut to d coordinates."""
    p = size or vec.next_power(d)
    return vec.with_fwht(df, "__h", F.col(y), p).withColumn(out, F.slice(vec.multiply(F.col("__h"), prng.signs(entity, p)), 1, d)).drop("__h")


@dataclass(frozen=True)
class Codec:
    """``linear``: messages may be summed before they are decoded. ``bits``: sent per coordinate of a d-vector, scalars left out."""

    name: str
    encode: Callable[..., DataFrame]
    decode: Callable[..., DataFrame]
    linear: bool = False
    bits: Callable[[int], float] = lambda d: vec.next_power(d) / d


def _sign(df: DataFrame, y: str = "y") -> Column:
    return F.struct(quant.sign_scale(F.col(y)).alias("scale"), quant.sign_bits(F.col(y)).alias("bits"))


def _two_level(y: str, split: Callable[[Column], Column], df: DataFrame, upper_open: bool) -> DataFrame:
    df = df.withColumn("__m", split(F.col(y))).withColumn("__s", quant.two_means_scale(F.col(y), F.col("__m")))
    bits = vec.let(lambda s: F.transform(s["y"], lambda v: F.when((v > s["cut"]) if upper_open else (v >= s["cut"]), 1).otherwise(0)), y=F.col(y), cut=F.col("__m.cut"))
    return df.withColumn("msg", F.struct((F.col("__s") * F.col("__m.c0")).alias("c0"), (F.col("__s") * F.col("__m.c1")).alias("c1"), F.col("__m.n0").alias("n0"), F.col("__m.n1").alias("n1"), bits.alias("bits"))).drop("__m", "__s")


def sign_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None) -> DataFrame:
    df = rotate(df, x, "__y", d, entity)
    return df.withColumn("msg", _sign(df, "__y")).drop("__y")


def sign_decode(df: DataFrame, d: int, entity: str = "client") -> DataFrame:
    df = df.withColumn("__v", vec.scale(quant.signs_of(F.col("msg.bits")), F.col("msg.scale")))
    return unrotate(df, "__v", "xhat", d, entity).drop("__v")


def two_means_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None, rounds: int | None = 3) -> DataFrame:
    """``rounds`` of Lloyd; None goes on until convergence."""
    return _two_level("__y", lambda y: quant.two_means(y, rounds), rotate(df, x, "__y", d, entity), False).drop("__y")


def split_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None) -> DataFrame:
    return _two_level("__y", quant.split_at_mean, rotate(df, x, "__y", d, entity), True).drop("__y")


def two_level_decode(df: DataFrame, d: int, entity: str = "client") -> DataFrame:
    return unrotate(df.withColumn("__v", quant.lookup(F.col("msg.bits"), F.col("msg.c0"), F.col("msg.c1"))), "__v", "xhat", d, entity).drop("__v")


def _rounding(entity: str, row: str | None) -> Column:
    return F.concat_ws(".", F.col(entity).cast("string"), F.col(row).cast("string")) if row else F.col(entity).cast("string")


def hadamard_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None, bits: int = 1) -> DataFrame:
    """Stochastic quantisation to 2^bits levels between the extremes of the rotated vector."""
    df = rotate(df, x, "__y", d, entity).withColumn("__lo", F.array_min("__y")).withColumn("__sp", F.array_max("__y") - F.array_min("__y"))
    return df.withColumn("msg", F.struct(F.col("__lo").alias("low"), F.col("__sp").alias("span"), quant.stochastic_levels(F.col("__y"), _rounding(entity, row), bits, F.col("__lo"), F.col("__sp")).alias("bits"))).drop("__y", "__lo", "__sp")


def hadamard_decode(df: DataFrame, d: int, entity: str = "client", bits: int = 1) -> DataFrame:
    return unrotate(df.withColumn("__v", quant.dequantise(F.col("msg.bits"), F.col("msg.low"), F.col("msg.span"), bits)), "__v", "xhat", d, entity).drop("__v")


def kashin_coefficients(df: DataFrame, d: int, x: str = "x", out: str = "coef", entity: str = "client", eta: float = 0.9, delta: float = 1.0, threshold: float = 0.85, rounds: int = 3) -> DataFrame:
    """Coefficients of a redundant representation with a small range: each round rotates what is left, clips it, keeps that and takes
    its inverse off; what is left in the end is dropped."""
    p = vec.kashin_dim(d, threshold)
    df = df.withColumn("__d", prng.signs(entity, p)).withColumn("__r", vec.pad(F.col(x), p)).withColumn(out, F.array_repeat(F.lit(0.0), p))
    df = df.withColumn("__m", F.sqrt(vec.norm2_squared(F.col(x))) / float(np.sqrt(delta * p)))
    for k in range(rounds):
        df = vec.with_fwht(df, "__b", vec.multiply(F.col("__r"), F.col("__d")), p).withColumn("__b", vec.clip(F.col("__b"), F.col("__m")))
        df = df.withColumn(out, vec.add(F.col(out), F.col("__b"))).withColumn("__m", F.col("__m") * eta)
        if k < rounds - 1:
            df = vec.with_fwht(df, "__h", F.col("__b"), p).withColumn("__r", vec.subtract(F.col("__r"), vec.multiply(F.col("__h"), F.col("__d"))))
    return df.drop("__d", "__r", "__m", "__b", "__h")


def kashin_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None, **kashin) -> DataFrame:
    df = kashin_coefficients(df, d, x, "__y", entity, **kashin).withColumn("__y", vec.settle(F.col("__y")))
    df = df.withColumn("__lo", F.array_min("__y")).withColumn("__sp", F.array_max("__y") - F.array_min("__y"))
    return df.withColumn("msg", F.struct(F.col("__lo").alias("low"), F.col("__sp").alias("span"), quant.stochastic_levels(F.col("__y"), _rounding(entity, row), 1, F.col("__lo"), F.col("__sp")).alias("bits"))).drop("__y", "__lo", "__sp")


def kashin_decode(df: DataFrame, d: int, entity: str = "client", threshold: float = 0.85) -> DataFrame:
    p = vec.kashin_dim(d, threshold)
    return unrotate(df.withColumn("__v", quant.dequantise(F.col("msg.bits"), F.col("msg.low"), F.col("msg.span"))), "__v", "xhat", d, entity, p).drop("__v")


def terngrad_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None, variant: str = "vanilla", clip: float = 2.5) -> DataFrame:
    """Ternary values. ``vanilla``: by the largest magnitude; ``clipped``: clipped at clip sample deviations, which is the scale too
    (biased where no coordinate reaches it); ``population``: clipped at clip population deviations, by the largest left."""
    df = df.withColumn("__c", F.col(x))
    if variant != "vanilla":
        df = df.withColumn("__t", clip * quant.spread(F.col(x), variant == "clipped")).withColumn("__c", vec.clip(F.col(x), F.col("__t")))
    df = df.withColumn("__a", quant.largest(F.col("__c")))
    scale = F.col("__t") if variant == "clipped" else F.col("__a")
    return df.withColumn("msg", F.struct(scale.alias("scale"), quant.ternary(F.col("__c"), F.col("__a"), _rounding(entity, row)).alias("bits"))).drop("__c", "__t", "__a")


def terngrad_decode(df: DataFrame, d: int, entity: str = "client") -> DataFrame:
    return df.withColumn("xhat", vec.scale(F.col("msg.bits"), F.col("msg.scale")))


def terngrad_layered_encode(df: DataFrame, d: int, layers: list[int], x: str = "x", entity: str = "client", row: str | None = None, clip: float = 2.5) -> DataFrame:
    """Clipped ternary values layer by layer (``layers``: lengths that add up to d), each by its own largest clipped magnitude."""
    if sum(layers) != d:
        raise ValueError(f"layers {layers} don't add up to {d}")
    scales, parts, begin = [], [], 0
    for k, n in enumerate(layers):
        df = df.withColumn(f"__x{k}", F.slice(x, begin + 1, n)).withColumn(f"__c{k}", vec.clip(F.col(f"__x{k}"), clip * quant.spread(F.col(f"__x{k}"), True))).withColumn(f"__a{k}", quant.largest(F.col(f"__c{k}")))
        parts.append(quant.ternary(F.col(f"__c{k}"), F.col(f"__a{k}"), F.concat_ws("/", _rounding(entity, row), F.lit(str(k)))))
        scales.append(F.col(f"__a{k}"))
        begin += n
    return df.withColumn("msg", F.struct(F.array(*scales).alias("scales"), F.concat(*parts).alias("bits"))).drop(*[f"__{c}{k}" for c in "xca" for k in range(len(layers))])


def terngrad_layered_decode(df: DataFrame, d: int, layers: list[int]) -> DataFrame:
    each = F.array(*[F.lit(k) for k, n in enumerate(layers) for _ in range(n)])
    return df.withColumn("xhat", vec.let(lambda s: F.zip_with(s["bits"], s["layer"], lambda b, k: b * F.get(s["scales"], k)), bits=F.col("msg.bits"), layer=each, scales=F.col("msg.scales")))


def identity_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None) -> DataFrame:
    return df.withColumn("msg", F.struct(F.col(x).alias("x")))


def identity_decode(df: DataFrame, d: int, entity: str = "client") -> DataFrame:
    return df.withColumn("xhat", F.col("msg.x"))


def packed(df: DataFrame, d: int) -> DataFrame:
    """A 0/1 message with its bits as 64-bit words, as it would be sent; d is the number of bits."""
    return df.withColumn("msg", F.col("msg").withField("words", quant.pack(F.col("msg.bits"), d)).dropFields("bits"))


def unpacked(df: DataFrame, d: int) -> DataFrame:
    return df.withColumn("msg", F.col("msg").withField("bits", quant.unpack(F.col("msg.words"), d)).dropFields("words"))


def packed_ternary(df: DataFrame, d: int) -> DataFrame:
    """A ternary message with its magnitudes and its signs as 64-bit words each."""
    m = F.col("msg")
    ones = lambda test: quant.pack(F.transform(m["bits"], lambda b: test(b).cast("int")), d)
    return df.withColumn("msg", m.withField("words", ones(lambda b: b != 0)).withField("signs", ones(lambda b: b > 0)).dropFields("bits"))


def unpacked_ternary(df: DataFrame, d: int) -> DataFrame:
    m = F.col("msg")
    bits = F.zip_with(quant.unpack(m["words"], d), quant.unpack(m["signs"], d), lambda b, s: b * (2 * s - 1))
    return df.withColumn("msg", m.withField("bits", bits).dropFields("words", "signs"))


def coin_encode(df: DataFrame, d: int, x: str = "x", entity: str = "client", row: str | None = None) -> DataFrame:
    """The sign codec whose zeros fall by a fair coin, scaled by the squared norm over the inner product with the decoded signs, its
    bits packed."""
    df = rotate(df, x, "__y", d, entity).withColumn("__b", quant.sign_bits_random_zero(F.col("__y"), _rounding(entity, row)))
    df = df.withColumn("msg", F.struct(quant.unbiased_scale(F.col("__y"), quant.signs_of(F.col("__b"))).alias("scale"), F.col("__b").alias("bits")))
    return packed(df, vec.next_power(d)).drop("__y", "__b")


def coin_decode(df: DataFrame, d: int, entity: str = "client") -> DataFrame:
    return sign_decode(unpacked(df, vec.next_power(d)), d, entity)


def encode_seconds(df: DataFrame, name: str, d: int, repeats: int = 3, **columns) -> float:
    """Median wall-clock seconds of encoding all of df, without writing it anywhere."""
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        codec(name).encode(df, d, **columns).select("msg").write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return sorted(took)[len(took) // 2]


# --- uniform random rotation -----------------------------------------------------------------------------------------------------

#: The matrix has d² numbers and is sent to every task.
LARGEST_ROTATION = 1 << 11


def haar_rotation(d: int, seed: int = prng.SEED) -> np.ndarray:
    """A special-orthogonal matrix, uniform by Haar's measure: the product of Householder reflections of hash-Gaussian vectors of d,
    d - 1, ... coordinates, with the signs that make it the orthogonal factor of a Gaussian matrix, one of them turned on demand."""
    if d > LARGEST_ROTATION:
        raise ValueError(f"a uniform rotation of {d} coordinates is too large; use the Hadamard rotation")
    reflections, signs = [], np.ones(d)
    for k in range(d):
        u = prng.uniforms_array(f"urr-{d}-{k}", 2 * (d - k), prng.DATA, seed)
        g = np.sqrt(-2 * np.log(1 - u[::2])) * np.cos(2 * np.pi * u[1::2])
        own = -1.0 if g[0] < 0 else 1.0
        signs[k] = own if k == d - 1 else -own
        g[0] += own * np.linalg.norm(g)
        reflections.append(g)
    if np.prod(signs) * (-1) ** (d - 1) < 0:
        signs[0] = -signs[0]
    q = np.diag(signs)
    for k in range(d - 2, -1, -1):
        g = reflections[k]
        q[k:, k:] -= np.outer(2 / (g @ g) * g, g @ q[k:, k:])
    return q


def matrix_product(x: Column, matrix: np.ndarray, transposed: bool = False) -> Column:
    """matrix · x (or its transpose) for a vector column, by Arrow batches."""
    m = np.ascontiguousarray(matrix.T if transposed else matrix)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ m.T)) if len(v) else pd.Series([], dtype=object)

    return product(x)


def urr_encode(df: DataFrame, matrix: np.ndarray, x: str = "x", two_level: bool = False) -> DataFrame:
    df = vec.held(df, "__in", F.col(x)).withColumn("__y", vec.settle(matrix_product(F.col("__in"), matrix))).drop("__in")
    return (_two_level("__y", quant.two_means, df, False) if two_level else df.withColumn("msg", _sign(df, "__y"))).drop("__y")


def urr_decode(df: DataFrame, matrix: np.ndarray, two_level: bool = False) -> DataFrame:
    v = quant.lookup(F.col("msg.bits"), F.col("msg.c0"), F.col("msg.c1")) if two_level else vec.scale(quant.signs_of(F.col("msg.bits")), F.col("msg.scale"))
    return vec.held(df, "__in", v).withColumn("xhat", matrix_product(F.col("__in"), matrix, True)).drop("__in")


# --- registry --------------------------------------------------------------------------------------------------------------------

CODECS = {c.name: c for c in (
    Codec("identity", identity_encode, identity_decode, True, lambda d: 64.0),
    Codec("sign", sign_encode, sign_decode),
    Codec("sign_coin", coin_encode, coin_decode),
    Codec("two_means", two_means_encode, two_level_decode),
    Codec("split_at_mean", split_encode, two_level_decode),
    Codec("hadamard_sq", hadamard_encode, hadamard_decode),
    *(Codec(f"hadamard_{b}bit", partial(hadamard_encode, bits=b), partial(hadamard_decode, bits=b), False, lambda d, b=b: b * vec.next_power(d) / d) for b in (2, 4, 8)),
    Codec("two_means_lloyd", partial(two_means_encode, rounds=None), two_level_decode),
    Codec("kashin_sq", kashin_encode, kashin_decode, False, lambda d: vec.kashin_dim(d) / d),
    Codec("terngrad", terngrad_encode, terngrad_decode, False, lambda d: 2.0),
    Codec("terngrad_clipped", lambda df, d, **k: terngrad_encode(df, d, variant="clipped", **k), terngrad_decode, False, lambda d: 2.0),
    Codec("terngrad_population", lambda df, d, **k: terngrad_encode(df, d, variant="population", **k), terngrad_decode, False, lambda d: 2.0),
)}


def codec(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name!r}; there are {', '.join(CODECS)}")
    return CODECS[name]


def round_trip(df: DataFrame, name: str, d: int, x: str = "x", entity: str = "client", row: str | None = None) -> DataFrame:
    """df with msg and xhat."""
    c = codec(name)
    return c.decode(c.encode(df, d, x=x, entity=entity, row=row), d, entity=entity)


def size_gated(df: DataFrame, name: str, d: int, threshold: int = 10_000, x: str = "x", **columns) -> DataFrame:
    """xhat by the codec (over d coordinates) for vectors of more than ``threshold`` coordinates, by the identity for all others;
    vectors may be shorter than d and come back as long as they were. Map-only."""
    above = F.coalesce(F.size(x) > threshold, F.lit(False))
    coded = round_trip(df.where(above), name, d, x=x, **columns).withColumn("xhat", F.slice("xhat", F.lit(1), F.size(x)))
    plain = round_trip(df.where(~above), "identity", d, x=x, **columns)
    return coded.drop("msg").unionByName(plain.drop("msg"))
