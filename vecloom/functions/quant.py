"""Quantisers: signs, two means, stochastic rounding, ternary values, bit packing and entropy.

Every function takes and returns columns. Degenerate inputs are defined: a zero vector has scale 0 and decodes to zeros, a constant
one has one centroid twice, and an interval of length 0 rounds to its lower end.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prng, vec
from .prng import ROUNDING


def sign_bits(y: Column) -> Column:
    """1 for v >= 0, 0 below."""
    return F.transform(y, lambda v: F.when(v < 0, 0).otherwise(1))


def sign_bits_random_zero(y: Column, entity, stream: int = ROUNDING) -> Column:
    """As sign_bits, but a zero is a fair coin."""
    return vec.let(lambda s: F.zip_with(s["y"], s["u"], lambda v, u: F.when(v < 0, 0).when(v > 0, 1).when(u < 0.5, 0).otherwise(1)), y=y, u=uniforms(y, entity, stream))


def signs_of(bits: Column) -> Column:
    return F.transform(bits, lambda b: F.when(b == 1, 1.0).otherwise(-1.0))


def sign_scale(y: Column) -> Column:
    """The factor that makes the inner product of y and its decoded signs the squared norm of y."""
    return vec.ratio(vec.norm2_squared(y), vec.norm1(y))


def unbiased_scale(y: Column, decoded: Column) -> Column:
    """The same for any decoded vector."""
    return vec.ratio(vec.norm2_squared(y), vec.dot(y, decoded))


def _centroids(n0: Column, s0: Column, n: Column, s: Column) -> tuple[Column, Column]:
    whole = (n0 == 0) | (n0 == n)
    mean = vec.ratio(s, n)
    return F.when(whole, mean).otherwise(F.try_divide(s0, n0)), F.when(whole, mean).otherwise(F.try_divide(s - s0, n - n0))


def two_means(y: Column, rounds: int | None = 3) -> Column:
    """struct(c0, c1, n0, n1, cut): centroids and sizes of the parts below and from ``cut`` on, after at most ``rounds`` Lloyd steps
    from the split at the mean, or until convergence (None). Both parts of one step are nested in those of the next, so a step that
    changes no size changes nothing, steps after it are skipped, and no vector takes more steps than it has coordinates.
    """
    def run(a: Column) -> Column:
        y, n, s = a["y"], a["n"], a["s"]

        def split(cut: Column) -> Column:
            return vec.let(lambda c: F.struct(F.size(c["low"]).cast("double").alias("n0"), vec.total(c["low"]).alias("s0"), c["cut"].alias("cut"), F.lit(False).alias("done")), low=F.filter(y, lambda v: v < cut), cut=cut)

        def step(a: Column, _: Column) -> Column:
            c0, c1 = _centroids(a["n0"], a["s0"], n, s)
            after = vec.let(lambda m: split(m["cut"]), cut=(c0 + c1) / 2)
            return F.when(a["done"], a).otherwise(vec.let(lambda m: m["b"].withField("done", m["b"]["n0"] == a["n0"]), b=after))

        def finish(a: Column) -> Column:
            c0, c1 = _centroids(a["n0"], a["s0"], n, s)
            return F.struct(c0.alias("c0"), c1.alias("c1"), a["n0"].cast("long").alias("n0"), (n - a["n0"]).cast("long").alias("n1"), a["cut"].alias("cut"))

        start = vec.let(lambda m: split(m["cut"]), cut=vec.ratio(s, n))
        if rounds == 0:
            return F.aggregate(F.array(F.lit(0)), start, lambda a, _: a, finish)
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)) if rounds is None else F.lit(rounds)), start, step, finish)

    return vec.let(lambda b: vec.let(run, y=b["y"], n=F.size(b["y"]).cast("double"), s=vec.total(b["y"])), y=y)


def split_at_mean(y: Column) -> Column:
    """struct(c0, c1, n0, n1, cut): the parts up to the mean and above it, and their means."""
    def run(a: Column) -> Column:
        n, s, n0, s0 = F.size(a["y"]).cast("double"), vec.total(a["y"]), F.size(a["low"]).cast("double"), vec.total(a["low"])
        c0, c1 = _centroids(n0, s0, n, s)
        return F.struct(c0.alias("c0"), c1.alias("c1"), n0.cast("long").alias("n0"), (n - n0).cast("long").alias("n1"), a["cut"].alias("cut"))

    parts = lambda b: vec.let(run, y=b["y"], low=F.filter(b["y"], lambda v: v <= b["cut"]), cut=b["cut"])
    return vec.let(lambda b: vec.let(parts, y=b["y"], cut=vec.ratio(vec.total(b["y"]), F.size(b["y"]))), y=y)


def two_means_scale(y: Column, m: Column) -> Column:
    return vec.ratio(vec.norm2_squared(y), m["n0"] * m["c0"] * m["c0"] + m["n1"] * m["c1"] * m["c1"])


def lookup(bits: Column, low: Column, high: Column) -> Column:
    return vec.let(lambda s: F.transform(s["b"], lambda b: F.when(b == 1, s["high"]).otherwise(s["low"])), b=bits, low=low, high=high)


def stochastic_levels(y: Column, entity, bits: int = 1, low: Column | None = None, span: Column | None = None, stream: int = ROUNDING) -> Column:
    """Each coordinate rounded up or down to one of 2^bits levels of [low, low + span], unbiased; [min, max] by default."""
    u = uniforms(y, entity, stream)
    low = F.array_min(y) if low is None else low
    span = F.array_max(y) - F.array_min(y) if span is None else span
    return levels_from(y, u, low, span, bits)


def uniforms(y: Column, entity, stream: int = ROUNDING) -> Column:
    """A uniform for each coordinate of y."""
    entity = entity if isinstance(entity, Column) else F.col(entity)
    return vec.let(lambda s: prng.uniforms(s["e"], s["n"], stream), n=F.size(y), e=entity.cast("string"))


def levels_from(y: Column, u: Column, low: Column, span: Column, bits: int) -> Column:
    """stochastic_levels with uniforms that are at hand as an array, for a grid of quantisers over one vector."""
    top = float(2**bits - 1)

    def run(s: Column) -> Column:
        def level(v: Column, w: Column) -> Column:
            p = vec.ratio(v - s["low"], s["span"]) * top
            return (F.floor(p) + F.when(w < p - F.floor(p), 1).otherwise(0)).cast("int")

        return F.zip_with(s["y"], s["u"], level)

    return vec.let(run, y=y, u=u, low=low, span=span)


def quantiser_range(y: Column, normalisation: str) -> tuple[Column, Column]:
    """(low, span) of b-bit quantisation: from the extremes, or sqrt(2) norms wide from the minimum."""
    if normalisation == "minmax":
        return F.array_min(y), F.array_max(y) - F.array_min(y)
    if normalisation == "sqrt2norm":
        return F.array_min(y), F.sqrt(F.lit(2.0) * vec.norm2_squared(y))
    raise ValueError(f"unknown normalisation {normalisation!r}")


def dequantise(levels: Column, low: Column, span: Column, bits: int = 1) -> Column:
    return vec.let(lambda s: F.transform(s["q"], lambda q: s["low"] + s["span"] * q / float(2**bits - 1)), q=levels, low=low, span=span)


def spread(x: Column, sample: bool) -> Column:
    """Standard deviation of the coordinates: of a sample or of the population."""
    def run(s: Column) -> Column:
        n = F.size(s["x"])
        return F.sqrt(vec.ratio(F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + (v - s["mean"]) * (v - s["mean"])), n - 1 if sample else n))

    return vec.let(run, x=x, mean=vec.ratio(vec.total(x), F.size(x)))


def ternary(x: Column, most: Column, entity, stream: int = ROUNDING) -> Column:
    """-1, 0 or 1: the sign with probability |v| / most."""
    draw = lambda s: F.zip_with(s["x"], s["u"], lambda v, u: F.when(u < vec.ratio(F.abs(v), s["m"]), F.signum(v)).otherwise(0.0).cast("int"))
    return vec.let(draw, x=x, u=uniforms(x, entity, stream), m=most)


def largest(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def pack(bits: Column, d: int) -> Column:
    """0/1 values as 64-bit words, the first in the lowest bit."""
    words = [F.aggregate(F.slice(bits, 64 * w + 1, 64), F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("w")),
                         lambda a, b: F.struct((a["i"] + 1).alias("i"), a["w"].bitwiseOR(F.call_function("shiftleft", b.cast("long"), a["i"])).alias("w")), lambda a: a["w"])
             for w in range(math.ceil(d / 64))]
    return F.array(*words)


def unpack(words: Column, d: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.getbit(F.get(words, F.floor(i / 64).cast("int")), F.pmod(i, F.lit(64))).cast("int"))


def histogram(df: DataFrame, keys: list[str], symbols: str) -> DataFrame:
    """(keys, symbol, n) of the values of an array column."""
    return df.select(*keys, F.explode_outer(symbols).alias("symbol")).where("symbol IS NOT NULL").groupBy(*keys, "symbol").agg(F.count(F.lit(1)).alias("n"))


def entropy_bits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon bits a symbol of each group of a histogram: log2 N - sum(n log2 n) / N."""
    sums = hist.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    return sums.select(*keys, F.col("t").alias("n_symbols"), (F.log2("t") - F.col("l") / F.col("t")).alias("entropy"))


def huffman_lengths(counts: dict) -> dict:
    """Code length of each symbol; a single symbol takes one bit."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items())) if n > 0]
    if len(heap) == 1:
        return {heap[0][2][0]: 1}
    depth = dict.fromkeys((h[2][0] for h in heap), 0)
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return depth


def huffman_bits(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Total Huffman bits of each group of a histogram. A group is one row per symbol, at most the quantiser's levels."""
    schema = ", ".join(f"{k} {hist.schema[k].dataType.simpleString()}" for k in keys) + ", n_symbols long, bits long"

    def code(key, pdf):
        import pandas as pd

        counts = dict(zip(pdf["symbol"].tolist(), pdf["n"].tolist(), strict=True))
        depth = huffman_lengths(counts)
        return pd.DataFrame([[*key, sum(counts.values()), sum(depth[s] * n for s, n in counts.items())]], columns=[*keys, "n_symbols", "bits"])

    return hist.groupBy(*keys).applyInPandas(code, schema)

