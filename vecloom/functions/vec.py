"""Vectors as ARRAY<DOUBLE> columns: padding, norms, products and the orthonormal Walsh-Hadamard transform."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this length the transform is a Catalyst expression; beyond it an Arrow kernel is faster (measured).
EXPRESSION_LIMIT = 64


def as_double(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("array<double>")


def next_power(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def kashin_dim(dim: int, threshold: float = 0.85) -> int:
    """Length of a Kashin representation: twice a power of two; else the next one, doubled if dim fills more than threshold of it."""
    if is_power(dim):
        return 2 * dim
    p = next_power(dim)
    return 2 * p if dim / p > threshold else p


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of the values, each of which is evaluated once.

    A column that a lambda refers to is otherwise evaluated for every element, since Catalyst folds the projection that made it into
    the lambda; an Arrow kernel can't be there at all.
    """
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(one, body), F.lit(0))


def pad(x: Column, size: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(x))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def norm1(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))


def norm2_squared(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def scale(x: Column, by: Column | float) -> Column:
    return let(lambda s: F.transform(s["x"], lambda v: v * s["by"]), x=x, by=by) if isinstance(by, Column) else F.transform(x, lambda v: v * float(by))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def multiply(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def clip(x: Column, most: Column | float) -> Column:
    return let(lambda s: F.transform(s["x"], lambda v: F.greatest(-s["m"], F.least(s["m"], v))), x=x, m=most if isinstance(most, Column) else F.lit(most))


def settle(x: Column, digits: int = 9) -> Column:
    """Round so that a sign or threshold decision doesn't hang on the order of additions."""
    return F.transform(x, lambda v: F.rint(v * float(10**digits)) / float(10**digits))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def fwht_expression(x: Column, d: int) -> Column:
    """Butterflies of log2(d) levels, as higher-order functions."""
    if not is_power(d):
        raise ValueError(f"length {d} isn't a power of two")
    if d == 1:
        return x

    def level(acc: Column, k: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i.bitwiseAND(half) == 0, v + F.get(acc, i + half)).otherwise(F.get(acc, i - half) - v))

    return scale(F.aggregate(F.sequence(F.lit(0), F.lit(d.bit_length() - 2)), x, level), 1 / np.sqrt(d))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fwht_kernel(x: pd.Series) -> pd.Series:
    """The same butterflies over an Arrow batch; vectors of one batch may differ in length."""
    out = pd.Series([None] * len(x), dtype=object)
    sizes = x.map(lambda v: -1 if v is None else len(v))
    for d in sizes.unique():
        if d < 0:
            continue
        if d & (d - 1) or not d:
            raise ValueError(f"length {d} isn't a power of two")
        rows = np.flatnonzero(sizes.to_numpy() == d)
        y = np.stack(x.iloc[rows].to_numpy()).astype(float)
        h = 1
        while h < d:
            y = y.reshape(len(rows), -1, 2, h)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2)
            h *= 2
        y = y.reshape(len(rows), d) * (1 / np.sqrt(d))
        for r, v in zip(rows, y, strict=True):
            out.iat[r] = v
    return out


def fwht(x: Column, d: int) -> Column:
    """Orthonormal Walsh-Hadamard transform of vectors of length d, a power of two; it is its own inverse."""
    if not is_power(d):
        raise ValueError(f"length {d} isn't a power of two")
    return fwht_expression(x, d) if d <= EXPRESSION_LIMIT else fwht_kernel(x)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that no projection above is folded with: each row's value is computed once and is there as it is."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_fwht(df: DataFrame, out: str, x: Column, d: int) -> DataFrame:
    """df with the transform of x. The kernel reads a held column: an argument that holds lambdas isn't taken out to Python."""
    if d <= EXPRESSION_LIMIT:
        return df.withColumn(out, fwht(x, d))
    return held(df, "__in", x).withColumn(out, fwht(F.col("__in"), d)).drop("__in")
