"""Reproducible randomness: a pure function of (seed, stream, entity, index), the same in every engine that has MD5.

No generator state has to be kept in step between sender and receiver, and a task that runs again draws the same numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
ROTATION, ROUNDING, DATA, INIT, BUCKET, SIGN = range(6)


def digest(stream: int, entity: Column | str | int, index: Column, seed: int = SEED) -> Column:
    entity = entity if isinstance(entity, Column) else F.col(entity) if isinstance(entity, str) else F.lit(entity)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), entity.cast("string"), index.cast("string")))


#: Draws that one digest holds: a hexadecimal digit per sign, eight per uniform.
SIGNS_EACH, UNIFORMS_EACH = 32, 4


def _sign_of(digit: Column) -> Column:
    return F.when(digit < "8", 1.0).otherwise(-1.0)


def _uniform_of(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("double") / float(2**32)


def _draws(stream: int, entity, d: Column, each: int, of, seed: int) -> Column:
    """d draws: one digest for every ``each`` of them."""
    width = 32 // each
    blocks = F.sequence(F.lit(0), F.floor((d - 1) / each).cast("int"))
    one = lambda h: F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: of(F.substring(h, j * width + 1, F.lit(width))))
    # the digest is bound by a lambda of its own, so that it is made once
    return F.slice(F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(F.array(digest(stream, entity, b, seed)), one)))), F.lit(1), d)


def uniform(stream: int, entity, index: Column, seed: int = SEED) -> Column:
    """Draw ``index`` of the entity: in [0, 1), a multiple of 2^-32."""
    h = digest(stream, entity, F.floor(index / UNIFORMS_EACH).cast("int"), seed)
    return _uniform_of(F.substring(h, (F.pmod(index, F.lit(UNIFORMS_EACH)) * 8 + 1).cast("int"), F.lit(8)))


def uniforms(entity, d: Column, stream: int, seed: int = SEED) -> Column:
    """Draws 0 to d - 1 of the entity."""
    return _draws(stream, entity, d, UNIFORMS_EACH, _uniform_of, seed)


def uniforms_array(entity, d: int, stream: int, seed: int = SEED) -> np.ndarray:
    """The same draws on the driver."""
    text = "".join(hashlib.md5(f"{seed}:{stream}:{entity}:{b}".encode()).hexdigest() for b in range(-(-d // UNIFORMS_EACH)))
    return np.frombuffer(bytes.fromhex(text), ">u4")[:d] / 2**32


def signs(entity, d: int, stream: int = ROTATION, seed: int = SEED) -> Column:
    """The diagonal of d signs that belongs to an entity: +1 or -1 with equal chances."""
    return _draws(stream, entity, F.lit(d), SIGNS_EACH, _sign_of, seed)


def bucket(row: Column, key: Column, cols: int, seed: int = SEED) -> Column:
    """Sketch bucket of a key in a row."""
    return F.pmod(F.conv(F.substring(digest(BUCKET, row, key, seed), 1, 8), 16, 10).cast("long"), F.lit(cols))
