"""Seeded, partition-independent randomness.

``F.rand`` depends on how rows are partitioned, so a retried task may draw other
numbers. Here every draw is a pure function of (seed, salt, key): the same row
gets the same number on any cluster and after any executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52
SCALE = float(1 << BITS)
_HEX = BITS // 4


def hash_bits(seed: int, salt: str, *key: Column, part: int = 0) -> Column:
    """52 hash bits as a bigint. One md5 yields two of them: part 0 and part 1."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in key])
    digits = F.substring(F.md5(text), 1 + _HEX * part, _HEX)
    return F.conv(digits, 16, 10).cast("bigint")


def uniform(seed: int, salt: str, *key: Column, part: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bits(seed, salt, *key, part=part) / F.lit(SCALE)


def fast_uniform(seed: int, salt: str, *key: Column) -> Column:
    """Same contract on xxhash64: about four times cheaper, but with no SQL twin."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *[k.cast("string") for k in key])
    return F.shiftrightunsigned(h, 64 - BITS) / F.lit(SCALE)


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) variate from a uniform, by inverting its distribution."""
    centred = u - F.lit(0.5)
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
