"""Keyed pseudo-random numbers: the same for a key on any partitioning, retry or engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys have 13 hexadecimal digits, so they are exact as a double.
SPAN = float(1 << 52)


def key(*parts: Column | str | int) -> Column:
    """52-bit key of the parts, joined by ':' (strings are literals, columns are values)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform on the open interval (0, 1)."""
    return (key(*parts).cast("double") + 0.5) / SPAN


def gaussian(mean: float, std: float, *parts: Column | str | int) -> Column:
    """Normal number from two keyed uniforms."""
    return mean + std * F.sqrt(-2 * F.log(uniform(*parts, "a"))) * F.cos(2 * math.pi * uniform(*parts, "b"))


def clipped_gaussian(mean: float, std: float, low: float, high: float, *parts: Column | str | int) -> Column:
    """Normal number, moved to the nearer end where it leaves [low, high]."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), gaussian(mean, std, *parts)))
