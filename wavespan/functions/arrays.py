"""Signals as array columns: all expressions, evaluated row by row in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
POWER_FLOOR = 1e-10


def let(value: Column, body) -> Column:
    """body(value), computing value once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def mean_square(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v)) / F.size(x)


def downmix(left: Column, right: Column) -> Column:
    """Mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def peak_normalize(x: Column) -> Column:
    """Divide by the largest magnitude, but only where it is over 1."""
    return let(peak(x), lambda p: F.when(p > 1, F.transform(x, lambda v: v / p)).otherwise(x))


def loudness_normalize(x: Column, loudness: Column, target: float) -> Column:
    """Gain to the target loudness (none where the loudness is not finite), then peak_normalize."""
    gain = F.when(loudness.isNotNull() & ~F.isnan(loudness) & (F.abs(loudness) < float("inf")), F.pow(F.lit(10.0), (target - loudness) / 20)).otherwise(1.0)
    return let(F.transform(x, lambda v: v * gain), peak_normalize)


def quantize_pcm16(x: Column) -> Column:
    """Clamp to [-1, 1] and round half-even to 16-bit samples."""
    return F.transform(x, lambda v: F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 32767).cast("short"))


def clipped_samples(x: Column) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) > 1))


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


def soft_saturate(x: Column, wet: Column | float, drive: Column | float) -> Column:
    """(1 - wet) x + wet tanh(drive x) / drive."""
    wet, drive = (v if isinstance(v, Column) else F.lit(float(v)) for v in (wet, drive))
    return F.transform(x, lambda v: (1 - wet) * v + wet * F.tanh(drive * v) / drive)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))) / F.size(a)


def hann(n: int) -> Column:
    """Periodic Hann window."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 * (1 - F.cos(2 * math.pi * i / n)))


def normalize(x: Column, mean: Column, std: Column) -> Column:
    """Channel by channel: (x - mean) / (std + epsilon)."""
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda z: (z["x"] - z["m"]) / (z["s"] + EPSILON))


def unnormalize(x: Column, mean: Column, std: Column) -> Column:
    """Inverse of normalize."""
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda z: z["x"] * (z["s"] + EPSILON) + z["m"])


def align(a: Column, b: Column) -> tuple[Column, Column]:
    """Both cropped to the shorter one's length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def channel_first(x: Column, channels: int) -> Column:
    """An array of arrays as [channels, frames]: transposed only if the first axis isn't the channels."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(x, lambda row: F.get(row, c)))
    return F.when(F.size(x) == channels, x).when(F.size(F.get(x, F.lit(0))) == channels, turned)


def eq_gain(frequency: Column, nodes: list[float], gains: list[Column]) -> Column:
    """Amplitude factor: gains in dB interpolated over log2 frequency, flat outside the nodes."""
    f = F.log2(F.greatest(frequency, F.lit(1.0)))
    at = [math.log2(n) for n in nodes]
    out = F.when(f <= at[0], gains[0])
    for k in range(len(nodes) - 1):
        out = out.when(f <= at[k + 1], gains[k] + (gains[k + 1] - gains[k]) * (f - at[k]) / (at[k + 1] - at[k]))
    return F.pow(F.lit(10.0), out.otherwise(gains[-1]) / 20)


def bandpass_gain(frequency: Column, low: Column, high: Column, low_slope: Column, high_slope: Column) -> Column:
    """Amplitude factor: flat between the cut-offs, skirts in dB for each octave outside, never under -80 dB."""
    f = F.greatest(frequency, F.lit(0.5))
    db = F.when(f < low, -low_slope * F.log2(low / f)).when(f > high, -high_slope * F.log2(f / high)).otherwise(0.0)
    return F.pow(F.lit(10.0), F.greatest(F.lit(-80.0), F.least(F.lit(0.0), db)) / 20)


def mix_at_snr(x: Column, noise: Column, pick: Column, snr: Column) -> Column:
    """x plus a stretch of noise (repeated if short) from a keyed start, scaled to the signal-to-noise ratio."""
    n, m = F.size(x), F.size(noise)
    long = F.when(m < n, F.flatten(F.array_repeat(noise, (n / m).cast("int") + 1))).otherwise(noise)

    def add(tape: Column) -> Column:
        part = F.slice(tape, (F.pmod(pick, (F.size(tape) - n + 1).cast("long")) + 1).cast("int"), n)

        def mixed(p: Column) -> Column:
            gain = F.sqrt(F.greatest(mean_square(x), F.lit(POWER_FLOOR)) / F.pow(F.lit(10.0), snr / 10) / F.greatest(mean_square(p), F.lit(POWER_FLOOR)))
            return let(gain, lambda g: F.zip_with(x, p, lambda a, b: a + g * b))

        return let(part, mixed)

    return let(long, add)
