"""Gated loudness of signals: K-weighting, overlapping blocks, an absolute and a relative gate.

The weighting is two recursive filters. Their response fades out within WARM seconds to less than a double can tell, so a
stretch of a signal is weighted by what is WARM seconds before it, and a long signal is many stretches. The gates are two
aggregations over the energies of blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import few
from ..shared import saved
from .chunks import chunk_pieces
from .pieces import SIZE

#: Fixed values of the measure: block (s), overlap of blocks, offset and absolute gate (LUFS), relative gate (LU), shelf (dB, Hz, Q) and high pass (Hz, Q).
BLOCK, OVERLAP, OFFSET, ABSOLUTE, RELATIVE = 0.4, 0.75, -0.691, -70.0, -10.0
SHELF, HIGH_PASS = (4.0, 1500.0, 1 / math.sqrt(2)), (38.0, 0.5)
#: Seconds after which the weighting's response is under 1e-18.
WARM = 0.2


def biquads(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numerator, denominator) of the high shelf and the high pass, by the usual bilinear forms."""
    gain, f, q = SHELF
    if rate <= 2 * f:
        raise ValueError(f"the weighting needs over {2 * f} samples a second")
    a, w = 10 ** (gain / 40), 2 * math.pi * f / rate
    c, s = math.cos(w), math.sin(w) / q * math.sqrt(a)
    shelf = np.array([a * (a + 1 + (a - 1) * c + s), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - s)]), np.array([a + 1 - (a - 1) * c + s, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - s])
    f, q = HIGH_PASS
    w = 2 * math.pi * f / rate
    c, s = math.cos(w), math.sin(w) / (2 * q)
    high = np.array([(1 + c) / 2, -1 - c, (1 + c) / 2]), np.array([1 + s, -2 * c, 1 - s])
    return [(b / d[0], d / d[0]) for b, d in (shelf, high)]


@lru_cache(maxsize=8)
def response(rate: float, n: int) -> np.ndarray:
    """First n samples of what the weighting makes of one unit impulse."""
    x = np.zeros(n)
    x[0] = 1
    for b, a in biquads(rate):
        y, p, q = np.zeros(n), 0.0, 0.0
        for k in range(n):  # transposed direct form
            y[k] = b[0] * x[k] + p
            p, q = b[1] * x[k] - a[1] * y[k] + q, b[2] * x[k] - a[2] * y[k]
        x = y
    return x


def weighted(x: np.ndarray, rate: float) -> np.ndarray:
    h = response(rate, min(len(x), math.ceil(WARM * rate)))
    n = 1 << (len(x) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def block_sizes(rate: float, block: float = BLOCK) -> tuple[int, int]:
    """Samples of a block, and between the starts of blocks."""
    size = round(block * rate)
    return size, max(1, round(size * (1 - OVERLAP)))


def energies(pieces: DataFrame, key: str, rate: float, block: float = BLOCK, size: int = SIZE, span: int | None = None) -> DataFrame:
    """key, block, energy of all whole blocks. pieces: of `size` samples, with a halo of stretch() samples."""
    width, step = block_sizes(rate, block)
    warm, span, chunk = stretch(rate, block, span)
    kind = dict(pieces.dtypes)[key]

    def run(batches):
        for b in few(batches):
            keys, blocks, found = [], [], []
            for row, (n, k, start, x) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "chunk_idx", "start", "x")), strict=True)):
                y = weighted(np.array(x)[: n - start], rate)
                first = warm if k else 0
                # The last stretch may end with the block that would be the first one of the next.
                at = np.arange(first, min(warm + span + (start + chunk >= n), len(y) - width + 1), step)
                if not len(at):
                    continue
                sums = np.lib.stride_tricks.sliding_window_view(y * y, width)[at].sum(1)
                keys += [row] * len(at)
                blocks.append((start + at) // step)
                found.append(sums / width)
            take = pa.array(keys, pa.int64())
            flat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
            yield pa.RecordBatch.from_arrays([b.column(key).take(take), flat(blocks, pa.int64()), flat(found, pa.float64())], [key, "block", "energy"])

    return chunk_pieces(pieces, chunk, chunk - span, key, size).mapInArrow(run, f"{key} {kind}, block long, energy double")


def stretch(rate: float, block: float = BLOCK, span: int | None = None) -> tuple[int, int, int]:
    """Samples before a stretch that weigh in, samples that its blocks begin in, and samples in all: multiples of a block's step."""
    width, step = block_sizes(rate, block)
    warm = -(-math.ceil(WARM * rate) // step) * step
    span = -(-(span or 8 * width) // step) * step
    return warm, span, warm + span + width


def level(energy: Column) -> Column:
    return F.when(energy > 0, OFFSET + 10 * F.log10(energy))


def gated_loudness(blocks: DataFrame, key: str) -> DataFrame:
    """key, loudness of the blocks (key, energy) that pass both gates; null if none does."""
    loud = saved(blocks.where(level(F.col("energy")) > ABSOLUTE).select(key, "energy"), "blocks")
    gate = saved(loud.groupBy(key).agg((level(F.avg("energy")) + RELATIVE).alias("_gate")), "gates")
    above = loud.join(gate, key).where(level(F.col("energy")) > F.col("_gate")).groupBy(key).agg(level(F.avg("energy")).alias("loudness"))
    return blocks.select(key).distinct().join(above, key, "left")


def window_loudness(x: np.ndarray, rate: float, block: float = BLOCK) -> float:
    """The same of one window in memory; minus infinity if no block passes."""
    width, step = block_sizes(rate, block)
    if len(x) < width:
        return -math.inf
    y = weighted(x, rate)
    e = np.lib.stride_tricks.sliding_window_view(y * y, width)[::step].mean(1)
    at = lambda v: OFFSET + 10 * np.log10(np.maximum(v, 1e-300))
    loud = e[at(e) > ABSOLUTE]
    if not len(loud):
        return -math.inf
    above = loud[at(loud) > at(loud.mean()) + RELATIVE]
    return float(at(above.mean())) if len(above) else -math.inf


def normalize_windows(rows: DataFrame, rate: float, target: float, *ids: str, block: float = BLOCK) -> DataFrame:
    """ids, x of windows at the target loudness, each measured by itself; divided by the peak where that is over 1."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in few(batches):
            out = []
            for v in b.column("x").to_pylist():
                x = np.array(v, float)
                found = window_loudness(x, rate, block)
                if math.isfinite(found):
                    x = x * 10 ** ((target - found) / 20)
                out.append(x / max(1.0, float(np.abs(x).max(initial=0.0))))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array(out, pa.list_(pa.float64()))], [*ids, "x"])

    return rows.select(*ids, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", x array<double>")
