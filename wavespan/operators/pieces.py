"""Signals as rows of pieces: key, piece, begin, n, x. No signal is one row or one task, however long it is.

Piece k has the samples from k * size on; with a halo, also the first ones of the pieces behind it, so that what begins in
a piece can be cut out of it. n is the length of the whole signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..shared import saved
from .ranks import in_order, with_positions

#: Samples of a piece.
SIZE = 4096


def numbered(samples: DataFrame, key: str, *order: str) -> DataFrame:
    """samples with pos, counting from 0 in each signal, and n, its length. Places come from ranges of (key, order)."""
    placed = with_positions(saved(in_order(samples, key, *order), "samples"), "_rank")
    # A table of its own: the driver of the join knows its size, and Spark can split a signal that has very many samples.
    signals = saved(placed.groupBy(key).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n")), "signals")
    return placed.join(signals, key).withColumn("pos", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def pieces(samples: DataFrame, key: str, size: int = SIZE, halo: int = 0) -> DataFrame:
    """key, piece, begin, n, x of samples (key, pos, v)."""
    if not 0 <= halo <= size:
        raise ValueError("a halo comes from the next piece alone")
    own = F.floor(F.col("pos") / size)
    at = F.array(own) if not halo else F.when((own > 0) & (F.col("pos") % size < halo), F.array(own, own - 1)).otherwise(F.array(own))
    rows = samples.select(key, F.explode(at).alias("piece"), "pos", "v")
    x = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    out = rows.groupBy(key, "piece").agg(x.alias("x"), F.max("pos").alias("_last"))
    lengths = saved(samples.groupBy(key).agg((F.max("pos") + 1).alias("n")), "lengths")
    return out.join(lengths, key).select(key, "piece", (F.col("piece") * size).alias("begin"), "n", "x")


def of_arrays(signals: DataFrame, key: str, size: int = SIZE, halo: int = 0) -> DataFrame:
    """Pieces of signals that are one array each (short ones: windows, clips). No shuffle."""
    n = F.size("x").cast("long")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(n / size) - 1))).alias("piece")
    rows = signals.where(F.size("x") > 0).select(key, "x", n.alias("n"), k)
    return rows.select(key, "piece", (F.col("piece") * size).alias("begin"), "n", F.slice("x", (F.col("piece") * size + 1).cast("int"), size + halo).alias("x"))


def full_windows(rows: DataFrame, segment: int, hop: int, size: int = SIZE) -> DataFrame:
    """rows without x, local_idx, start_sample, x of all full windows that begin in each piece (of `size` samples, with a halo of a segment). No shuffle."""
    last = F.floor((F.col("n") - segment) / hop)
    first, end = F.ceil(F.col("begin") / hop), F.least(last, F.floor((F.col("begin") + size - 1) / hop))
    k = F.explode(F.when((F.col("n") >= segment) & (first <= end), F.sequence(first, end))).alias("local_idx")
    found = rows.select("*", k).withColumn("start_sample", F.col("local_idx") * hop)
    return found.withColumn("x", F.slice("x", (F.col("start_sample") - F.col("begin") + 1).cast("int"), segment))


def each(rows: DataFrame, x: Column, *keep: str) -> DataFrame:
    """The same pieces with other samples."""
    return rows.select(*[c for c in rows.columns if c != "x"], *keep, x.alias("x"))


def peaks(rows: DataFrame, key: str) -> DataFrame:
    """key, peak, mean_square of whole signals, from one row for each piece."""
    square = arrays.total(F.transform("x", lambda v: v * v))
    g = rows.select(key, arrays.peak(F.col("x")).alias("_p"), square.alias("_q"), F.size("x").alias("_k")).groupBy(key)
    return g.agg(F.max("_p").alias("peak"), (F.sum("_q") / F.sum("_k")).alias("mean_square"))


def peak_normalize(rows: DataFrame, key: str) -> DataFrame:
    """Divide by the largest magnitude of the whole signal, but only where it is over 1."""
    return each(rows.join(saved(peaks(rows, key), "peaks"), key), F.when(F.col("peak") > 1, F.transform("x", lambda v: v / F.col("peak"))).otherwise(F.col("x"))).drop("peak", "mean_square")


def loudness_normalize(rows: DataFrame, key: str, loudness: DataFrame, target: float) -> DataFrame:
    """Gain to the target loudness (key, loudness; none where it is not finite), then peak_normalize."""
    level = F.col("loudness")
    gain = F.when(level.isNotNull() & ~F.isnan(level) & (F.abs(level) < float("inf")), F.pow(F.lit(10.0), (target - level) / 20)).otherwise(1.0)
    known = saved(loudness.select(key, gain.alias("_gain")), "gains")
    return peak_normalize(each(rows.join(known, key, "left"), F.transform("x", lambda v: v * F.coalesce(F.col("_gain"), F.lit(1.0)))).drop("_gain"), key)


def mix_at_snr(rows: DataFrame, key: str, noise: DataFrame, pick: Column, snr: float) -> DataFrame:
    """Pieces plus a stretch of noise (repeated if short) from a keyed start, at the signal-to-noise ratio of the whole signal.

    noise: key, samples (a clip for each signal). The powers come from one row for each piece.
    """
    size = F.size("samples")
    tape = F.when(size < F.col("n"), size * (F.floor(F.col("n") / size) + 1)).otherwise(size)
    start = F.pmod(pick, tape - F.col("n") + 1)
    met = rows.join(noise, key).withColumn("_start", start + F.col("begin"))
    both = saved(met.select(*rows.columns, F.transform("x", lambda v, i: F.get("samples", ((F.col("_start") + i) % size).cast("int"))).alias("_p")), "noisy")
    square = lambda c: arrays.total(F.transform(c, lambda v: v * v))
    power = both.groupBy(key).agg((F.sum(square("x")) / F.max("n")).alias("_a"), (F.sum(square("_p")) / F.max("n")).alias("_b"))
    floor = lambda c: F.greatest(F.col(c), F.lit(arrays.POWER_FLOOR))
    gain = saved(power.select(key, F.sqrt(floor("_a") / F.pow(F.lit(10.0), F.lit(snr / 10)) / floor("_b")).alias("_gain")), "gains")
    return both.join(gain, key).select(*[c for c in rows.columns if c != "x"], F.zip_with("x", "_p", lambda a, b: a + F.col("_gain") * b).alias("x"))


def mixed(rows: DataFrame, group: str) -> DataFrame:
    """group, piece, x: the sums of the pieces of all signals of a group (a few), place by place; short ones end in zeros."""
    met = rows.groupBy(group, "piece").agg(F.array_sort(F.collect_list("x")).alias("met"))
    longest = F.array_max(F.transform("met", lambda m: F.size(m)))
    places = F.sequence(F.lit(0), longest - 1)
    return met.select(group, "piece", F.transform(places, lambda i: F.aggregate("met", F.lit(0.0), lambda s, m: s + F.coalesce(F.get(m, i), F.lit(0.0)))).alias("x"))
