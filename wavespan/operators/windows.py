"""Windows of recordings: hop, enumeration, contiguous ids, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from .ranks import in_order, with_positions


def resolve_hop(segment: int, hop_samples: int | None = None, hop_seconds: float | None = None, hop_fraction: float | None = None, rate: int = 44100, divisor: int = 10) -> int:
    """Hop in samples: samples go before seconds, these before the fraction of a segment, this before the divisor."""
    if hop_samples is not None:
        hop = hop_samples
    elif hop_seconds is not None:
        hop = round(hop_seconds * rate)
    elif hop_fraction is not None:
        hop = round(segment * hop_fraction)
    else:
        hop = segment // divisor
    if not 0 < hop <= segment:
        raise ValueError("the hop must be over 0 and at most a segment")
    return hop


def overlap_radius(segment: int, hop: int) -> int:
    """How many neighbours on a side a window overlaps."""
    return -(-segment // hop) - 1


def window_count(frames: Column, segment: int, hop: int) -> Column:
    """Full windows in so many frames."""
    return F.when(frames >= segment, F.floor((frames - segment) / hop) + 1).otherwise(0).cast("long")


def make_windows(sources: DataFrame, segment: int, hop: int) -> DataFrame:
    """One row for each full window: the columns of sources (with num_frames), local_idx, start_sample. No shuffle."""
    long = sources.where(F.col("num_frames") >= segment)
    last = F.floor((F.col("num_frames") - segment) / hop).cast("long")
    return long.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("local_idx")).withColumn("start_sample", F.col("local_idx") * hop)


def dense_index(df: DataFrame, by: str, name: str) -> DataFrame:
    """Dense 0-based index of the sorted distinct values of a column (one or many rows each)."""
    keys = saved(in_order(df.select(by).distinct(), by), "keys")
    return df.join(with_positions(keys, name), by)


def global_index(sources: DataFrame, segment: int, hop: int) -> DataFrame:
    """Windows with contiguous global_idx in (source_idx, local_idx) order: the offsets come from sources alone."""
    n = sources.select("source_idx", window_count(F.col("num_frames"), segment, hop).alias("n_windows"))
    offsets = with_positions(saved(in_order(n, "source_idx"), "sources"), "offset", F.col("n_windows")).select("source_idx", "offset")
    return make_windows(sources, segment, hop).join(offsets, "source_idx").withColumn("global_idx", F.col("offset") + F.col("local_idx")).drop("offset")


def contiguous_shard(index: Column, total: Column | int, shards: int) -> Column:
    """Shard k has [total * k div shards, total * (k + 1) div shards)."""
    total = total if isinstance(total, Column) else F.lit(total)
    return F.floor(((index + 1) * shards - 1) / total).cast("long")


def strided_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("long")


def fan_out(windows: DataFrame, n: int) -> DataFrame:
    """Each window with degradation_idx 0 .. n - 1. No shuffle."""
    return windows.withColumn("degradation_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
