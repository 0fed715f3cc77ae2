"""Long signals in overlapping chunks, through a function, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import few
from .pieces import SIZE, of_arrays


def chunk_sizes(chunk: int, overlap: int, hop: int) -> tuple[int, int]:
    """Chunk rounded up and overlap down to a multiple of the hop."""
    return -(-chunk // hop) * hop, overlap // hop * hop


def chunk_pieces(pieces: DataFrame, chunk: int, overlap: int, key: str, size: int = SIZE) -> DataFrame:
    """key, n, chunk_idx, start, x: the last chunk is padded with zeros; a short signal is one chunk. No shuffle.

    pieces: of `size` samples, with a halo of a chunk; a chunk is cut out of the piece that it begins in.
    """
    step = chunk - overlap
    last = F.greatest(F.ceil((F.col("n") - chunk) / step), F.lit(0)).cast("long")
    first, end = F.ceil(F.col("begin") / step).cast("long"), F.least(last, F.floor((F.col("begin") + size - 1) / step).cast("long"))
    rows = pieces.withColumn("_first", first).withColumn("_end", end).where("_first <= _end").select(key, "begin", "n", "x", F.explode(F.sequence("_first", "_end")).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    part = F.slice("x", (start - F.col("begin") + 1).cast("int"), chunk)
    x = F.when(F.size(part) == chunk, part).otherwise(F.slice(F.concat(part, F.array_repeat(F.lit(0.0), chunk)), 1, chunk))
    return rows.select(key, F.col("n").cast("int").alias("n"), F.col("chunk_idx").cast("int").alias("chunk_idx"), start.cast("int").alias("start"), x.alias("x"))


def chunk_signals(signals: DataFrame, chunk: int, overlap: int, key: str) -> DataFrame:
    """The same of signals that are one array each (key, x)."""
    return chunk_pieces(of_arrays(signals, key, max(SIZE, chunk), chunk), chunk, overlap, key, max(SIZE, chunk))


def _weight(i: Column, index: Column, n: Column, chunk: int, overlap: int) -> Column:
    """Weight of sample i of a chunk.

    Weights fade in over the overlap where a chunk isn't the first, and out where it isn't the last. The fade-out ends
    where what remains of a chunk ends, so weights may add up to less than 1 near the end.
    """
    if not overlap:
        return F.lit(1.0)
    rise = lambda k: 0.5 * (1 - F.cos(2 * np.pi * k / (2 * overlap)))
    start = index * (chunk - overlap)
    tail = i - (F.least(F.lit(chunk), n - start) - overlap)
    w = F.when((index > 0) & (i < overlap), rise(i)).otherwise(1.0)
    return w * F.when((start + chunk < n) & (tail >= 0), 1 - rise(tail)).otherwise(1.0)


def overlap_add_blocks(chunks: DataFrame, chunk: int, overlap: int, key: str, normalize: bool = True) -> DataFrame:
    """key, block, start, n, x: weighted sums of chunks, in blocks of a step.

    Chunks are cut at the borders of steps, so that a block meets a few arrays (chunk / step at most) and no sample is a row
    of its own. What weights add up to follows from the numbers of the chunks; normalize divides by it.
    """
    step = chunk - overlap
    parts = -(-chunk // step)
    weighted = F.transform("x", lambda v, i: v * _weight(i, F.col("chunk_idx"), F.col("n"), chunk, overlap))
    cut = lambda j: F.struct((F.col("chunk_idx") + j).alias("block"), F.slice(F.col("_w"), j * step + 1, min(step, chunk - j * step)).alias("part"))
    rows = chunks.select(key, "n", "chunk_idx", weighted.alias("_w")).select(key, "n", "chunk_idx", F.explode(F.array(*[cut(j) for j in range(parts)])).alias("_b"))
    rows = rows.select(key, "n", "chunk_idx", "_b.block", "_b.part").where(F.col("block") * step < F.col("n"))
    met = rows.groupBy(key, "block", "n").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "part"))).alias("met"))
    start = F.col("block") * step
    places = F.sequence(F.lit(0), F.least(F.lit(step), F.col("n") - start).cast("int") - 1)
    total = lambda of: F.transform(places, lambda i: F.aggregate("met", F.lit(0.0), lambda s, m: s + of(m, i)))
    # A chunk has no sample at places of its last block behind its end.
    value = lambda m, i: F.coalesce(F.get(m["part"], i), F.lit(0.0))
    weight = lambda m, i: F.when(i < F.size(m["part"]), _weight(start - m["chunk_idx"] * step + i, m["chunk_idx"], F.col("n"), chunk, overlap)).otherwise(0.0)
    s, w = total(value), total(weight)
    x = F.zip_with(s, w, lambda a, b: F.when(b > 1e-12, a / b).otherwise(a)) if normalize else s
    return met.select(key, "block", start.alias("start"), "n", x.alias("x"))


def overlap_add(chunks: DataFrame, chunk: int, overlap: int, key: str, normalize: bool = True) -> DataFrame:
    """key, pos, v: the samples of overlap_add_blocks, one row each."""
    blocks = overlap_add_blocks(chunks, chunk, overlap, key, normalize)
    return blocks.select(key, "start", F.posexplode("x").alias("_i", "v")).select(key, (F.col("start") + F.col("_i")).alias("pos"), "v")


#: Restorers by name: array to array of the same length. A user's own function can be given instead.
RESTORERS = {"identity": lambda x: x, "clamp": lambda x: np.clip(x, -1.0, 1.0), "remove_mean": lambda x: x - x.mean()}


def restorer(name_or_function):
    if callable(name_or_function):
        return name_or_function
    if name_or_function not in RESTORERS:
        raise ValueError(f"unknown restorer {name_or_function}; there are {sorted(RESTORERS)}")
    return RESTORERS[name_or_function]


def restore_chunks(chunks: DataFrame, restore_fn, key: str) -> DataFrame:
    """Chunks through restore_fn (array to array of the same length), an Arrow batch at a time."""
    kind, made = dict(chunks.dtypes)[key], restorer(restore_fn)

    def run(batches):
        for b in few(batches):
            out = [np.asarray(made(np.array(v)), float) for v in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, "n", "chunk_idx", "start")], pa.array(out, pa.list_(pa.float64()))], [key, "n", "chunk_idx", "start", "x"])

    return chunks.select(key, "n", "chunk_idx", "start", "x").mapInArrow(run, f"{key} {kind}, n int, chunk_idx int, start int, x array<double>")


def restore_pieces(pieces: DataFrame, restore_fn, chunk: int, overlap: int, key: str, size: int = SIZE) -> DataFrame:
    """Blocks of all signals after their chunks went through restore_fn. pieces: with a halo of a chunk."""
    return overlap_add_blocks(restore_chunks(chunk_pieces(pieces, chunk, overlap, key, size), restore_fn, key), chunk, overlap, key)


def batch_restore(signals: DataFrame, restore_fn, chunk: int, overlap: int, key: str) -> DataFrame:
    """key, pos, v of signals that are one array each, after their chunks went through restore_fn."""
    return overlap_add(restore_chunks(chunk_signals(signals, chunk, overlap, key), restore_fn, key), chunk, overlap, key)


def restore_folder(spark, source: str, path: str, restore_fn, chunk: int, overlap: int, suffix: str = "_restored.wav", rate: int = 44100) -> list:
    """Every WAV file of a folder through restore_fn, to files of another folder. Returns how many files and samples there are."""
    from ..sources import wav

    size = max(SIZE, chunk)
    blocks = restore_pieces(wav.pieces(spark, source, size, chunk), restore_fn, chunk, overlap, "name", size)
    files = wav.write(blocks.withColumn("file", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(suffix))), "file", path, rate)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("frames").alias("frames")).collect()
