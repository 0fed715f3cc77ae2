import wave

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F
from wavespan import fixtures as fx
from wavespan.functions import arrays
from wavespan.operators import chunks, pieces, windows
from wavespan.operators.ranks import in_order, with_positions
from wavespan.plans.queries import QUERIES
from wavespan.shared import saved, scratch
from wavespan.sources import audio, wav


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["source_index", "group_index", "global_window_index", "contiguous_shard", "strided_shard"])
def test_no_row_goes_through_one_task(spark, name):
    # The only rows that meet in one task are totals.
    text = plan(QUERIES[name](spark, DATA))
    assert "Window [row_number" not in text and "dense_rank" not in text
    assert text.count("SinglePartition") == (1 if name == "contiguous_shard" else 0)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_positions_and_sums_before(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 5).alias("w"))
        placed = saved(in_order(df, "k"), "placed")
        assert all(r["k"] == r["pos"] for r in with_positions(placed, "pos").collect())
        sums = {r["k"]: r["s"] for r in with_positions(placed, "s", F.col("w")).collect()}
        total = 0
        for k, w in sorted((r["k"], r["w"]) for r in df.collect()):
            assert sums[k] == total
            total += w
        assert with_positions(saved(in_order(df.limit(0), "k"), "none"), "pos").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def long(spark):
    """One signal with most samples, a few short ones."""
    r = np.random.default_rng(2)
    x = {1: r.normal(size=1003), 2: r.normal(size=5), 3: r.normal(size=64), 4: r.normal(size=65)}
    rows = [(k, t, float(v)) for k, own in x.items() for t, v in enumerate(own)]
    df = spark.createDataFrame(rows, "k long, t long, v double").repartition(5, "v")
    return x, pieces.numbered(df, "k", "t")


@pytest.mark.parametrize("size", [16, 32, 64, 4096])
def test_chunks_of_pieces_give_signals_back(long, size):
    x, samples = long
    rows = pieces.pieces(samples, "k", size, 16)
    assert rows.count() == sum(-(-len(v) // size) for v in x.values())
    c = chunks.chunk_pieces(rows, 16, 8, "k", size)
    got = {}
    for r in chunks.overlap_add_blocks(c, 16, 8, "k").orderBy("k", "start").collect():
        got.setdefault(r["k"], []).extend(r["x"])
    assert set(got) == set(x) and all(np.allclose(got[k], x[k]) for k in x)
    whole = chunks.chunk_signals(c.sparkSession.createDataFrame([(k, v.tolist()) for k, v in x.items()], "k long, x array<double>"), 16, 8, "k")
    assert sorted(map(tuple, ((r["k"], r["chunk_idx"], tuple(r["x"])) for r in c.collect()))) == sorted((r["k"], r["chunk_idx"], tuple(r["x"])) for r in whole.collect())


@pytest.mark.parametrize("size", [32, 4096])
def test_measures_of_pieces_are_those_of_signals(spark, long, size):
    x, samples = long
    rows = pieces.pieces(samples, "k", size)
    put = lambda df: {k: np.concatenate([r["x"] for r in df.where(F.col("k") == k).orderBy("piece").collect()]) for k in x}
    for k, v in put(pieces.peak_normalize(rows, "k")).items():
        assert np.allclose(v, x[k] / max(1, abs(x[k]).max()))
    noise = {1: np.arange(1, 8.0), 2: np.arange(1, 3.0), 3: np.arange(5, 500.0), 4: np.array([2.0])}
    clips = spark.createDataFrame([(k, v.tolist()) for k, v in noise.items()], "k long, samples array<double>")
    got = put(pieces.mix_at_snr(rows, "k", clips, F.col("k") * 3, 12.0))
    arrays_ = spark.createDataFrame([(k, v.tolist(), noise[k].tolist()) for k, v in x.items()], "k long, x array<double>, s array<double>")
    for r in arrays_.select("k", arrays.mix_at_snr(F.col("x"), F.col("s"), F.col("k") * 3, F.lit(12.0)).alias("x")).collect():
        assert np.allclose(got[r["k"]], r["x"])
    both = pieces.mixed(rows.withColumn("g", F.lit(1)), "g").orderBy("piece").collect()
    want = np.zeros(1003)
    for v in x.values():
        want[: len(v)] += v
    assert np.allclose(np.concatenate([r["x"] for r in both]), want)


def test_a_hot_user_is_many_rows_and_tasks(spark, tmp_path):
    e = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("user_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), F.rand(1).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    rows = fx.pieces(spark, str(tmp_path), size=64).where("user_id = 7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in tasks) == -(-(2000 + 40) // 64) and len(tasks) == 4


def test_shuffle_of_overlap_add_is_arrays(spark):
    c = chunks.chunk_pieces(fx.pieces(spark, DATA, halo=16), 16, 8, "user_id")
    blocks = chunks.overlap_add_blocks(c, 16, 8, "user_id")
    most = blocks.count()
    samples = fx.table(spark, DATA, "events").count()
    assert most <= samples / 8 + 15  # a row for each block of a step


def test_wav_ranges(spark, tmp_path):
    x = np.random.default_rng(0).integers(-30000, 30000, 5001)
    for name, channels in (("mono.wav", 1), ("stereo.WAV", 2)):
        with wave.open(f"{tmp_path}/{name}", "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(x[: 5000 if channels == 2 else 5001].astype("<i2").tobytes())
    (tmp_path / "odd.wav").write_bytes(b"RIFF\0\0\0\0WAVELIST" + (6).to_bytes(4, "little") + b"abcdef" + wav.header_bytes(3, 8000)[12:36] + b"data" + b"\xff" * 4 + np.array([1, 2, 3], "<i2").tobytes())
    for task in (1000, 1 << 25):
        df = wav.read(spark, str(tmp_path), size=100, halo=7, bytes=task)
        assert df.rdd.getNumPartitions() == (21 if task == 1000 else 1)
        for name, want in (("mono.wav", x / 32768), ("stereo.WAV", x[:5000].reshape(-1, 2).mean(1) / 32768), ("odd.wav", np.array([1, 2, 3]) / 32768)):
            rows = df.where(F.col("name") == name).orderBy("piece").collect()
            assert [r["begin"] for r in rows] == list(range(0, len(want), 100)) and {r["n"] for r in rows} == {len(want)}
            assert all(np.allclose(r["x"], want[r["begin"] : r["begin"] + 107]) for r in rows)
    heads = {r["name"]: (r["rate"], r["frames"], r["channels"]) for r in audio.probe(spark, str(tmp_path)).collect()}
    assert heads == {"mono.wav": (8000, 5001, 1), "stereo.WAV": (8000, 2500, 2), "odd.wav": (8000, 3, 1)}
    got = audio.read_windows(spark, str(tmp_path), 64, 10, 128).where("name = 'mono.wav'").orderBy("local_idx").collect()
    assert [r["start_sample"] for r in got] == list(range(0, 5001 - 63, 10)) and all(np.allclose(r["x"], x[r["start_sample"] : r["start_sample"] + 64] / 32768) for r in got)


def test_written_files(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-1.5, 1.5, 1000)
    df = pieces.of_arrays(spark.createDataFrame([("a.wav", x.tolist()), ("b.wav", [0.5])], "name string, x array<double>"), "name", 64).repartition(7, "piece")
    files = {r["file"]: r["frames"] for r in wav.write(df, "name", f"{tmp_path}/out", 16000).collect()}
    assert files == {"a.wav": 1000, "b.wav": 1} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"]
    with wave.open(f"{tmp_path}/out/a.wav") as w:
        assert (w.getframerate(), w.getnframes()) == (16000, 1000)
        assert (np.frombuffer(w.readframes(1000), "<i2") == np.rint(np.clip(x, -1, 1) * 32767)).all()
    with pytest.raises(Exception, match="missing or there twice"):
        wav.write(df.where("piece <> 3"), "name", f"{tmp_path}/bad").collect()


def test_dense_index_of_repeated_keys(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(50)], "k long, v long")
    assert all(r["i"] == r["k"] for r in windows.dense_index(df, "k", "i").collect())


def test_scratch_has_one_owner(spark):
    """Tables lie in a folder of the application, which can be deleted as a whole."""
    import os

    saved(spark.range(3), "three")
    own = os.path.dirname(scratch(spark, "next"))
    assert os.path.basename(own) == spark.sparkContext.applicationId and any(n.startswith("three-") for n in os.listdir(own))
