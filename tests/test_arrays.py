import numpy as np
import pytest
from pyspark.sql import functions as F
from wavespan.functions import arrays, rng
from wavespan.operators import augment, chunks, evaluate
from wavespan.plans import dataset


@pytest.fixture(scope="module")
def signals(spark):
    r = np.random.default_rng(0)
    return spark.createDataFrame([(k, r.normal(size=200 + 10 * k).tolist()) for k in range(4)], "k long, x array<double>")


@pytest.fixture(scope="module")
def noise(spark):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(k, r.normal(size=50 + 300 * k).tolist()) for k in range(2)], "noise_idx long, samples array<double>")


def test_column_curves_are_the_numpy_ones(spark):
    n, rate, gains = 256, 44100.0, [float(k - 5) for k in range(10)]
    f = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.fft.rfftfreq(n, 1 / rate))], "k long, f double")
    lit = [F.lit(g) for g in gains]
    got = f.select("k", arrays.eq_gain(F.col("f"), augment.NODES, lit).alias("eq"), arrays.bandpass_gain(F.col("f"), F.lit(300.0), F.lit(3000.0), F.lit(12.0), F.lit(18.0)).alias("bp")).orderBy("k").toPandas()
    assert np.allclose(got["eq"], augment.eq_mask(n, rate, gains))
    assert np.allclose(got["bp"], augment.bandpass_mask(n, rate, 300, 3000, 12, 18))


def test_round_trips(spark, signals):
    z = augment.stft_features(signals, "k", n_fft=64, hop=16, win=64)
    back = {r["k"]: r["x"] for r in augment.istft_signals(z, "k", n_fft=64, hop=16, win=64).collect()}
    for r in signals.collect():
        assert np.allclose(back[r["k"]], r["x"])
    shown = augment.log_spectrogram(z, "k").first()["spectrogram"]
    assert np.min(shown) == 0 and np.max(shown) == 1


def test_augment_depends_on_keys_alone(signals, noise):
    one, many = (sorted((r["k"], r["degradation_idx"], tuple(r["x"])) for r in augment.augment(signals.repartition(p), noise, 2, 7, 44100.0, "k").collect()) for p in (1, 7))
    assert one == many and len(one) == 8
    stages = augment.augment(signals, noise, 2, 7, 44100.0, "k", stages=True).where("stage = 5").collect()
    assert sorted((r["k"], r["degradation_idx"], tuple(r["x"])) for r in stages) == one


def test_snr_of_mix(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0, -1.0, 0.5], [0.1, 0.2, -0.3], 1)], "x array<double>, n array<double>, k long")
    x, y = df.select("x", arrays.mix_at_snr(F.col("x"), F.col("n"), F.col("k"), F.lit(10.0)).alias("y")).first()
    x, noise = np.array(x), np.array(y) - np.array(x)
    assert np.isclose(10 * np.log10((x**2).mean() / (noise**2).mean()), 10)


def literal_overlap_add(x, chunk, overlap):
    """The rule written as a loop: fade in unless first, fade out of what remains unless the chunk reaches the end."""
    step, out, fade = chunk - overlap, np.zeros(len(x)), 0.5 * (1 - np.cos(np.pi * np.arange(overlap) / overlap))
    for start in range(0, max(len(x) - chunk, 0) + step, step):
        part = np.array(x[start : start + chunk], float)
        if not len(part):
            break
        if start:
            part[: min(overlap, len(part))] *= fade[: len(part)]
        if start + chunk < len(x):
            part[len(part) - overlap :] *= 1 - fade
        out[start : start + len(part)] += part
    return out


@pytest.mark.parametrize("n", [5, 16, 17, 40, 200])
def test_overlap_add(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    c = chunks.chunk_signals(spark.createDataFrame([(1, x.tolist())], "k long, x array<double>"), 16, 8, "k")
    plain = [r["v"] for r in chunks.overlap_add(c, 16, 8, "k", normalize=False).orderBy("pos").collect()]
    assert np.allclose(plain, literal_overlap_add(x, 16, 8))
    assert np.allclose([r["v"] for r in chunks.overlap_add(c, 16, 8, "k").orderBy("pos").collect()], x)


def test_metrics(spark, signals):
    same = augment.spectral_metrics(signals.selectExpr("k", "x AS a", "x AS b"), 44100.0, "k").groupBy("metric").agg(F.max("value").alias("m")).collect()
    assert len(same) == 6 and all(abs(r["m"]) < 1e-9 for r in same)
    x, y = np.sin(np.arange(3000) / 5), np.sin(np.arange(3100) / 7)
    z = augment.stft(x, 1024, 256, 1024) - augment.stft(y[:3000], 1024, 256, 1024)
    assert np.isclose(augment.pair_metrics(x, y, 44100.0)["stft_mse"], np.mean([(z.real**2).mean(), (z.imag**2).mean()]))


def test_scorers_may_fail(signals):
    def bad(x):
        raise RuntimeError("broken")

    assert {r["error"] for r in augment.score_items(signals, bad, "k").collect()} == {"broken"}
    assert {r["error"] for r in augment.score_items(signals, None, "k").collect()} == {"no scorer"}


def test_plug_ins(signals):
    with pytest.raises(ValueError):
        dataset.encoder("nothing")
    own = dataset.latent_stats(signals, lambda x: x[None, :]).first()
    every = np.concatenate([r["x"] for r in signals.collect()])
    assert np.isclose(own["mean"], every.mean()) and np.isclose(own["std"], every.std())


def test_draws_are_normal(spark):
    d = spark.range(4000).select(rng.gaussian(2.0, 3.0, 1, F.col("id")).alias("g")).toPandas()["g"]
    assert abs(d.mean() - 2) < 0.2 and abs(d.std() - 3) < 0.2


def test_t_quantiles():
    assert [round(evaluate.t_quantile(k), 4) for k in (1, 15, 100)] == [12.7062, 2.1314, 1.9840]


def test_channel_first(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],), ([[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]],)], "x array<array<double>>")
    rows = [r["y"] for r in df.select(arrays.channel_first(F.col("x"), 2).alias("y")).collect()]
    assert rows[0] == rows[1] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]
