"""Seeded degradation of windows, spectra, metrics: Arrow batches around keyed fan-out and joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, rng
from ..functions.batches import few

@dataclass(frozen=True)
class Degradation:
    """Mean, deviation, least and largest value of each clipped Gaussian of the degradation model; EQ gains have one for each node (Hz)."""

    nodes: tuple
    eq1: tuple
    eq2: tuple
    drive: tuple
    wet: tuple
    low_cut: tuple
    high_cut: tuple
    low_slope: tuple
    high_slope: tuple
    snr: tuple


#: The published configuration. EQs only cut.
MODEL = Degradation(
    nodes=(40, 80, 160, 320, 640, 1280, 2560, 5120, 10240, 20480),
    eq1=tuple((m, 14.7, -80.0, 0.0) for m in (-9.0, -4.9, -4.9, 0.0, 0.0, -3.1, -1.1, -8.6, -2.1, 0.0)),
    eq2=tuple((m, 14.7, -80.0, 0.0) for m in (-3.0, -4.9, -4.9, 0.0, 0.0, -3.1, -1.1, -8.6, -2.1, 0.0)),
    drive=(2.2, 0.9, 0.75, 4.5),
    wet=(0.18, 0.09, 0.03, 0.4),
    low_cut=(100.0, 50.0, 40.0, 250.0),
    high_cut=(3200.0, 850.0, 2000.0, 5500.0),
    low_slope=(18.0, 8.0, 6.0, 48.0),
    high_slope=(30.0, 10.0, 12.0, 60.0),
    snr=(11.0, 4.5, 2.0, 20.0),
)

NODES = list(map(float, MODEL.nodes))


def degradation_params(df: DataFrame, seed: int, *ids: str, model: Degradation = MODEL) -> DataFrame:
    """df with the parameters of one degradation, which depend on the model, the seed and the ids alone."""
    key = [F.col(c) for c in ids]
    draw = lambda what, of: rng.clipped_gaussian(*of, seed, *key, what)
    low, high = draw("low", model.low_cut), draw("high", model.high_cut)
    gains = lambda name, of: F.array(*[draw(f"{name}_{k}", x) for k, x in enumerate(of)]).alias(name)
    return df.select(
        "*", gains("eq1", model.eq1), gains("eq2", model.eq2), draw("drive", model.drive).alias("drive"), draw("wet", model.wet).alias("wet"),
        F.least(low, high).alias("low_cut"), F.greatest(low, high).alias("high_cut"),
        draw("low_slope", model.low_slope).alias("low_slope"), draw("high_slope", model.high_slope).alias("high_slope"), draw("snr", model.snr).alias("snr"),
    )


def assign_noise(df: DataFrame, noise: DataFrame, seed: int, *ids: str) -> DataFrame:
    """df with noise_idx and samples of a keyed choice. The library is broadcast where Spark finds it small."""
    n = noise.agg(F.count(F.lit(1)).alias("n_noise"))
    keyed = df.join(n).withColumn("noise_idx", F.pmod(rng.key(seed, *[F.col(c) for c in ids], "noise"), F.col("n_noise"))).drop("n_noise")
    return keyed.join(noise, "noise_idx")


@lru_cache(maxsize=8)
def _frequencies(n: int, rate: float) -> np.ndarray:
    return np.fft.rfftfreq(n, 1 / rate)


def filter_signal(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Zero-phase filter over the whole signal; mask has len(x) // 2 + 1 factors."""
    return np.fft.irfft(np.fft.rfft(x) * mask, len(x))


def eq_mask(n: int, rate: float, gains, nodes=NODES) -> np.ndarray:
    f = np.log2(np.maximum(_frequencies(n, rate), 1.0))
    return 10 ** (np.interp(f, np.log2(nodes), gains) / 20)


def bandpass_mask(n: int, rate: float, low: float, high: float, low_slope: float, high_slope: float) -> np.ndarray:
    f = np.maximum(_frequencies(n, rate), 0.5)
    db = np.where(f < low, -low_slope * np.log2(low / f), np.where(f > high, -high_slope * np.log2(f / high), 0.0))
    return 10 ** (np.clip(db, -80, 0) / 20)


def degrade(x: np.ndarray, p: dict, noise: np.ndarray, pick: int, rate: float, nodes=NODES) -> list[np.ndarray]:
    """Signal after each of the five stages: EQ, saturation, second EQ, band-pass, noise."""
    n = len(x)
    one = filter_signal(x, eq_mask(n, rate, p["eq1"], nodes))
    two = (1 - p["wet"]) * one + p["wet"] * np.tanh(p["drive"] * one) / p["drive"]
    second = eq_mask(n, rate, p["eq2"], nodes)
    three = filter_signal(two, second)
    four = filter_signal(two, second * bandpass_mask(n, rate, p["low_cut"], p["high_cut"], p["low_slope"], p["high_slope"]))
    tape = np.tile(noise, n // len(noise) + 1) if len(noise) < n else noise
    at = pick % (len(tape) - n + 1)
    part = tape[at : at + n]
    power = lambda v: max(float(np.mean(v * v)), arrays.POWER_FLOOR)
    five = four + part * np.sqrt(power(four) / 10 ** (p["snr"] / 10) / power(part))
    return [one, two, three, four, five]


PARAMS = ("eq1", "eq2", "drive", "wet", "low_cut", "high_cut", "low_slope", "high_slope", "snr")


def _augmented(made, args: list[tuple], rate: float) -> list:
    """All results of a batch. Errors of a user's function are its own: only a batch method that says so is done without."""
    if args and hasattr(made, "batch"):
        found = made.batch(*zip(*args, strict=True), rate)
        if found is not NotImplemented:
            return found
    return [made(*a, rate) for a in args]


def augment(windows: DataFrame, noise: DataFrame, n: int, seed: int, rate: float, *ids: str, keep: tuple[str, ...] = (), stages: bool = False, augment_fn=None, model: Degradation = MODEL, with_clean: bool = False) -> DataFrame:
    """n degraded variants of each window (columns ids, keep and x): ids, degradation_idx, keep, stage, x. Draws depend on ids, not on keep.

    augment_fn, a function like degrade, takes the place of the built-in chain. A function with a method `batch` gets
    lists of all arguments of some rows of an Arrow batch at once; if it gives NotImplemented, rows are done one by one. with_clean: the
    window itself comes too, as variant -1, so that its samples need reading once.
    """
    keys = [*ids, "degradation_idx"]
    cols_kept = [*keys, *keep]
    rows = windows.select(*ids, *keep, "x", F.explode(F.sequence(F.lit(-1 if with_clean else 0), F.lit(n - 1))).alias("degradation_idx"))
    rows = assign_noise(degradation_params(rows, seed, *keys, model=model), noise, seed, *keys).withColumn("pick", rng.key(seed, *[F.col(c) for c in keys], "start"))
    made = augment_fn or partial(degrade, nodes=model.nodes)

    def run(batches):
        for b in few(batches):
            cols = {c: b.column(c).to_pylist() for c in ("x", "samples", "pick", *PARAMS)}
            at, stage, out = [], [], []
            todo = [k for k, d in enumerate(b.column("degradation_idx").to_pylist()) if d >= 0]
            args = [(np.array(cols["x"][k]), {c: cols[c][k] for c in PARAMS}, np.array(cols["samples"][k]), cols["pick"][k]) for k in todo]
            for k in set(range(b.num_rows)).difference(todo):
                at.append(k)
                stage.append(0)
                out.append(cols["x"][k])
            for k, each in zip(todo, _augmented(made, args, rate), strict=True):
                for s, v in enumerate(each, 1) if stages else [(len(each), each[-1])]:
                    at.append(k)
                    stage.append(s)
                    out.append(v)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in cols_kept], pa.array(stage, pa.int32()), pa.array(out, pa.list_(pa.float64()))], [*cols_kept, "stage", "x"])

    kinds = dict(rows.dtypes)
    return rows.select(*cols_kept, "x", "samples", "pick", *PARAMS).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in cols_kept) + ", stage int, x array<double>")


def frequency_response(df: DataFrame, gains: list[float], rate: float, *ids: str) -> DataFrame:
    """x of each row through a static equaliser."""

    def run(batches):
        for b in few(batches):
            x = [np.array(v) for v in b.column("x").to_pylist()]
            out = [filter_signal(v, eq_mask(len(v), rate, gains)) for v in x]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array(out, pa.list_(pa.float64()))], [*ids, "x"])

    return df.select(*ids, "x").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids) + ", x array<double>")


def stft(x: np.ndarray, n_fft: int, hop: int, win: int) -> np.ndarray:
    """Centred frames (reflected ends), periodic Hann window: complex, bins x frames."""
    pad = n_fft // 2
    x = np.pad(x, pad, mode="reflect" if len(x) > pad else "constant")
    w = np.zeros(n_fft)
    w[(n_fft - win) // 2 : (n_fft - win) // 2 + win] = 0.5 * (1 - np.cos(2 * np.pi * np.arange(win) / win))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.fft.rfft(frames * w, axis=1).T


def istft(z: np.ndarray, length: int, n_fft: int, hop: int, win: int) -> np.ndarray:
    """Inverse of stft: weighted overlap-add over the squared window's sum."""
    w = np.zeros(n_fft)
    w[(n_fft - win) // 2 : (n_fft - win) // 2 + win] = 0.5 * (1 - np.cos(2 * np.pi * np.arange(win) / win))
    frames = np.fft.irfft(z.T, n_fft, axis=1) * w
    total = np.zeros(n_fft + hop * (len(frames) - 1))
    weight = np.zeros_like(total)
    for k, f in enumerate(frames):
        total[k * hop : k * hop + n_fft] += f
        weight[k * hop : k * hop + n_fft] += w * w
    out = total / np.where(weight > 1e-11, weight, 1)
    return out[n_fft // 2 : n_fft // 2 + length]


@lru_cache(maxsize=8)
def mel_filters(n_fft: int, n_mels: int, rate: float) -> np.ndarray:
    """Triangles with equal steps on the mel scale 2595 log10(1 + f / 700), without area normalisation."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[None]
    up, down = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def stft_features(df: DataFrame, *ids: str, n_fft: int = 1024, hop: int = 256, win: int = 1024) -> DataFrame:
    """ids, n_samples, re, im (bins x frames) of each x."""

    def run(batches):
        kind = pa.list_(pa.list_(pa.float64()))
        for b in few(batches):
            x = [np.array(v) for v in b.column("x").to_pylist()]
            z = [stft(v, n_fft, hop, win) for v in x]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array([len(v) for v in x], pa.int64()), pa.array([v.real.tolist() for v in z], kind), pa.array([v.imag.tolist() for v in z], kind)], [*ids, "n_samples", "re", "im"])

    return df.select(*ids, "x").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids) + ", n_samples long, re array<array<double>>, im array<array<double>>")


def istft_signals(df: DataFrame, *ids: str, n_fft: int = 1024, hop: int = 256, win: int = 1024) -> DataFrame:
    """ids, x from the columns of stft_features."""

    def run(batches):
        for b in few(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("re", "im", "n_samples")), strict=True)
            out = [istft(np.array(re) + 1j * np.array(im), n, n_fft, hop, win) for re, im, n in rows]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array(out, pa.list_(pa.float64()))], [*ids, "x"])

    return df.select(*ids, "re", "im", "n_samples").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids) + ", x array<double>")


def log_spectrogram(features: DataFrame, *ids: str) -> DataFrame:
    """log1p of the magnitudes, scaled to [0, 1] within a row."""
    mag = F.zip_with("re", "im", lambda a, b: F.zip_with(a, b, lambda p, q: F.log1p(F.sqrt(p * p + q * q))))
    low, high = F.array_min(F.transform("m", F.array_min)), F.array_max(F.transform("m", F.array_max))
    scaled = F.transform("m", lambda row: F.transform(row, lambda v: F.when(F.col("high") > F.col("low"), (v - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)))
    return features.select(*ids, mag.alias("m")).withColumns({"low": low, "high": high}).select(*ids, scaled.alias("spectrogram"))


def stft_stats(features: DataFrame) -> DataFrame:
    """part, bin, mean, std over all rows and frames."""
    part = lambda c: features.select(F.lit(c).alias("part"), F.posexplode(c).alias("bin", "row")).select("part", "bin", F.explode("row").alias("v"))
    g = part("re").unionAll(part("im")).groupBy("part", "bin").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"))
    return g.select("part", "bin", F.col("m").alias("mean"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-12))).alias("std"))


#: Fixed values: (n_fft, hop, window) of the multi-resolution metrics.
RESOLUTIONS = ((1024, 120, 600), (2048, 240, 1200), (512, 50, 240))


def pair_metrics(a: np.ndarray, b: np.ndarray, rate: float) -> dict[str, float]:
    """Spectral differences of a prediction and its target, cropped to the shorter."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    za, zb = stft(a, 1024, 256, 1024), stft(b, 1024, 256, 1024)
    sq = lambda d: float(np.mean(np.abs(d) ** 2))
    mel = mel_filters(1024, 128, rate)
    out = {"stft_mse": sq(za - zb) / 2, "mel_mse": sq(mel @ np.abs(za) - mel @ np.abs(zb))}
    complex_mse, converge, log_l1 = [], [], []
    for n_fft, hop, win in RESOLUTIONS:
        x, y = stft(a, n_fft, hop, win), stft(b, n_fft, hop, win)
        mx, my = np.maximum(np.abs(x), 1e-7), np.maximum(np.abs(y), 1e-7)
        complex_mse.append(sq(x - y) / 2)
        converge.append(float(np.linalg.norm(my - mx) / np.linalg.norm(my)))
        log_l1.append(float(np.mean(np.abs(np.log(my) - np.log(mx)))))
    scales = []
    for n_fft in (2048, 1024, 512, 256):
        x, y = (np.abs(stft(v, n_fft, n_fft // 4, n_fft)) for v in (a, b))
        scales.append(0.9 * float(np.mean(np.abs(x - y))) + 0.1 * sq(np.log10(np.maximum(x, 1e-5)) - np.log10(np.maximum(y, 1e-5))))
    return out | {"multi_complex_mse": float(np.mean(complex_mse)), "multi_convergence": float(np.mean(converge)), "multi_log_l1": float(np.mean(log_l1)), "multi_scale": float(np.mean(scales))}


def spectral_metrics(pairs: DataFrame, rate: float, *ids: str) -> DataFrame:
    """ids, metric, value for every pair (a: prediction, b: target)."""

    def run(batches):
        for b in few(batches):
            each = [pair_metrics(np.array(p), np.array(q), rate) for p, q in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            take = pa.array([k for k, m in enumerate(each) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ids], pa.array([x for m in each for x in m], pa.string()), pa.array([v for m in each for v in m.values()], pa.float64())], [*ids, "metric", "value"])

    return pairs.select(*ids, "a", "b").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in ids) + ", metric string, value double")


def score_items(df: DataFrame, score_fn, *ids: str) -> DataFrame:
    """ids, score, error: an optional scorer; where there is none or it fails, the score is null and the job goes on."""

    def run(batches):
        for b in few(batches):
            scores, errors = [], []
            for v in b.column("x").to_pylist():
                try:
                    scores.append(None if score_fn is None else float(score_fn(np.array(v))))
                    errors.append("no scorer" if score_fn is None else None)
                except Exception as e:  # noqa: BLE001  any failure of a foreign scorer
                    scores.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array(scores, pa.float64()), pa.array(errors, pa.string())], [*ids, "score", "error"])

    return df.select(*ids, "x").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ids) + ", score double, error string")
