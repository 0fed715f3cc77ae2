import math

import numpy as np
import pytest
from wavespan.operators import loudness, pieces

RATE, BLOCK = 8000, 0.1


def literal(x, rate, block=BLOCK):
    """Sample by sample and block by block."""
    for b, a in loudness.biquads(rate):
        y = []
        for n in range(len(x)):
            old = lambda v, k, n=n: v[n - k] if n >= k else 0.0
            y.append(b[0] * x[n] + b[1] * old(x, 1) + b[2] * old(x, 2) - a[1] * old(y, 1) - a[2] * old(y, 2))
        x = y
    width = round(block * rate)
    step = round(width / 4)
    e = [sum(v * v for v in x[k : k + width]) / width for k in range(0, len(x) - width + 1, step)]
    at = lambda v: -0.691 + 10 * math.log10(v) if v > 0 else -math.inf
    one = [v for v in e if at(v) > -70]
    if not one:
        return None
    gate = at(sum(one) / len(one)) - 10
    two = [v for v in one if at(v) > gate]
    return at(sum(two) / len(two))


@pytest.fixture(scope="module")
def signals():
    r = np.random.default_rng(0)
    tone = np.sin(2 * np.pi * 440 * np.arange(9000) / RATE)
    return {
        1: np.concatenate([tone, np.zeros(3000), 1e-3 * tone, 0.3 * r.normal(size=4000), 1e-5 * r.normal(size=3000)]),
        2: tone[:800], 3: tone[:799], 4: np.zeros(2000), 5: 0.05 * r.normal(size=2500), 6: np.concatenate([0.9 * tone, 0.02 * tone]),
    }


@pytest.mark.parametrize("span", [200, 1600, None])
def test_gated_loudness_of_pieces(spark, signals, span):
    warm, spans, chunk = loudness.stretch(RATE, BLOCK, span)
    size = max(chunk, 4096)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "k long, x array<double>")
    e = loudness.energies(pieces.of_arrays(df, "k", size, chunk), "k", RATE, BLOCK, size, span)
    counts = {r["k"]: r["count"] for r in e.groupBy("k").count().collect()}
    assert counts == {k: (len(v) - 800) // 200 + 1 for k, v in signals.items() if len(v) >= 800} and e.select("k", "block").distinct().count() == e.count()
    got = {r["k"]: r["loudness"] for r in loudness.gated_loudness(e, "k").collect()}
    for k, v in signals.items():
        want = literal(v.tolist(), RATE)
        assert (got.get(k) is None) if want is None or len(v) < 800 else math.isclose(got[k], want, abs_tol=1e-9)
    # The gates leave out what is silent or far below: the loudness is not that of all blocks.
    every = loudness.OFFSET + 10 * math.log10(np.mean([r["energy"] for r in e.where("k = 1").collect()]))
    assert got[1] > every + 1


def test_windows_at_a_target(spark, signals):
    for k, v in signals.items():
        want = literal(v.tolist(), RATE) if len(v) >= 800 else None
        found = loudness.window_loudness(v, RATE, BLOCK)
        assert found == -math.inf if want is None else math.isclose(found, want, abs_tol=1e-9)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "k long, x array<double>")
    got = {r["k"]: np.array(r["x"]) for r in loudness.normalize_windows(df, RATE, -23.0, "k", block=BLOCK).collect()}
    assert math.isclose(loudness.window_loudness(got[1], RATE, BLOCK), -23, abs_tol=1e-6) and math.isclose(loudness.window_loudness(got[5], RATE, BLOCK), -23, abs_tol=1e-6)
    assert np.allclose(got[3], signals[3]) and np.allclose(got[4], 0)
    loud = loudness.normalize_windows(df.where("k = 5"), RATE, 20.0, "k", block=BLOCK).first()["x"]
    assert math.isclose(np.abs(loud).max(), 1.0)


def test_response_fades_out():
    h = loudness.response(RATE, RATE)
    assert np.abs(h[math.ceil(loudness.WARM * RATE) :]).max() < 1e-17
