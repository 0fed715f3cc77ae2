import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavespan.operators import augment, chunks, evaluate, manifest
from wavespan.sources import audio


def test_selection_precedence(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"global_window_indices": [5, 3]}')
    pick = lambda *a: [r["global_idx"] for r in audio.selected_windows(spark, *a).orderBy("pos").collect()]
    assert pick([9, 1], str(tmp_path / "s.json"), (7,)) == [9, 1] and pick(None, str(tmp_path / "s.json"), (7,)) == [5, 3] and pick(None, None, (7,)) == [7]
    with pytest.raises(ValueError):
        audio.selected_windows(spark, [1, 1])


def test_many_degrees_of_freedom(spark):
    got = spark.range(200, 2000, 300).select(evaluate.t_expansion(F.col("id").cast("double")).alias("t")).collect()
    for k, r in zip(range(200, 2000, 300), got, strict=True):
        assert math.isclose(r["t"], evaluate.t_quantile(k), abs_tol=1e-6)


def test_batch_augmenter_and_its_fallback(spark):
    class Double:
        def __call__(self, x, p, noise, pick, rate):
            return [x * 2]

        def batch(self, xs, ps, noises, picks, rate):
            if any(len(x) > 3 for x in xs):
                return NotImplemented
            return [[x * 3] for x in xs]

    noise = spark.createDataFrame([(0, [0.1, 0.2])], "noise_idx long, samples array<double>")
    for x, factor in (([1.0, 2.0], 3), ([1.0, 2.0, 3.0, 4.0], 2)):
        out = augment.augment(spark.createDataFrame([(1, x)], "k long, x array<double>"), noise, 2, 1, 44100.0, "k", augment_fn=Double()).collect()
        assert len(out) == 2 and all(np.allclose(r["x"], np.array(x) * factor) for r in out)


def test_errors_of_an_augmenter_are_not_hidden(spark):
    class Broken:
        def __call__(self, *a):
            return [a[0]]

        def batch(self, *a):
            raise ValueError("broken augmenter")

    noise = spark.createDataFrame([(0, [0.1, 0.2])], "noise_idx long, samples array<double>")
    with pytest.raises(Exception, match="broken augmenter"):
        augment.augment(spark.createDataFrame([(1, [0.5])], "k long, x array<double>"), noise, 1, 1, 44100.0, "k", augment_fn=Broken()).collect()


def test_a_user_gives_another_degradation(spark):
    flat = augment.Degradation(nodes=(100, 1000), eq1=((-3.0, 0.0, -3.0, -3.0),) * 2, eq2=((0.0, 0.0, 0.0, 0.0),) * 2, drive=(1.0, 0.0, 1.0, 1.0), wet=(0.0,) * 4, low_cut=(40.0, 0.0, 40.0, 40.0), high_cut=(5000.0, 0.0, 5000.0, 5000.0), low_slope=(6.0, 0.0, 6.0, 6.0), high_slope=(9.0, 0.0, 9.0, 9.0), snr=(20.0, 0.0, 20.0, 20.0))
    r = augment.degradation_params(spark.range(1), 1, "id", model=flat).first()
    assert list(r["eq1"]) == [-3.0, -3.0] and (r["low_slope"], r["high_slope"], r["snr"]) == (6.0, 9.0, 20.0)
    own = augment.degradation_params(spark.range(50), 1, "id").collect()
    assert all(g <= 0 for r in own for g in [*r["eq1"], *r["eq2"]])


def test_restorers_by_name():
    assert chunks.restorer("clamp")(np.array([2.0, -3.0])).tolist() == [1.0, -1.0]
    with pytest.raises(ValueError):
        chunks.restorer("unknown")


def test_shards_disjoint(spark):
    rows = [(1, 0, 5), (1, 1, 6), (1, 0, 5), (2, 0, 5), (2, 1, 5)]
    got = {r["run"]: r["disjoint"] for r in evaluate.shards_disjoint(spark.createDataFrame(rows, "run int, worker int, sample int")).collect()}
    assert got == {1: True, 2: False}


def test_expected_assets(spark):
    rows = spark.createDataFrame([(1, "a", "a", 44100, 2, 5.0, -20.0, 0.0)], "doc_id long, found_sha256 string, listed_sha256 string, sample_rate int, channels int, duration double, mean_db double, peak_db double")
    assert [r["rule"] for r in manifest.media_failures(rows, expected=2).collect()] == ["row_count"] and manifest.media_failures(rows, expected=1).count() == 0


def test_inventory_counts_files(spark, duck):
    """Every file that the tasks wrote is counted, and a large dataset is several files."""
    from wavespan.plans.queries import QUERIES

    n = dict(duck.execute("SELECT source, count(DISTINCT doc_id // 3 % 4) FROM documents GROUP BY source").fetchall())
    got = {r["song"]: r["n_files"] for r in QUERIES["scan_audio_inventory"](spark, "/root/testdata/sf0.001").collect()}
    assert got == n and max(n.values()) > 1


def test_rows_become_objects_a_few_at_a_time():
    import pyarrow as pa
    from wavespan.functions.batches import ROWS, few

    b = pa.record_batch({"x": list(range(3 * ROWS + 5))})
    got = list(few([b, b.slice(0, 0)]))
    assert max(p.num_rows for p in got) == ROWS and [v for p in got for v in p.column("x").to_pylist()] == list(range(3 * ROWS + 5))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pairs_are_dealt_out_once(spark):
    """Rows are not added up before they are dealt out, and grouping by window needs no other shuffle."""
    from wavespan import fixtures as fx

    assert _shuffles(evaluate.completeness(fx.pairs(spark, "/root/testdata/sf0.001"), 4)) == 1


def test_splits_are_checked_in_one_shuffle(spark):
    from wavespan.operators import split

    ids = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 3)], "source_idx long, local_idx long")
    rows = spark.createDataFrame([(1, 0, "train"), (1, 0, "validate"), (1, 1, "other"), (2, 0, "discard"), (2, 7, "train"), (None, 3, "train")], "source_idx long, local_idx long, split string")
    made = split.partition_check(rows, ids, "source_idx", "local_idx")
    assert _shuffles(made) <= 2
    assert {r["check"]: r["n"] for r in made.collect()} == {"not_covered_or_unknown": 3, "train_and_validate": 1, "train_and_discard": 0, "validate_and_discard": 0}


def test_draws_are_spread_over_tasks(spark):
    """One file of one row group has tens of thousands of windows, which are drawn for in several tasks."""
    import math

    from wavespan.plans.queries import QUERIES
    from wavespan.shared import COSTLY_ROWS

    made = QUERIES["degradation_params"](spark, "/root/testdata/sf0.01")
    tasks = made.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == math.ceil(made.count() / COSTLY_ROWS) > 1
