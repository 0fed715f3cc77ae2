import glob
import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavespan.operators import augment
from wavespan.plans import dataset

RATE = 8000
CONFIG = dataset.Config(segment=64, hop=16, variants=2, seed=7, target=0.2, rate=RATE, encoder="samples")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, r = tmp_path_factory.mktemp("wav"), np.random.default_rng(0)
    for k in range(6):
        with wave.open(f"{path}/s{k}.wav", "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes(r.integers(-9000, 9000, 200 + 40 * k).astype("<i2").tobytes())
    return str(path)


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(f"rec{k // 2}", "full_mix" if k % 2 == 0 else "section_mix", f"set{k % 3}", "song", "full_mix" if k % 2 == 0 else "strings", f" s{k}.wav") for k in range(6)]
    return spark.createDataFrame(rows, "recording_id string, kind string, dataset string, song string, family string, output_file string")


@pytest.fixture(scope="module")
def noise(spark):
    return spark.createDataFrame([(0, np.random.default_rng(1).normal(size=300).tolist())], "noise_idx long, samples array<double>")


@pytest.fixture(scope="module")
def built(spark, folder, listed, noise, tmp_path_factory):
    made = dataset.Dataset(spark, str(tmp_path_factory.mktemp("data") / "out"), folder, CONFIG, listed, noise)
    made.build()
    return made


def samples(folder, k):
    with wave.open(f"{folder}/s{k}.wav") as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32768


def test_pairs_are_those_of_loops(spark, folder, noise, built):
    split = {(r["source_idx"], r["local_idx"]): r for r in built.read("split").collect()}
    assert len(split) == sum((200 + 40 * k - 64) // 16 + 1 for k in range(6)) and {r["split"] for r in split.values()} == {"train", "validate", "discard"}
    ids = sorted(split)
    assert [split[i]["global_idx"] for i in ids] == list(range(len(ids)))
    x = {i: samples(folder, i[0])[16 * i[1] : 16 * i[1] + 64] for i in ids}
    train = np.concatenate([x[i] for i in ids if split[i]["split"] == "train"])
    mean, std = train.mean(), train.std()
    clip = np.array(noise.first()["samples"])
    params = augment.degradation_params(spark.createDataFrame([(split[i]["global_idx"], k) for i in ids for k in (0, 1)], "global_idx long, degradation_idx int"), 7, "global_idx", "degradation_idx")
    from wavespan.functions import rng

    drawn = {(r["global_idx"], r["degradation_idx"]): r.asDict() for r in params.withColumn("pick", rng.key(7, F.col("global_idx"), F.col("degradation_idx"), "start")).collect()}
    n = 0
    for r in built.read("pairs").collect():
        i = (r["source_idx"], r["local_idx"])
        assert split[i]["split"] == r["split"] != "discard" and split[i]["global_idx"] == r["global_idx"]
        assert np.allclose(r["z_clean"][0], (x[i] - mean) / (std + 1e-6))
        p = drawn[r["global_idx"], r["degradation_idx"]]
        assert np.allclose(r["z_cond"][0], (augment.degrade(x[i], p, clip, p["pick"], float(RATE))[-1] - mean) / (std + 1e-6))
        n += 1
    assert n == 2 * sum(r["split"] != "discard" for r in split.values())
    assert {r["rule"]: r["bad"] for r in built.read("audit").collect()} == dict.fromkeys(["incomplete", "unexpected", "missing", "not_finite", "wrong_split", "unequal_lengths", "files", "not_covered_or_unknown", "train_and_validate", "train_and_discard", "validate_and_discard", "views_apart", "in_two_splits", "train_near_validate", "without_split"], 0)


def test_views_of_a_recording_are_validated_together(built):
    v = built.read("split").groupBy("group_idx", "start_sample").agg(F.collect_set(F.col("split") == "validate").alias("v"), F.count(F.lit(1)).alias("n"))
    assert v.where("n > 1").count() > 5 and v.where(F.size("v") > 1).count() == 0


def test_metadata(built):
    row = built.read("metadata").first()
    n = built.read("windows").count()
    assert row["split_audit"]["total"] == n == sum(row["split_audit"][c] for c in ("train", "validate", "discard"))
    assert [(r["dataset"], r["n_sources"]) for r in row["datasets"]] == [("set0", 2), ("set1", 2), ("set2", 2)] and len(row["latents"]) == 1
    assert json.loads(row["config"])["segment"] == 64 and set(row["tables"]) == set(dataset.STAGES[:5]) and "every 16 samples" in row["methods"]


@pytest.mark.parametrize("stage", dataset.STAGES[:-1])
def test_a_build_that_ends_early_goes_on(spark, folder, listed, noise, built, tmp_path, monkeypatch, stage):
    """A stage that is killed leaves part of its output and no marker; what was complete is not made again."""
    import shutil

    path = f"{tmp_path}/out"
    shutil.copytree(built.path, path)
    behind = dataset.STAGES[dataset.STAGES.index(stage) :]
    for s in behind[1:]:
        shutil.rmtree(f"{path}/{s}")
    os.remove(f"{path}/{stage}/_SUCCESS")
    for f in glob.glob(f"{path}/{stage}/**/*.parquet", recursive=True)[1:]:
        os.remove(f)
    calls = []
    for s in dataset.STAGES:
        monkeypatch.setattr(dataset.Dataset, s, lambda self, s=s, f=getattr(dataset.Dataset, s): calls.append(s) or f(self))
    made = dataset.Dataset(spark, path, folder, CONFIG, listed, noise)
    with pytest.raises(ValueError, match="not complete"):
        made.read(stage)
    last = stage if stage in ("statistics", "pairs") else behind[min(1, len(behind) - 1)]
    got = made.build(last)
    assert calls == list(behind[: behind.index(last) + 1])
    if last not in ("files", "metadata", "audit"):
        assert got.exceptAll(built.read(last)).count() == got.count() - built.read(last).count() == 0


def test_another_configuration_is_refused(spark, folder, listed, noise, built):
    from dataclasses import replace

    with pytest.raises(ValueError, match="another configuration"):
        dataset.Dataset(spark, built.path, folder, replace(CONFIG, seed=8), listed, noise).build()
    for bad in ({"scope": "none"}, {"hop": 0}, {"encoder": "nothing"}, {"output": "x"}):
        with pytest.raises(ValueError):
            dataset.Dataset(spark, built.path, folder, replace(CONFIG, **bad), listed, noise)


def test_files_that_are_missing_extra_or_cut(spark, folder, listed, noise, built, tmp_path):
    import shutil

    path = f"{tmp_path}/out"
    shutil.copytree(built.path, path)
    parts = sorted(glob.glob(f"{path}/pairs/split=*/*.parquet"))
    whole = sorted(parts, key=os.path.getsize)
    os.remove(whole[-1])
    shutil.copy(whole[0], f"{path}/pairs/split=train/part-extra.parquet")
    if len(whole) > 2:
        with open(whole[1], "r+b") as f:
            f.seek(10)
            f.write(b"x")
    made = dataset.Dataset(spark, path, folder, CONFIG, listed, noise)
    found = {r["file"].split("/")[-1]: r["fault"] for r in made.file_faults().collect()}
    want = {os.path.basename(whole[-1]): "missing", "part-extra.parquet": "unexpected"} | ({os.path.basename(whole[1]): "changed"} if len(whole) > 2 else {})
    assert found == want


def test_faults_of_manifest_and_recordings_stop_the_build(spark, folder, listed, noise, tmp_path):
    from dataclasses import replace

    for k, (rows, config) in enumerate([(listed.where("output_file <> ' s3.wav'"), CONFIG), (listed.unionAll(listed.limit(1)), CONFIG), (listed, replace(CONFIG, rate=44100)), (listed, replace(CONFIG, segment=300))]):
        with pytest.raises(ValueError, match="faults of"):
            dataset.Dataset(spark, f"{tmp_path}/{k}", folder, config, rows, noise).build("inventory")


def test_waveforms_without_manifest(spark, folder, noise, tmp_path):
    from dataclasses import replace

    made = dataset.Dataset(spark, f"{tmp_path}/w", folder, replace(CONFIG, grouped=False, output="waveforms"), None, noise)
    assert made.build().where("bad > 0").count() == 0
    r = made.read("pairs").first()
    assert len(r["clean"]) == len(r["x"]) == 64 and np.allclose(r["clean"], samples(folder, r["source_idx"])[16 * r["local_idx"] : 16 * r["local_idx"] + 64])
    with pytest.raises(ValueError):
        dataset.Dataset(spark, f"{tmp_path}/v", folder, CONFIG, None, noise)


def test_all_variants_of_a_window_have_one_length(spark):
    """An encoder whose frames depend on the samples: the shortest of a window's arrays cuts all of them."""
    r = np.random.default_rng(4)
    clean = spark.createDataFrame([(k, r.normal(size=40).tolist()) for k in range(20)], "k long, x array<double>")
    variants = spark.createDataFrame([(k, d, r.normal(size=40).tolist()) for k in range(20) for d in range(3)], "k long, degradation_idx int, x array<double>")
    encode = lambda x: np.stack([x, -x])[:, : 30 + int(abs(x[0]) * 1000) % 10]
    own = {(row["k"], -1): row["x"] for row in clean.collect()} | {(row["k"], row["degradation_idx"]): row["x"] for row in variants.collect()}
    rows = dataset.encode_pairs(clean, variants, encode, [0.5, 0.0], [2.0, 1.0], "k").collect()
    assert len(rows) == 60
    for row in rows:
        n = min(encode(np.array(own[row["k"], d])).shape[1] for d in (-1, 0, 1, 2))
        for z, d in ((row["z_clean"], -1), (row["z_cond"], row["degradation_idx"])):
            assert np.allclose(z, (encode(np.array(own[row["k"], d]))[:, :n] - [[0.5], [0.0]]) / [[2.0 + 1e-6], [1.0 + 1e-6]])


def test_encoders_are_checked():
    for e in dataset.ENCODERS.values():
        e.check(64)
    x = np.random.default_rng(0).normal(size=50)
    assert np.allclose(dataset.round_trip("cosines")(x), x) and np.allclose(dataset.round_trip("samples")(x), x)
    wrong = [
        dataset.Encoder("a", 2, 1, lambda x: x[None, :]), dataset.Encoder("b", 1, 4, lambda x: x[None, :]), dataset.Encoder("c", 1, 1, lambda x: x),
        dataset.Encoder("d", 1, 1, lambda x: x[None, :], lambda z, n: z), dataset.Encoder("e", 1, 1, lambda x: x[None, :], rate=16000),
    ]
    for e in wrong:
        with pytest.raises(ValueError):
            e.check(64, 44100)
    for name in ("spectrum", lambda x: x):
        with pytest.raises(ValueError):
            dataset.round_trip(name)
