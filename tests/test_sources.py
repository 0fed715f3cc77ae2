import hashlib
import json
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from wavespan.sources import audio


def write_wav(path, x, rate=44100, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(x, "<i2").tobytes())


@pytest.fixture()
def folder(tmp_path):
    write_wav(tmp_path / "b.wav", range(100))
    write_wav(tmp_path / "a.WAV", np.arange(60).repeat(2), 22050, 2)
    (tmp_path / "c.txt").write_text("no")
    return tmp_path


def test_inventory_and_headers(spark, folder):
    assert sorted(r["name"] for r in audio.inventory(spark, str(folder)).collect()) == ["a.WAV", "b.wav"]
    rows = {r["name"]: (r["rate"], r["frames"], r["channels"], r["bits"]) for r in audio.probe(spark, str(folder)).collect()}
    assert rows == {"a.WAV": (22050, 60, 2, 16), "b.wav": (44100, 100, 1, 16)}


def test_windows_of_files(spark, folder):
    rows = audio.read_windows(spark, str(folder), 40, 20).orderBy("name", "local_idx").collect()
    assert [(r["name"], r["start_sample"]) for r in rows] == [("a.WAV", 0), ("a.WAV", 20), ("b.wav", 0), ("b.wav", 20), ("b.wav", 40), ("b.wav", 60)]
    assert np.allclose(rows[-1]["x"], np.arange(60, 100) / 32768)


def test_stems(spark, tmp_path):
    for song, name in (("s1", "x.wav"), ("s1", "w.wav"), ("s2", "y.wav")):
        (tmp_path / song).mkdir(exist_ok=True)
        write_wav(tmp_path / song / name, [0, 1])
    assert {r["song"]: r["stems"] for r in audio.stem_folders(spark, str(tmp_path)).collect()} == {"s1": ["w.wav", "x.wav"], "s2": ["y.wav"]}


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("recording_id\tkind\tdataset\tsong\tfamily\toutput_file\n007\tfull_mix\td\ts\tfull_mix\tx.wav\n")
    assert audio.scan_manifest(spark, str(p)).first()["recording_id"] == "007"
    p.write_text("recording_id\tkind\n1\tfull_mix\n")
    with pytest.raises(ValueError):
        audio.scan_manifest(spark, str(p))


def test_checksums_and_names(spark, tmp_path):
    h = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "sums").write_text(f"{h}  x.wav\n# note\n{h.upper()} *y.wav\n")
    assert {r["name"]: r["listed"] for r in audio.scan_checksums(spark, str(tmp_path / "sums")).collect()} == {"x.wav": h, "y.wav": h}
    names = spark.createDataFrame([("window_1234567_degradation_03.pt",), ("dataset_metadata.pt",), ("other.pt",)], "name string")
    rows = {r["name"]: (r["window_idx"], r["degradation_idx"]) for r in audio.parse_pair_names(names).collect()}
    assert rows == {"window_1234567_degradation_03.pt": (1234567, 3), "other.pt": (None, None)}


def test_selection(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"global_window_indices": [5, 2, 9]}))
    assert [tuple(r) for r in audio.scan_selection(spark, str(p)).orderBy("pos").collect()] == [(0, 5), (1, 2), (2, 9)]
    for bad in ([], [1, 1]):
        p.write_text(json.dumps({"global_window_indices": bad}))
        with pytest.raises(PySparkException):
            audio.scan_selection(spark, str(p)).collect()


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0, "train", [2.0, 0.5]), (1, 1, "train", [2.0, 0.5]), (2, 0, "validate", [-3.0])], "window_idx long, degradation_idx int, split string, clean array<double>")
    audio.write_pairs(pairs, f"{tmp_path}/pairs")
    assert (tmp_path / "pairs/_SUCCESS").exists() and (tmp_path / "pairs/split=train").is_dir()
    with pytest.raises(PySparkException):
        audio.write_pairs(pairs, f"{tmp_path}/pairs")
    audio.write_clean_targets(pairs, f"{tmp_path}/clean")
    assert {r["window_idx"]: r["clean"] for r in spark.read.parquet(f"{tmp_path}/clean").collect()} == {1: [1.0, 0.5], 2: [-1.0]}
    text = audio.write_metadata(pairs.selectExpr("count(*) AS n", "named_struct('a', max(window_idx)) AS nested"), f"{tmp_path}/meta")
    assert text.splitlines()[0] == "n: 3" and spark.read.json(f"{tmp_path}/meta").first()["n"] == 3
    audio.write_manifest(pairs.select("window_idx", "split"), f"{tmp_path}/man")
    assert spark.read.csv(f"{tmp_path}/man/csv", header=True).count() == 3
    m = spark.createDataFrame([("loss", 0.5, 1)], "tag string, value double, step long")
    audio.append_metrics(m, f"{tmp_path}/metrics")
    audio.append_metrics(m, f"{tmp_path}/metrics")
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 2
