"""Registered queries of sources and sinks: what the tables give is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import arrays
from ..operators import chunks, split
from ..sources import audio, wav
from . import dataset
from .queries import all_split, digest_pieces, digest_sql, query

PCM = "greatest(-1.0, least(1.0, v)) * 32767"


def _folder(spark, d, tag, least=0):
    """A folder with a WAV file for each signal of a length."""
    path = fx.scratch(spark, tag)
    wav.write(fx.pieces(spark, d, 100.0).where(F.col("n") >= least).withColumn("name", F.format_string("sig_%d.wav", F.col("user_id"))), "name", path).count()
    return path


@query("scan_audio_inventory", "SELECT dataset AS song, count(*) AS n_lines, count(DISTINCT doc_id // 3 % 4) AS n_files, sum(strlen(output_file) + 1)::BIGINT AS bytes FROM rec GROUP BY dataset")
def scan_audio_inventory(spark, d):
    """A folder for each dataset, with files of names; a large dataset is four files, from several tasks."""
    path = fx.scratch(spark, "inventory")
    rows = fx.recordings(spark, d).select("output_file", "dataset", F.pmod(F.floor(F.col("doc_id") / 3), F.lit(4)).alias("part"))
    rows.repartition("dataset", "part").write.partitionBy("dataset", "part").text(path)
    found = audio.inventory(spark, path, ("txt",), recursive=True).withColumn("song", F.regexp_extract("path", "dataset=([^/]*)/", 1))
    found = found.groupBy("song").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
    return found.join(rows.groupBy(F.col("dataset").alias("song")).agg(F.count(F.lit(1)).alias("n_lines")), "song").select("song", "n_lines", "n_files", "bytes")


@query("probe_audio_header", "SELECT 'sig_' || user_id || '.wav' AS name, 44100 AS rate, len(x) AS frames, 1 AS channels, 16 AS bits FROM hot")
def probe_audio_header(spark, d):
    return audio.probe(spark, _folder(spark, d, "probed"))


@query("read_windows", f"SELECT 'sig_' || user_id || '.wav' AS name, k AS local_idx, k * 8 AS start_sample, round(list_sum(list_transform(x[(k * 8 + 1):(k * 8 + 32)], lambda v: round_even({PCM}, 0) / 32768)), 6) + 0.0 AS total FROM (SELECT user_id, x, unnest(range(0, (len(x) - 32) // 8 + 1)) AS k FROM hot WHERE len(x) >= 32)")
def read_windows(spark, d):
    w = audio.read_windows(spark, _folder(spark, d, "windows"), 32, 8)
    return w.select("name", "local_idx", "start_sample", F.round(arrays.total(F.col("x")), 6).alias("total"))


@query("scan_manifest", "SELECT recording_id, kind, dataset, song, family, output_file, doc_id::VARCHAR AS note FROM rec")
def scan_manifest(spark, d):
    """With a column more than a manifest needs."""
    path = fx.scratch(spark, "manifest")
    rows = fx.recordings(spark, d).select("recording_id", "kind", "dataset", "song", "family", "output_file", F.col("doc_id").cast("string").alias("note"))
    rows.write.csv(path, sep="\t", header=True)
    return audio.scan_manifest(spark, path)


@query("scan_checksums", "SELECT 'doc ' || doc_id || '.wav' AS name, listed_sha256 AS listed FROM assets")
def scan_checksums(spark, d):
    path = fx.scratch(spark, "checksums")
    fx.assets(spark, d).select(F.concat("listed_sha256", F.lit("  doc "), F.col("doc_id").cast("string"), F.lit(".wav")).alias("value")).write.text(path)
    return audio.scan_checksums(spark, path)


@query("scan_selection_json", "SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS pos, s_suppkey * 11 AS global_idx FROM supplier")
def scan_selection_json(spark, d):
    """A selection file lists the windows that a person has chosen: one for each supplier here. A file goes before the default."""
    path = fx.scratch(spark, "selection")
    ids = fx.table(spark, d, "supplier").agg(F.array_sort(F.collect_list(F.col("s_suppkey").cast("long") * 11)).alias("global_window_indices"))
    ids.write.json(path)
    return audio.selected_windows(spark, None, path, (1, 2)).select("pos", "global_idx")


def _pairs(spark, d):
    clean = F.array((F.col("sse") - 0.1) * 100, F.col("n") / 10)
    return fx.pairs(spark, d).withColumn("split", F.when(F.col("window_idx") % 10 == 0, "validate").otherwise("train")).withColumn("clean", clean)


@query("write_pairs", "SELECT CASE WHEN window_idx % 10 = 0 THEN 'validate' ELSE 'train' END AS split, window_idx, degradation_idx, round(sse, 6) AS sse FROM pairs")
def write_pairs(spark, d):
    path = fx.scratch(spark, "pairs")
    audio.write_pairs(_pairs(spark, d).drop("clean"), path)
    return spark.read.parquet(path).select("split", "window_idx", "degradation_idx", F.round("sse", 6).alias("sse"))


@query("write_clean_targets", "SELECT window_idx, round(greatest(-1.0, least(1.0, (sse - 0.1) * 100)), 6) + 0.0 AS a, round(greatest(-1.0, least(1.0, n / 10)), 6) + 0.0 AS b FROM pairs WHERE degradation_idx = 0")
def write_clean_targets(spark, d):
    """The target of a window is that of its first degradation; all its degradations share it."""
    path = fx.scratch(spark, "clean")
    p = _pairs(spark, d)
    first = p.where("degradation_idx = 0").select("window_idx", "clean")
    audio.write_clean_targets(p.select("window_idx", "degradation_idx").join(first, "window_idx"), path)
    return spark.read.parquet(path).select("window_idx", F.round(F.get("clean", F.lit(0)), 6).alias("a"), F.round(F.get("clean", F.lit(1)), 6).alias("b"))


@query("success_marker", "SELECT split, count(*) AS n, true AS complete FROM (SELECT CASE WHEN window_idx % 10 = 0 THEN 'validate' ELSE 'train' END AS split FROM pairs) GROUP BY split")
def success_marker(spark, d):
    """Consumers wait for the marker of an output, which is written last."""
    path = fx.scratch(spark, "marked")
    if audio.is_complete(spark, path):
        raise ValueError("an output that isn't there is not complete")
    audio.write_pairs(_pairs(spark, d).select("split", "window_idx"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("complete", F.lit(audio.is_complete(spark, path)))


@query("write_dataset_metadata", "SELECT count(*) AS total, count_if(split = 'train')::BIGINT AS train, count_if(split = 'validate')::BIGINT AS validate, 400::BIGINT AS segment, (SELECT list(DISTINCT dataset ORDER BY dataset) FROM rec)::VARCHAR AS datasets FROM split")
def write_dataset_metadata(spark, d):
    path = fx.scratch(spark, "metadata")
    counts = split.audit(all_split(spark, d)).select("total", "train", "validate", F.lit(fx.SEGMENT).cast("long").alias("segment"))
    names = fx.recordings(spark, d).agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
    text = audio.write_metadata(counts.crossJoin(F.broadcast(names)), path)
    if "segment: 400" not in text:
        raise ValueError("the methods text lacks a parameter")
    found = spark.read.schema("total long, train long, validate long, segment long, datasets array<string>").json(path)
    return found.withColumn("datasets", F.concat(F.lit("["), F.array_join("datasets", ", "), F.lit("]")))


@query("write_manifest", "SELECT doc_id, found_sha256, duration FROM assets")
def write_manifest(spark, d):
    """Rows that CSV and JSON agree on."""
    path = fx.scratch(spark, "assets")
    audio.write_manifest(fx.assets(spark, d).select("doc_id", "found_sha256", "duration"), path)
    kind = "doc_id long, found_sha256 string, duration double"
    return spark.read.csv(f"{path}/csv", header=True, schema=kind).intersectAll(spark.read.schema("doc_id long, duration double, found_sha256 string").json(f"{path}/json").select("doc_id", "found_sha256", "duration"))


@query("append_metrics", "SELECT tag, count(*) AS n, max(step) AS last_step FROM (SELECT tag, step FROM loss UNION ALL SELECT tag, step + 1000000 FROM loss) GROUP BY tag")
def append_metrics(spark, d):
    """Two runs of writing to one log."""
    path = fx.scratch(spark, "metrics")
    rows = fx.losses(spark, d).select("tag", F.col("loss").alias("value"), "step")
    audio.append_metrics(rows, path)
    audio.append_metrics(rows.withColumn("step", F.col("step") + 1000000), path)
    return spark.read.parquet(path).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))


@query("restore_folder", f"SELECT 'sig_' || user_id || '_restored.wav' AS file, len(x) AS frames, round(list_sum(list_transform(x, lambda v: round_even(round_even({PCM}, 0) / 32768 * 0.5 * 32767, 0) / 32768)), 6) + 0.0 AS total FROM hot")
def restore_folder(spark, d):
    """A folder of recordings through a restorer, in overlapping chunks, to another folder."""
    source, path = _folder(spark, d, "recordings"), fx.scratch(spark, "restored")
    chunks.restore_folder(spark, source, path, lambda x: x * 0.5, 16, 8)
    found = wav.pieces(spark, path).groupBy(F.col("name").alias("file")).agg(F.max("n").alias("frames"), F.sum(arrays.total(F.col("x"))).alias("total"))
    return found.withColumn("total", F.round("total", 6))


@query("restore_fn", digest_sql("user_id", "list_transform(x, lambda v: greatest(-1.0, least(1.0, v)))", "hot"))
def restore_fn(spark, d):
    """A restorer chosen by name."""
    return digest_pieces(chunks.restore_pieces(fx.pieces(spark, d, 100.0, halo=16), "clamp", 16, 8, "user_id").withColumnRenamed("start", "begin"), "user_id")


def _listed(spark, d):
    """A manifest of the folder: two users are views of one recording."""
    i = F.col("user_id")
    users = fx.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 32")
    kind = F.when(i % 2 == 0, "full_mix").otherwise("section_mix")
    return users.select(F.concat(F.lit("rec_"), F.floor(i / 2)).alias("recording_id"), kind.alias("kind"), F.lit("users").alias("dataset"), F.lit("song").alias("song"), F.when(i % 2 == 0, "full_mix").otherwise("strings").alias("family"), F.format_string("sig_%d.wav", i).alias("output_file"))


def _dataset(spark, d):
    config = dataset.Config(segment=32, hop=8, variants=2, seed=fx.SEED, target=fx.TARGET, encoder="samples")
    return dataset.Dataset(spark, fx.scratch(spark, "dataset"), _folder(spark, d, "sources", 32), config, _listed(spark, d), fx.noise(spark, d))


@query(
    "precompute_dataset",
    "SELECT split, global_idx, source_idx, local_idx, k::INTEGER AS degradation_idx, 32::BIGINT AS n, round(list_sum(list_transform(y, lambda v: (v - mean) / (std + 1e-6))), 6) + 0.0 AS clean_total FROM split2, range(0, 2) t(k), (SELECT avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)) AS std FROM (SELECT unnest(y) AS v FROM split2 WHERE split = 'train')) WHERE split <> 'discard'",
)
def precompute_dataset(spark, d):
    """From a folder of recordings and a manifest to audited pairs."""
    made = _dataset(spark, d)
    if made.build().where("bad > 0").count():
        raise ValueError("the audit has faults")
    z, c = F.get("z_clean", F.lit(0)), F.get("z_cond", F.lit(0))
    return made.read("pairs").select("split", "global_idx", "source_idx", "local_idx", "degradation_idx", F.size(c).cast("long").alias("n"), F.round(arrays.total(z), 6).alias("clean_total"))


@query("split_of_folder", "SELECT split, global_idx, source_idx, group_idx, local_idx FROM split2")
def split_of_folder(spark, d):
    """The plan up to its split: no sample is read."""
    return _dataset(spark, d).build("split").select("split", "global_idx", "source_idx", "group_idx", "local_idx")
