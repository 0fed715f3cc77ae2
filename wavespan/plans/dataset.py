"""From a folder of recordings to an audited dataset of clean and degraded pairs, stage by stage."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.batches import few
from ..operators import augment, evaluate, loudness, manifest, pieces, split, windows
from ..sources import audio, wav


@dataclass(frozen=True)
class Encoder:
    """A codec: arrays of samples to channels x frames, and back.

    rate: samples a second it takes (none: any); hop: samples of a frame. decode gets latents and the number of samples.
    """

    name: str
    channels: int
    hop: int
    encode: Callable[[np.ndarray], np.ndarray]
    decode: Callable[[np.ndarray, int], np.ndarray] | None = None
    rate: float | None = None

    def check(self, samples: int, rate: float | None = None) -> Encoder:
        """Refuse, before a job runs, an encoder whose arrays are not what it promises for windows of so many samples."""
        if self.rate is not None and rate is not None and self.rate != rate:
            raise ValueError(f"encoder {self.name} takes {self.rate} samples a second, not {rate}")
        x = np.sin(np.arange(samples) / 3)
        z = np.asarray(self.encode(x))
        if z.ndim != 2 or z.shape[0] != self.channels:
            raise ValueError(f"encoder {self.name} promises {self.channels} channels x frames and gives {z.shape}")
        if abs(z.shape[1] - samples / self.hop) > 2:
            raise ValueError(f"encoder {self.name} promises a frame for {self.hop} samples and gives {z.shape[1]} for {samples}")
        if self.decode is not None and np.shape(self.decode(z, samples)) != (samples,):
            raise ValueError(f"encoder {self.name} does not decode to the samples that it was given")
        return self


def _cosines(n: int) -> np.ndarray:
    """Orthonormal cosine transform of n samples."""
    k = np.arange(n)
    m = np.cos(np.pi * (k[None] + 0.5) * k[:, None] / n) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def _block_encode(x: np.ndarray, n: int = 16) -> np.ndarray:
    return _cosines(n) @ np.pad(x, (0, -len(x) % n)).reshape(-1, n).T


def _block_decode(z: np.ndarray, samples: int) -> np.ndarray:
    return (_cosines(len(z)).T @ z).T.ravel()[:samples]


#: Encoders by name. A user's own Encoder can be given instead, or a plain function from samples to channels x frames.
ENCODERS = {
    e.name: e
    for e in (
        Encoder("spectrum", 17, 8, lambda x: np.abs(augment.stft(x, 32, 8, 32))),
        Encoder("samples", 1, 1, lambda x: x[None, :], lambda z, n: z[0, :n]),
        Encoder("cosines", 16, 16, _block_encode, _block_decode),
    )
}


def codec(given) -> Encoder | None:
    """The Encoder of that name, or the one that is given; none for a plain function."""
    if isinstance(given, Encoder):
        return given
    if callable(given):
        return None
    if given not in ENCODERS:
        raise ValueError(f"unknown encoder {given}; there are {sorted(ENCODERS)}")
    return ENCODERS[given]


def encoder(given) -> Callable[[np.ndarray], np.ndarray]:
    found = codec(given)
    return given if found is None else found.encode


def round_trip(given) -> Callable[[np.ndarray], np.ndarray]:
    """Samples through a codec and back, as a restorer of chunks."""
    found = codec(given)
    if found is None or found.decode is None:
        raise ValueError("a codec without decode can't give samples back")
    return lambda x: found.decode(found.encode(x), len(x))


LATENT = pa.list_(pa.list_(pa.float64()))


def encoded(rows: DataFrame, encode_fn, *ids: str) -> DataFrame:
    """ids, z (channels x frames) of rows with samples x, an Arrow batch at a time."""
    made, kinds = encoder(encode_fn), dict(rows.dtypes)

    def run(batches):
        for b in few(batches):
            z = [np.asarray(made(np.array(v)), float).tolist() for v in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ids], pa.array(z, LATENT)], [*ids, "z"])

    return rows.select(*ids, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", z array<array<double>>")


def encode_pairs(clean: DataFrame, variants: DataFrame, encode_fn, mean: list[float], std: list[float], *keys: str) -> DataFrame:
    """keys, degradation_idx, z_clean, z_cond of clean windows (keys, x) and variants (keys, degradation_idx, x), as encode_together."""
    rows = clean.select(*keys, F.lit(-1).alias("degradation_idx"), "x").unionByName(variants.select(*keys, "degradation_idx", "x"))
    return encode_together(rows, encode_fn, mean, std, *keys)


def encode_together(rows: DataFrame, encode_fn, mean: list[float], std: list[float], *keys: str) -> DataFrame:
    """keys, degradation_idx, z_clean, z_cond: latents of a window and all its variants, cropped to one length and normalised.

    rows: keys, degradation_idx (-1: the clean window), x. Every array is encoded once, wherever it is; then the latents of a
    window meet, the clean one and its few variants. Frames that any of them lacks are cut off all of them.
    """
    met = encoded(rows, encode_fn, *keys, "degradation_idx").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("degradation_idx", "z"))).alias("all"))
    shortest = F.array_min(F.transform("all", lambda r: F.size(F.get(r["z"], F.lit(0)))))
    means, stds = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    normal = lambda z: F.transform(z, lambda row, c: F.transform(F.slice(row, 1, F.col("_n")), lambda v: (v - F.get(means, c)) / (F.get(stds, c) + arrays.EPSILON)))
    first = F.get("all", F.lit(0))
    rows = met.withColumn("_n", shortest).where(first["degradation_idx"] == -1)
    rows = rows.select(*keys, "_n", normal(first["z"]).alias("z_clean"), F.explode(F.filter("all", lambda r: r["degradation_idx"] >= 0)).alias("_v"))
    return rows.select(*keys, F.col("_v.degradation_idx").alias("degradation_idx"), "z_clean", normal(F.col("_v.z")).alias("z_cond"))


def latent_stats(clean: DataFrame, encode_fn) -> DataFrame:
    """channel, mean, std of the latents of all rows, from sums that each task adds up first."""
    made = encoder(encode_fn)

    def run(batches):
        total = None
        for b in few(batches):
            for v in b.column("x").to_pylist():
                z = made(np.array(v))
                now = np.stack([z.sum(1), (z * z).sum(1), np.full(len(z), z.shape[1], float)])
                total = now if total is None else total + now
        if total is not None:
            yield pa.record_batch({"channel": pa.array(range(total.shape[1]), pa.int32()), "s": pa.array(total[0]), "q": pa.array(total[1]), "n": pa.array(total[2])})

    g = clean.select("x").mapInArrow(run, "channel int, s double, q double, n double").groupBy("channel").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    return g.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))


@dataclass(frozen=True)
class Config:
    """What makes a dataset: a folder that was begun with other values is not continued."""

    segment: int
    hop: int
    variants: int
    seed: int
    target: float
    rate: int = 44100
    encoder: str = "spectrum"
    scope: str = "train"
    grouped: bool = True
    output: str = "latents"
    loudness: float | None = None
    model: augment.Degradation = field(default=augment.MODEL)

    def checked(self) -> Config:
        if self.scope not in ("train", "all"):
            raise ValueError("scope is train or all")
        if self.output not in ("latents", "waveforms"):
            raise ValueError("output is latents or waveforms")
        if not 0 < self.hop <= self.segment:
            raise ValueError("the hop must be over 0 and at most a segment")
        found = codec(self.encoder)
        if found is not None:
            found.check(self.segment, self.rate)
        return self


STAGES = ("inventory", "windows", "split", "statistics", "pairs", "files", "metadata", "audit")


class Dataset:
    """A dataset in a folder, made in stages. Each stage is a table of the folder with a marker that is written last.

    build() goes on behind the last stage that has its marker; what a stage without one has left is written anew. Samples are
    read twice (for statistics and pairs), from recordings, and move once, by piece of a recording; the rest is ids.
    """

    def __init__(self, spark: SparkSession, path: str, source: str, config: Config, listed: DataFrame | None = None, noise: DataFrame | None = None):
        self.spark, self.path, self.source, self.config = spark, path.rstrip("/"), source, config.checked()
        self.listed, self.noise = listed, noise
        if config.grouped and listed is None:
            raise ValueError("views can only be grouped with a manifest")

    def at(self, stage: str) -> str:
        return f"{self.path}/{stage}"

    def is_done(self, stage: str) -> bool:
        return audio.is_complete(self.spark, self.at(stage))

    def read(self, stage: str) -> DataFrame:
        if not self.is_done(stage):
            raise ValueError(f"stage {stage} is not complete")
        return self.spark.read.parquet(self.at(stage))

    def _same_config(self) -> None:
        text = json.dumps(asdict(self.config) | {"source": self.source}, sort_keys=True)
        if self.is_done("config"):
            found = self.spark.read.text(self.at("config")).first()["value"]
            if found != text:
                raise ValueError("the folder was begun with another configuration")
            return
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(self.at("config"))

    def build(self, last: str = STAGES[-1]) -> DataFrame:
        """All stages up to the last one that is asked for; returns its table."""
        self._same_config()
        for stage in STAGES[: STAGES.index(last) + 1]:
            if not self.is_done(stage):
                out = getattr(self, stage)()
                by = ["split"] if stage in ("split", "pairs") else []
                out.write.mode("overwrite").partitionBy(*by).parquet(self.at(stage))
        return self.read(last)

    # Stages

    def inventory(self) -> DataFrame:
        """source_idx, group_idx, name, num_frames and what the manifest says of each recording; faults stop the build."""
        found = audio.probe(self.spark, self.source)
        names = found.select("name")
        if self.listed is None:
            rows = windows.dense_index(names, "name", "source_idx").withColumns({"recording_id": F.col("name"), "group_idx": F.col("source_idx"), "kind": F.lit("full_mix"), "family": F.lit("full_mix"), "dataset": F.lit("unmanifested"), "song": F.regexp_replace("name", r"\.[^.]*$", "")})
        else:
            listed = manifest.normalize(self.listed)
            problems = manifest.violations(listed).select(F.concat_ws(": ", "output_file", "rule").alias("fault")).unionAll(manifest.reconcile(listed, names).select(F.concat_ws(": ", "name", "state").alias("fault")))
            _none(problems.unionAll(manifest.duplicates(listed, "output_file").select(F.concat(F.col("output_file"), F.lit(": twice")).alias("fault"))), "the manifest")
            rows = manifest.enrich(windows.dense_index(names, "name", "source_idx"), windows.dense_index(listed, "recording_id", "group_idx"))
        about = rows.join(found.select("name", "rate", F.col("frames").alias("num_frames")), "name")
        faults = about.where((F.col("rate") != self.config.rate) | (F.col("num_frames") < self.config.segment))
        _none(faults.select(F.concat("name", F.lit(": rate or length")).alias("fault")), "the recordings")
        group = F.col("group_idx") if self.config.grouped else F.col("source_idx")
        return about.withColumn("group_idx", group)

    def windows(self) -> DataFrame:
        """source_idx, group_idx, local_idx, start_sample, global_idx: ids alone."""
        ids = windows.global_index(self.read("inventory").select("source_idx", "group_idx", "num_frames"), self.config.segment, self.config.hop)
        return ids.select("source_idx", "group_idx", "local_idx", "start_sample", "global_idx")

    def split(self) -> DataFrame:
        c = self.config
        rows = split.ranked(self.read("windows"), c.seed, "source_idx", "local_idx")
        return split.split_windows(rows, "group_idx", windows.overlap_radius(c.segment, c.hop), c.target).drop("h")

    def _samples(self, ids: DataFrame) -> DataFrame:
        """Columns of ids (source_idx, start_sample, ...) with x. A piece of a recording meets the ids of the windows that begin in it."""
        size = max(pieces.SIZE, self.config.segment)
        names = self.read("inventory").select("name", "source_idx")
        keep = [c for c in ids.columns if c != "source_idx"]
        wanted = ids.join(names, "source_idx").withColumn("piece", F.floor(F.col("start_sample") / size)).groupBy("name", "source_idx", "piece").agg(F.collect_list(F.struct(*keep)).alias("w"))
        met = wav.pieces(self.spark, self.source, size, self.config.segment).join(wanted, ["name", "piece"])
        rows = met.select("source_idx", "begin", "x", F.explode("w").alias("w")).select("source_idx", "w.*", "begin", "x")
        out = rows.select(*ids.columns, F.slice("x", (F.col("start_sample") - F.col("begin") + 1).cast("int"), self.config.segment).alias("x"))
        # Windows are brought to the target loudness one by one, as they are read.
        return out if self.config.loudness is None else loudness.normalize_windows(out, self.config.rate, self.config.loudness, *ids.columns)

    def statistics(self) -> DataFrame:
        """channel, mean, std of the latents of the training windows, or of all."""
        rows = self.read("split")
        return latent_stats(self._samples(rows.where("split = 'train'") if self.config.scope == "train" else rows), self.config.encoder)

    def pairs(self) -> DataFrame:
        """split, global_idx, source_idx, local_idx, degradation_idx, z_clean, z_cond of the windows that are kept."""
        c, ids = self.config, ["global_idx", "source_idx", "local_idx", "split"]
        clean = self._samples(self.read("split").where("split <> 'discard'")).select(*ids, "x")
        made = augment.augment(clean, self.noise, c.variants, c.seed, float(c.rate), "global_idx", keep=tuple(ids[1:]), model=c.model, with_clean=True).drop("stage")
        if c.output == "waveforms":
            met = made.groupBy(*ids).agg(F.collect_list(F.struct("degradation_idx", "x")).alias("all"))
            first = F.get(F.filter("all", lambda r: r["degradation_idx"] < 0), F.lit(0))["x"]
            return met.select(*ids, first.alias("clean"), F.explode(F.filter("all", lambda r: r["degradation_idx"] >= 0)).alias("v")).select(*ids, "clean", "v.*")
        stats = self.read("statistics").orderBy("channel").collect()
        return encode_together(made, c.encoder, [r["mean"] for r in stats], [r["std"] for r in stats], *ids)

    def _parts(self) -> DataFrame:
        """file, bytes, sha256 of the files of the pairs, as they are now."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.at("pairs"))
        return found.select(F.regexp_extract("path", "/pairs/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def files(self) -> DataFrame:
        """file, bytes, sha256, rows of every file of the pairs."""
        rows = self.read("pairs").groupBy(F.regexp_extract(F.col("_metadata.file_path"), "/pairs/(.*)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        return self._parts().join(rows, "file", "left").select("file", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))

    def file_faults(self) -> DataFrame:
        """file, fault: files of the pairs that are missing, that nobody wrote, or that are not as they were written."""
        was, now = self.read("files").select("file", F.col("sha256").alias("was")), self._parts().select("file", F.col("sha256").alias("now"))
        fault = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("was") != F.col("now"), "changed")
        return was.join(now, "file", "full_outer").select("file", fault.alias("fault")).where("fault IS NOT NULL")

    def metadata(self) -> DataFrame:
        """One nested row: configuration, counts of the split, sources by dataset, statistics, and the text that says how it was made.

        Lists of windows are the tables of the stages, which the row names; it doesn't grow with them.
        """
        s, c = self.read("split"), self.config
        total = split.audit(s).select(F.struct("total", "train", "validate", "discard", "share", "n_groups").alias("split_audit"))
        of = self.read("inventory").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("num_frames").alias("frames"))
        sets = of.agg(F.array_sort(F.collect_list(F.struct("dataset", "n_sources", "frames"))).alias("datasets"))
        stats = self.read("statistics").agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "std"))).alias("latents"))
        tables = F.create_map(*[F.lit(x) for stage in STAGES[:5] for x in (stage, self.at(stage))])
        text = [
            f"Windows of {c.segment} samples begin every {c.hop} samples at {c.rate} samples a second.",
            f"Windows are split by keyed ranks (seed {c.seed}) until {c.target} of the usable ones validate; training windows that overlap these are discarded.",
            "Views of one recording at one start are validated together." if c.grouped else "Every recording is split by itself.",
            f"Each kept window has {c.variants} degraded variants, drawn by key from the degradation model.",
            f"Latents of encoder {c.encoder} are normalised by mean and deviation of {'training' if c.scope == 'train' else 'all'} windows." if c.output == "latents" else "Pairs are waveforms.",
        ]
        row = total.crossJoin(sets).crossJoin(stats)
        return row.select(F.lit(json.dumps(asdict(c), sort_keys=True)).alias("config"), F.lit(self.source).alias("source"), "split_audit", "datasets", "latents", tables.alias("tables"), F.lit("\n".join(text)).alias("methods"))

    def audit(self) -> DataFrame:
        """rule, bad: what is read back from the folder against what the stages before promise."""
        c, s, pairs = self.config, self.read("split"), self.read("pairs")
        x = "z_cond" if c.output == "latents" else "x"
        out = validate(pairs.withColumnRenamed(x, "z_cond") if x == "z_cond" else pairs.withColumn("z_cond", F.array("x")), s.where("split <> 'discard'").select("global_idx"), c.variants)
        placed = pairs.select("global_idx", F.col("split").alias("own")).join(s.select("global_idx", "split"), "global_idx").where("own <> split")
        out = out.unionAll(placed.agg(F.count(F.lit(1)).alias("bad")).select(F.lit("wrong_split").alias("rule"), "bad"))
        if c.output == "latents":
            sizes = F.transform("z_cond", lambda r: F.size(r))
            ragged = pairs.where((F.size("z_clean") != F.size("z_cond")) | (F.array_min(sizes) != F.array_max(sizes)) | (F.size(F.get("z_clean", F.lit(0))) != F.array_max(sizes)))
            out = out.unionAll(ragged.agg(F.count(F.lit(1)).alias("bad")).select(F.lit("unequal_lengths").alias("rule"), "bad"))
        out = out.unionAll(self.file_faults().agg(F.count(F.lit(1)).alias("bad")).select(F.lit("files").alias("rule"), "bad"))
        whole = split.partition_check(s, self.read("windows"), "source_idx", "local_idx").select(F.col("check").alias("rule"), F.col("n").alias("bad"))
        return out.unionAll(whole).unionAll(split.problems(s, windows.overlap_radius(c.segment, c.hop)))


def _none(faults: DataFrame, where: str) -> None:
    found = [r["fault"] for r in faults.limit(5).collect()]
    if found:
        raise ValueError(f"faults of {where}: {', '.join(found)}")


def precompute(spark: SparkSession, source: str, path: str, noise: DataFrame, config: Config, listed: DataFrame | None = None) -> DataFrame:
    """The pairs of a whole, audited dataset: split, ids, degradation_idx, z_clean, z_cond. An audit with faults stops it."""
    made = Dataset(spark, path, source, config, listed, noise)
    _none(made.build().where("bad > 0").select(F.concat_ws(": ", "rule", F.col("bad").cast("string")).alias("fault")), "the audit")
    return made.read("pairs")


def validate(pairs: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """rule, bad: incomplete windows, windows that shouldn't be there, windows that are missing, broken values."""
    row = lambda name, df: df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("rule"), "bad")
    ids = pairs.select(F.col("global_idx").alias("window_idx"), "degradation_idx")
    broken = pairs.where(F.exists("z_cond", lambda c: F.exists(c, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))))
    return (
        row("incomplete", evaluate.completeness(ids, n)).unionAll(row("unexpected", pairs.join(kept, "global_idx", "left_anti")))
        .unionAll(row("missing", kept.join(pairs, "global_idx", "left_anti"))).unionAll(row("not_finite", broken))
    )
