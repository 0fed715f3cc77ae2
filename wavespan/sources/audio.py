"""Files: PCM WAV folders, manifests, pair caches, checksums, selections; and what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import COLUMNS
from ..operators.pieces import SIZE, full_windows
from . import wav


def name_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("wav",), recursive: bool = False) -> DataFrame:
    """path, name, bytes of files with one of the extensions in any case; contents are not read."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", name_of("path").alias("name"), F.col("length").alias("bytes"))


def stem_folders(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("wav",)) -> DataFrame:
    """song, stems (sorted names) of each folder."""
    rows = inventory(spark, path, extensions, recursive=True).withColumn("song", F.element_at(F.split("path", "/"), -2))
    return rows.groupBy("song").agg(F.array_sort(F.collect_list("name")).alias("stems"))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """name, rate, frames, channels, bits of every WAV file of a folder; only headers are read."""
    return wav.headers(spark, path)


def read_windows(spark: SparkSession, path: str, segment: int, hop: int, size: int = SIZE) -> DataFrame:
    """name, local_idx, start_sample, x (mono) of all full windows of a folder; a long file is many tasks."""
    size = max(size, segment)
    return full_windows(wav.pieces(spark, path, size, segment), segment, hop, size).select("name", "local_idx", "start_sample", "x")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest, all strings; a file without the known columns is refused, further columns pass."""
    found = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    missing = [c for c in COLUMNS if c not in found.columns]
    if missing:
        raise ValueError(f"the manifest lacks {missing}")
    return found.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in found.columns])


def parse_pair_names(files: DataFrame) -> DataFrame:
    """name, window_idx, degradation_idx from window_NNNNNN_degradation_DD (any width); the metadata file is left out.

    Names that don't match have null indices, for the caller to refuse.
    """
    part = lambda k: F.expr(f"try_cast(nullif(regexp_extract(name, 'window_(\\\\d+)_degradation_(\\\\d+)', {k}), '') AS BIGINT)")
    return files.where(~F.col("name").contains("metadata")).select("name", part(1).alias("window_idx"), part(2).alias("degradation_idx"))


def pair_name(window: str = "window_idx", degradation: str = "degradation_idx") -> Column:
    return F.format_string("window_%06d_degradation_%02d.pt", F.col(window).cast("long"), F.col(degradation).cast("long"))


def scan_checksums(spark: SparkSession, path: str) -> DataFrame:
    """name, listed from lines 'sha256  name'."""
    line = r"^([0-9a-fA-F]{64})\s+\*?(\S.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 2).alias("name"), F.lower(F.regexp_extract("value", line, 1)).alias("listed"))


def scan_selection(spark: SparkSession, path: str) -> DataFrame:
    """pos, global_idx of a selection file; an empty list or one with repeats is refused."""
    rows = spark.read.schema("global_window_indices array<long>").option("multiLine", True).json(path)
    ids = F.col("global_window_indices")
    ok = F.coalesce((F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & ~F.exists(ids, lambda x: x.isNull()), F.lit(False))
    checked = rows.select(F.when(ok, ids).otherwise(F.raise_error(F.lit("a selection is a list of distinct integers")).cast("array<bigint>")).alias("ids"))
    return checked.select(F.posexplode("ids").alias("pos", "global_idx"))


def selected_windows(spark: SparkSession, explicit: list[int] | None = None, path: str | None = None, default: tuple[int, ...] = ()) -> DataFrame:
    """pos, global_idx: the explicit list if there is one, else the selection file, else the default."""
    if explicit is None and path is not None:
        return scan_selection(spark, path)
    ids = list(default if explicit is None else explicit)
    if not ids or len(set(ids)) < len(ids):
        raise ValueError("a selection is a list of distinct integers")
    return spark.createDataFrame(list(enumerate(ids)), "pos int, global_idx long")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether an output has its success marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def output_path(root: str, path: str, suffix: str) -> Column:
    """Path under a root with another ending."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Partitioned by split; a path that exists is refused. Spark's commit writes _SUCCESS last."""
    pairs.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_clean_targets(pairs: DataFrame, path: str) -> None:
    """One clamped target for each window."""
    clamp = F.transform("clean", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))
    pairs.select("window_idx", clamp.alias("clean")).dropDuplicates(["window_idx"]).write.mode("errorifexists").parquet(path)


def write_metadata(summary: DataFrame, path: str) -> str:
    """One nested row as JSON, and a readable text of it."""
    summary.coalesce(1).write.mode("errorifexists").json(path)
    row = summary.first().asDict(recursive=True)
    return "\n".join(f"{k}: {v}" for k, v in row.items())


def write_manifest(assets: DataFrame, path: str) -> None:
    assets.write.mode("errorifexists").csv(f"{path}/csv", header=True)
    assets.write.mode("errorifexists").json(f"{path}/json")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """tag, value, step; a partition for each tag."""
    metrics.write.mode("append").partitionBy("tag").parquet(path)
