"""Manifests of recordings: cleaning, rules, reconciliation with an inventory of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dealt

#: Columns a manifest has.
COLUMNS = ("recording_id", "kind", "dataset", "song", "family", "output_file")
KINDS = ("full_mix", "section_mix")


def normalize(manifest: DataFrame) -> DataFrame:
    """Blanks around output_file, recording_id, kind and family are dropped."""
    return manifest.select(*[F.trim(c).alias(c) if c in ("output_file", "recording_id", "kind", "family") else F.col(c) for c in manifest.columns])


def violations(manifest: DataFrame) -> DataFrame:
    """output_file, rule: a row for each rule that a manifest row breaks (all of them, not the first)."""
    file, bad = F.col("output_file"), lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array_compact(F.array(
        bad(F.length(file) == 0, "no_output_file"), bad(file.contains("/") | file.contains("\\"), "not_a_bare_name"), bad(F.length("recording_id") == 0, "no_recording_id"),
        bad(~F.col("kind").isin(*KINDS), "unknown_kind"), bad((F.col("kind") == "full_mix") & (F.col("family") != "full_mix"), "family_of_full_mix"),
    ))
    return manifest.select("output_file", F.explode(rules).alias("rule"))


def reconcile(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """name, state of every name that only the manifest (missing) or only the folder (unexpected) has."""
    listed = manifest.select(F.col("output_file").alias("name")).distinct().withColumn("_m", F.lit(True))
    found = names.select("name").distinct().withColumn("_f", F.lit(True))
    both = listed.join(found, "name", "full_outer").where("_m IS NULL OR _f IS NULL")
    return both.select("name", F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("state"))


def enrich(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (name, source_idx) with their manifest attributes, or the defaults of an unlisted source: it is a recording and a group of its own."""
    m = manifest.select(F.col("output_file").alias("name"), *[c for c in (*COLUMNS, "group_idx") if c != "output_file"])
    pick = lambda c, default: F.coalesce(F.col(c), default).alias(c)
    return sources.join(m, "name", "left").select(
        "name", "source_idx", pick("recording_id", F.col("name")), pick("group_idx", F.col("source_idx")), pick("kind", F.lit("full_mix")), pick("family", F.lit("full_mix")),
        pick("dataset", F.lit("unmanifested")), pick("song", F.regexp_replace("name", r"\.[^.]*$", "")),
    )


def full_mix_faults(manifest: DataFrame) -> DataFrame:
    """Recordings that don't have exactly one full mix."""
    return manifest.groupBy("recording_id").agg(F.count_if(F.col("kind") == "full_mix").alias("n_full")).where("n_full <> 1")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of more than one row, and how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sample_rate_faults(sources: DataFrame, rate: int) -> DataFrame:
    return sources.where(F.col("orig_sr") != rate)


def long_enough(sources: DataFrame, segment: int, rate: int, min_stems: int = 1) -> DataFrame:
    """Sources with stems enough and a length of a segment at the target rate."""
    frames = F.floor(F.col("num_frames") * rate / F.col("orig_sr"))
    return sources.where((frames >= segment) & (F.col("n_stems") >= min_stems))


def provenance_faults(windows: DataFrame) -> DataFrame:
    """rule, n: windows with a negative index or start, and ids used twice."""
    negative = F.count_if((F.col("source_idx") < 0) | (F.col("local_idx") < 0) | (F.col("start_sample") < 0) | (F.col("group_idx") < 0))
    first = windows.agg(negative.alias("n")).select(F.lit("negative").alias("rule"), "n")
    return first.unionAll(duplicates(dealt(windows.select("global_idx"), "global_idx"), "global_idx").agg(F.count(F.lit(1)).alias("n")).select(F.lit("id_used_twice").alias("rule"), "n"))


def media_failures(assets: DataFrame, rate: int = 44100, channels: int = 2, shortest: float = 5.0, longest: float = 5.1, quietest: float = -80.0, loudest: float = 0.0, expected: int | None = None) -> DataFrame:
    """doc_id, rule for every rule that an asset breaks; a row without doc_id if there are not as many assets as expected."""
    bad = lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array_compact(F.array(
        bad(F.col("found_sha256") != F.col("listed_sha256"), "sha256"), bad(F.col("sample_rate") != rate, "sample_rate"), bad(F.col("channels") != channels, "channels"),
        bad((F.col("duration") < shortest) | (F.col("duration") > longest), "duration"), bad(F.col("mean_db") < quietest, "mean_db"), bad(F.col("peak_db") > loudest, "peak_db"),
    ))
    found = assets.select("doc_id", F.explode(rules).alias("rule"))
    if expected is None:
        return found
    count = assets.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return found.unionByName(count.select(F.lit(None).cast(dict(assets.dtypes)["doc_id"]).alias("doc_id"), F.lit("row_count").alias("rule")))


def checksum_faults(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose digest isn't the listed one; files that only one side has are ignored."""
    return found.join(listed, "name").where("found <> listed").select("name", "found", "listed")
