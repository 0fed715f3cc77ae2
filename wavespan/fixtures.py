"""Recordings, windows, pairs, signals, ratings and logs derived from the shared tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rng
from .operators import pieces as cut
from .operators.ranks import in_order, with_positions
from .shared import dealt, saved, scratch  # noqa: F401  queries take scratch from here

SEGMENT, HOP, RADIUS, SEED, TARGET = 400, 40, 9, 42, 0.1


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def recordings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rec = F.concat(F.lit("rec_"), F.lpad(F.floor(i / 3).cast("string"), 6, "0"))
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("src_"), F.lpad(i.cast("string"), 6, "0"), F.lit(".wav")).alias("output_file"), rec.alias("recording_id"),
        F.when(i % 3 == 0, "full_mix").otherwise("section_mix").alias("kind"),
        F.when(i % 3 == 0, "full_mix").when(i % 3 == 1, "strings").otherwise("winds").alias("family"),
        F.col("source").alias("dataset"), rec.alias("song"), F.col("n_chars").alias("num_frames"), F.when(i % 50 == 7, 22050).otherwise(44100).alias("orig_sr"),
    )


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with faults of every kind."""
    i, r = F.col("doc_id"), recordings(spark, d)
    before = F.concat(F.lit("src_"), F.lpad((i - 1).cast("string"), 6, "0"), F.lit(".wav"))
    name = F.when(i % 37 == 1, F.concat(F.lit("  "), "output_file", F.lit(" "))).when(i % 43 == 3, F.concat(F.lit("a/"), "output_file")).when(i % 53 == 5, before).otherwise(F.col("output_file"))
    return r.select(
        "doc_id", name.alias("output_file"), F.when(i % 47 == 4, "").otherwise(F.col("recording_id")).alias("recording_id"),
        F.when(i % 41 == 2, "other").otherwise(F.col("kind")).alias("kind"), "family", "dataset", "song",
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    """Names that a folder holds: some recordings are missing, some files unexpected."""
    r = recordings(spark, d)
    extra = r.where("doc_id % 31 = 8").select(F.concat(F.lit("extra_"), F.col("doc_id").cast("string")).alias("name"))
    return r.where("doc_id % 29 <> 6").select(F.col("output_file").alias("name")).unionAll(extra)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """window_idx, degradation_idx, sse, n of cached pairs."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("window_idx"), (F.col("l_linenumber") - 1).cast("int").alias("degradation_idx"), "l_tax", "l_quantity")
    g = dealt(rows, "window_idx").groupBy("window_idx", "degradation_idx")
    return g.agg(F.sum(F.col("l_tax").cast("double")).alias("sse"), F.sum(F.col("l_quantity").cast("double")).alias("n"))


def samples(spark: SparkSession, d: str, scale: float = 250.0) -> DataFrame:
    """user_id, pos, v: the samples of one signal for each user, in the order of time."""
    return cut.numbered(table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / scale - 1).alias("v")), "user_id", "ts", "event_id").select("user_id", "pos", "v")


def pieces(spark: SparkSession, d: str, scale: float = 250.0, size: int = cut.SIZE, halo: int = 0) -> DataFrame:
    """The signals in pieces: a user with very many events is many rows."""
    return cut.pieces(samples(spark, d, scale), "user_id", size, halo)


def latents(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, x (64 channels, one frame, as double)."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def latent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, a, b: each vector with the next one of its label; vectors meet by their place, not in a window over a label."""
    own = with_positions(saved(in_order(latents(spark, d), "label", "vec_id"), "latents"), "at")
    after = own.select(F.col("label").alias("_label"), (F.col("at") - 1).alias("at"), F.col("x").alias("b"))
    return own.join(after, "at").where("label = _label").select("vec_id", "label", F.col("x").alias("a"), "b")


def noise(spark: SparkSession, d: str) -> DataFrame:
    """noise_idx, samples: the vectors with label 0."""
    own = table(spark, d, "embeddings").where("label = 0").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    return with_positions(saved(in_order(own, "vec_id"), "noise"), "noise_idx").select("noise_idx", "samples")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    c = F.when(kind == "view", "INPUT").when(kind == "click", "RIVAL_A").when(kind == "signup", "RIVAL_B").when(kind == "purchase", "MODEL").otherwise("GROUND_TRUTH")
    return table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 40).alias("rater"), c.alias("condition"), F.when(i % 2 == 0, "solo").otherwise("ensemble").alias("category"),
        (i % 4).alias("item"), (1 + F.floor("value") % 5).cast("double").alias("rating"),
    )


def steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").cast("int").alias("worker"), F.col("l_returnflag").alias("stage"),
        (F.col("l_discount") + 0.01).alias("secs"), F.col("l_extendedprice").alias("peak"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """run, path, is_latest, has_config of stored artifacts; even runs have a pointer to the latest."""
    base = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("step")).distinct()
    own = base.select("run", F.concat(F.lit("step_"), F.col("step").cast("string"), F.lit(".pt")).alias("path"))
    pointer = base.where("run % 2 = 0").select("run", F.lit("latest.pt").alias("path")).distinct()
    return own.unionAll(pointer).withColumn("has_config", F.col("run") % 3 != 0)


def losses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select((i + 1).alias("step"), F.when(i % 97 == 0, float("nan")).otherwise(F.col("value")).alias("loss"), F.col("event_type").alias("tag"))


def assets(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    good = F.sha2(F.col("text"), 256)
    return table(spark, d, "documents").select(
        "doc_id", good.alias("found_sha256"), F.when(i % 23 == 9, F.sha2(F.lit("x"), 256)).otherwise(good).alias("listed_sha256"),
        F.when(i % 19 == 3, 48000).otherwise(44100).alias("sample_rate"), F.when(i % 17 == 4, 1).otherwise(2).alias("channels"),
        (5.0 + (i % 13) / 100.0).alias("duration"), (-20.0 - (i % 71)).alias("mean_db"), (1.0 - (i % 11)).alias("peak_db"),
    )


#: DuckDB definitions; each may use those before it.
SQL: dict[str, str] = {
    "rec": "SELECT doc_id, 'src_' || lpad(doc_id::VARCHAR, 6, '0') || '.wav' AS output_file, 'rec_' || lpad((doc_id // 3)::VARCHAR, 6, '0') AS recording_id, CASE WHEN doc_id % 3 = 0 THEN 'full_mix' ELSE 'section_mix' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'full_mix' WHEN 1 THEN 'strings' ELSE 'winds' END AS family, source AS dataset, 'rec_' || lpad((doc_id // 3)::VARCHAR, 6, '0') AS song, n_chars AS num_frames, CASE WHEN doc_id % 50 = 7 THEN 22050 ELSE 44100 END AS orig_sr FROM documents",
    "dirty": "SELECT doc_id, CASE WHEN doc_id % 37 = 1 THEN '  ' || output_file || ' ' WHEN doc_id % 43 = 3 THEN 'a/' || output_file WHEN doc_id % 53 = 5 THEN 'src_' || lpad((doc_id - 1)::VARCHAR, 6, '0') || '.wav' ELSE output_file END AS output_file, CASE WHEN doc_id % 47 = 4 THEN '' ELSE recording_id END AS recording_id, CASE WHEN doc_id % 41 = 2 THEN 'other' ELSE kind END AS kind, family, dataset, song FROM rec",
    "files": "SELECT output_file AS name FROM rec WHERE doc_id % 29 <> 6 UNION ALL SELECT 'extra_' || doc_id FROM rec WHERE doc_id % 31 = 8",
    "win": f"SELECT doc_id AS source_idx, doc_id // 3 AS group_idx, i AS local_idx, i * {HOP} AS start_sample, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || i), 1, 13))::UBIGINT::BIGINT AS h FROM (SELECT doc_id, unnest(range(0, (num_frames - {SEGMENT}) // {HOP} + 1)) AS i FROM rec WHERE num_frames >= {SEGMENT})",
    "prom": "SELECT *, min(h) OVER (PARTITION BY group_idx, local_idx) AS p FROM win",
    "left_at": f"SELECT *, min(p) OVER (PARTITION BY group_idx ORDER BY local_idx RANGE BETWEEN {RADIUS} PRECEDING AND {RADIUS} FOLLOWING) AS b FROM prom",
    "curve": "SELECT x, sum(v) OVER (ORDER BY x)::BIGINT AS val, sum(t) OVER (ORDER BY x)::BIGINT AS gone FROM (SELECT x, sum(v) AS v, sum(t) AS t FROM (SELECT p AS x, 1 AS v, 0 AS t FROM left_at UNION ALL SELECT b, 0, 1 FROM left_at) GROUP BY x)",
    "cut": f"SELECT min(x) AS x FROM curve WHERE val::DOUBLE / (val + (SELECT count(*) FROM win) - gone) >= {TARGET}",
    "split": "SELECT source_idx, group_idx, local_idx, start_sample, CASE WHEN p <= x THEN 'validate' WHEN b > x THEN 'train' ELSE 'discard' END AS split FROM left_at, cut",
    "broken": "SELECT source_idx, group_idx, local_idx, start_sample, CASE WHEN local_idx % 97 = 5 THEN 'train' WHEN local_idx % 101 = 11 THEN 'other' ELSE split END AS split FROM split UNION ALL SELECT source_idx, group_idx, local_idx, start_sample, 'discard' FROM split WHERE local_idx % 89 = 3",
    "pairs": "SELECT l_orderkey AS window_idx, (l_linenumber - 1)::INTEGER AS degradation_idx, sum(l_tax::DOUBLE) AS sse, sum(l_quantity::DOUBLE) AS n FROM lineitem GROUP BY ALL",
    "sig": "SELECT user_id, list(value / 250.0 - 1 ORDER BY ts, event_id) AS x FROM events GROUP BY user_id",
    "hot": "SELECT user_id, list(value / 100.0 - 1 ORDER BY ts, event_id) AS x FROM events GROUP BY user_id",
    "lat": "SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings",
    "lp": "SELECT * FROM (SELECT vec_id, label, x AS a, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM lat) WHERE b IS NOT NULL",
    "noise": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS noise_idx, x AS samples FROM lat WHERE label = 0",
    "rat": "SELECT event_id, user_id % 40 AS rater, CASE event_type WHEN 'view' THEN 'INPUT' WHEN 'click' THEN 'RIVAL_A' WHEN 'signup' THEN 'RIVAL_B' WHEN 'purchase' THEN 'MODEL' ELSE 'GROUND_TRUTH' END AS condition, CASE WHEN event_id % 2 = 0 THEN 'solo' ELSE 'ensemble' END AS category, event_id % 4 AS item, (1 + floor(value)::BIGINT % 5)::DOUBLE AS rating FROM events",
    "steps": "SELECT l_suppkey AS run, l_orderkey AS step, l_linenumber::INTEGER AS worker, l_returnflag AS stage, l_discount + 0.01 AS secs, l_extendedprice AS peak FROM lineitem",
    "arts": "SELECT run, path, run % 3 <> 0 AS has_config FROM (SELECT DISTINCT l_suppkey AS run, 'step_' || l_orderkey || '.pt' AS path FROM lineitem UNION SELECT DISTINCT l_suppkey, 'latest.pt' FROM lineitem WHERE l_suppkey % 2 = 0)",
    "loss": "SELECT event_id + 1 AS step, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value END AS loss, event_type AS tag FROM events",
    "assets": "SELECT doc_id, sha256(text) AS found_sha256, CASE WHEN doc_id % 23 = 9 THEN sha256('x') ELSE sha256(text) END AS listed_sha256, CASE WHEN doc_id % 19 = 3 THEN 48000 ELSE 44100 END AS sample_rate, CASE WHEN doc_id % 17 = 4 THEN 1 ELSE 2 END AS channels, 5.0::DOUBLE + (doc_id % 13) / 100.0::DOUBLE AS duration, -20.0::DOUBLE - (doc_id % 71) AS mean_db, 1.0::DOUBLE - (doc_id % 11) AS peak_db FROM documents",
}

#: Spectra of 32 samples, 8 apart, ends reflected, under a periodic Hann window: a join with cosines and sines.
SQL["padded"] = "SELECT user_id, CASE WHEN len(x) > 16 THEN list_concat(list_reverse(x[2:17]), x, list_reverse(x[-17:-2])) ELSE list_concat(list_resize([]::DOUBLE[], 16, 0.0), x, list_resize([]::DOUBLE[], 16, 0.0)) END AS p, len(x) AS n FROM sig"
SQL["frames"] = "SELECT user_id, f, list_transform(p[(f * 8 + 1):(f * 8 + 32)], lambda v, k: v * 0.5 * (1 - cos(2 * pi() * (k - 1) / 32))) AS w FROM (SELECT user_id, p, unnest(range(0, n // 8 + 1)) AS f FROM padded)"
SQL["spec"] = "SELECT user_id, f::INTEGER AS frame, b::INTEGER AS bin, list_sum(list_transform(w, lambda v, k: v * cos(2 * pi() * b * (k - 1) / 32))) AS re, -list_sum(list_transform(w, lambda v, k: v * sin(2 * pi() * b * (k - 1) / 32))) AS im FROM frames, range(0, 17) t(b)"
#: The same split of recordings that are signals of users: windows of 32 samples, 8 apart, two users a recording.
SQL["src2"] = "SELECT user_id, row_number() OVER (ORDER BY 'sig_' || user_id || '.wav') - 1 AS source_idx, dense_rank() OVER (ORDER BY 'rec_' || (user_id // 2)) - 1 AS group_idx, list_transform(x, lambda v: round_even(greatest(-1.0, least(1.0, v)) * 32767, 0) / 32768) AS y FROM hot WHERE len(x) >= 32"
SQL["win2"] = f"SELECT source_idx, group_idx, i AS local_idx, i * 8 AS start_sample, y[(i * 8 + 1):(i * 8 + 32)] AS y, ('0x' || substr(md5('{SEED}:' || source_idx || ':' || i), 1, 13))::UBIGINT::BIGINT AS h FROM (SELECT *, unnest(range(0, (len(y) - 32) // 8 + 1)) AS i FROM src2)"
for _name, _from in (("prom", "win"), ("left_at", "prom"), ("curve", "left_at"), ("cut", "curve"), ("split", "left_at")):
    SQL[f"{_name}2"] = re.sub(r"\b(win|prom|left_at|curve|cut)\b(?=[\s,)]|$)", r"\g<1>2", SQL[_name]).replace(f"BETWEEN {RADIUS} PRECEDING AND {RADIUS} FOLLOWING", "BETWEEN 3 PRECEDING AND 3 FOLLOWING")
SQL["split2"] = SQL["split2"].replace("start_sample, CASE", "start_sample, y, row_number() OVER (ORDER BY source_idx, local_idx) - 1 AS global_idx, CASE")


def sql(body: str) -> str:
    """body with the definitions it uses in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                add(SQL[name])
                if name not in need:
                    need.append(name)

    add(body)
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in need) + " " if need else "") + body
