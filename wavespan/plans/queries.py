"""Registered queries of the signal-dataset operators over the shared tables, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import HOP, RADIUS, SEED, SEGMENT, TARGET, sql
from ..functions import arrays, rng
from ..operators import augment, chunks, evaluate, loudness, manifest, pieces, split, windows
from ..shared import COSTLY_ROWS, dealt
from ..sources import audio
from . import dataset

QUERIES = {}
SQL = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = sql(text)
        return f

    return add


def digest(df: DataFrame, key: str, x: str | Column) -> DataFrame:
    """key, n, total, moment: the length, sum and position-weighted sum of an array column."""
    v = F.col(x) if isinstance(x, str) else x
    moment = F.aggregate(F.transform(v, lambda a, i: a * (i + 1)), F.lit(0.0), lambda s, a: s + a)
    return df.select(key, F.size(v).cast("long").alias("n"), F.round(arrays.total(v), 6).alias("total"), F.round(moment, 6).alias("moment"))


def digest_pieces(rows: DataFrame, key: str) -> DataFrame:
    """The same of whole signals, from their pieces."""
    moment = F.aggregate(F.transform("x", lambda a, i: a * (F.col("begin") + i + 1)), F.lit(0.0), lambda s, a: s + a)
    g = rows.select(key, F.size("x").alias("k"), arrays.total(F.col("x")).alias("t"), moment.alias("m")).groupBy(key)
    return g.agg(F.sum("k").alias("n"), F.round(F.sum("t"), 6).alias("total"), F.round(F.sum("m"), 6).alias("moment"))


def digest_sql(key: str, x: str, source: str) -> str:
    return f"SELECT {key}, len(y) AS n, round(list_sum(y), 6) + 0.0 AS total, round(list_sum(list_transform(y, lambda v, i: v * i)), 6) + 0.0 AS moment FROM (SELECT {key}, {x} AS y FROM {source})"


def sources(spark: SparkSession, d: str) -> DataFrame:
    return fx.recordings(spark, d).withColumn("source_idx", F.col("doc_id"))


def all_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.make_windows(fx.recordings(spark, d), SEGMENT, HOP)
    rows = rows.select(F.col("doc_id").alias("source_idx"), F.floor(F.col("doc_id") / 3).alias("group_idx"), "dataset", "local_idx", "start_sample")
    return split.ranked(rows, SEED, "source_idx", "local_idx")


def all_split(spark: SparkSession, d: str) -> DataFrame:
    return split.split_windows(all_windows(spark, d), "group_idx", RADIUS, TARGET)


# A. Sources and sinks


@query("scan_pair_cache", "SELECT window_idx, degradation_idx::BIGINT AS degradation_idx, count(*) AS n FROM pairs GROUP BY ALL")
def scan_pair_cache(spark, d):
    names = fx.pairs(spark, d).select(audio.pair_name().alias("name"))
    return audio.parse_pair_names(names).groupBy("window_idx", "degradation_idx").agg(F.count(F.lit(1)).alias("n"))


@query("map_output_paths", "SELECT doc_id, '/out/' || replace(output_file, '.wav', '_restored.wav') AS path FROM rec")
def map_output_paths(spark, d):
    return fx.recordings(spark, d).select("doc_id", audio.output_path("/out", "output_file", "_restored.wav").alias("path"))


# B. Projections and rules


@query("normalize_manifest", "SELECT doc_id, trim(output_file) AS output_file, trim(recording_id) AS recording_id, trim(kind) AS kind, trim(family) AS family, dataset, song FROM dirty")
def normalize_manifest(spark, d):
    return manifest.normalize(fx.dirty(spark, d)).select("doc_id", "output_file", "recording_id", "kind", "family", "dataset", "song")


@query(
    "manifest_violations",
    "SELECT trim(output_file) AS output_file, unnest(list_filter([CASE WHEN trim(output_file) = '' THEN 'no_output_file' END, CASE WHEN contains(output_file, '/') THEN 'not_a_bare_name' END, CASE WHEN recording_id = '' THEN 'no_recording_id' END, CASE WHEN kind NOT IN ('full_mix', 'section_mix') THEN 'unknown_kind' END, CASE WHEN kind = 'full_mix' AND family <> 'full_mix' THEN 'family_of_full_mix' END], lambda r: r IS NOT NULL)) AS rule FROM dirty",
)
def manifest_violations(spark, d):
    return manifest.violations(manifest.normalize(fx.dirty(spark, d)))


@query("filter_sample_rate", "SELECT doc_id, orig_sr FROM rec WHERE orig_sr <> 44100")
def filter_sample_rate(spark, d):
    return manifest.sample_rate_faults(fx.recordings(spark, d), 44100).select("doc_id", "orig_sr")


@query("filter_min_duration", f"SELECT doc_id, num_frames FROM rec WHERE floor(num_frames * 44100 / orig_sr) >= {SEGMENT} AND doc_id % 5 >= 2")
def filter_min_duration(spark, d):
    return manifest.long_enough(fx.recordings(spark, d).withColumn("n_stems", F.col("doc_id") % 5), SEGMENT, 44100, 2).select("doc_id", "num_frames")


@query("finite_guard", "SELECT event_id, isfinite(loss) AS ok FROM (SELECT step - 1 AS event_id, loss FROM loss)")
def finite_guard(spark, d):
    return fx.losses(spark, d).select((F.col("step") - 1).alias("event_id"), arrays.all_finite(F.array("loss")).alias("ok"))


@query("provenance_guard", "SELECT 'negative' AS rule, count_if(local_idx % 50 = 7) AS n FROM win UNION ALL SELECT 'id_used_twice', (SELECT count(*) FROM (SELECT 1 FROM (SELECT CASE WHEN g % 10 = 3 THEN g + 1 ELSE g END AS g FROM (SELECT row_number() OVER (ORDER BY source_idx, local_idx) - 1 AS g FROM win)) GROUP BY g HAVING count(*) > 1))")
def provenance_guard(spark, d):
    """On windows with planted faults: negative starts, and ids used twice."""
    rows = windows.global_index(sources(spark, d), SEGMENT, HOP).withColumn("group_idx", F.floor(F.col("doc_id") / 3))
    g = F.col("global_idx")
    rows = rows.withColumn("start_sample", F.when(F.col("local_idx") % 50 == 7, -1).otherwise(F.col("start_sample"))).withColumn("global_idx", F.when(g % 10 == 3, g + 1).otherwise(g))
    return manifest.provenance_faults(rows)


@query("filter_requested_windows", "SELECT window_idx, degradation_idx FROM pairs WHERE window_idx IN (SELECT event_id * 3 FROM events)")
def filter_requested_windows(spark, d):
    ids = fx.table(spark, d, "events").select((F.col("event_id") * 3).alias("window_idx"))
    return fx.pairs(spark, d).join(ids, "window_idx", "left_semi").select("window_idx", "degradation_idx")


@query("cadence_filter", "SELECT step, step = 1 OR step % 50 = 0 AS validation, step > 1 AND step % 120 = 0 AS audio FROM loss WHERE step = 1 OR step % 50 = 0 OR step % 120 = 0")
def cadence_filter(spark, d):
    return evaluate.due_steps(fx.losses(spark, d), 50, 120)


@query(
    "media_rules",
    "SELECT doc_id, unnest(list_filter([CASE WHEN found_sha256 <> listed_sha256 THEN 'sha256' END, CASE WHEN sample_rate <> 44100 THEN 'sample_rate' END, CASE WHEN channels <> 2 THEN 'channels' END, CASE WHEN duration < 5.0 OR duration > 5.1::DOUBLE THEN 'duration' END, CASE WHEN mean_db < -80 THEN 'mean_db' END, CASE WHEN peak_db > 0 THEN 'peak_db' END], lambda r: r IS NOT NULL)) AS rule FROM assets UNION ALL SELECT NULL, 'row_count'",
)
def media_rules(spark, d):
    """One asset more is expected than there is."""
    a = fx.assets(spark, d)
    return manifest.media_failures(a, expected=a.count() + 1)


@query("window_shape_guard", "SELECT user_id, len(x) AS n FROM sig WHERE len(x) <> 67")
def window_shape_guard(spark, d):
    return fx.pieces(spark, d).groupBy("user_id").agg(F.sum(F.size("x")).alias("n")).where("n <> 67")


# C. Joins


@query("reconcile_inventory", "SELECT coalesce(r.output_file, f.name) AS name, CASE WHEN f.name IS NULL THEN 'missing' ELSE 'unexpected' END AS state FROM rec r FULL JOIN files f ON r.output_file = f.name WHERE r.output_file IS NULL OR f.name IS NULL")
def reconcile_inventory(spark, d):
    return manifest.reconcile(fx.recordings(spark, d), fx.files(spark, d))


@query(
    "enrich_source",
    "SELECT f.name, i AS source_idx, coalesce(recording_id, f.name) AS recording_id, coalesce(g, i) AS group_idx, coalesce(kind, 'full_mix') AS kind, coalesce(family, 'full_mix') AS family, coalesce(dataset, 'unmanifested') AS dataset, coalesce(song, regexp_replace(f.name, '\\.[^.]*$', '')) AS song FROM (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM files) f LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY recording_id) - 1 AS g FROM rec) rec ON f.name = rec.output_file",
)
def enrich_source(spark, d):
    return manifest.enrich(windows.dense_index(fx.files(spark, d), "name", "source_idx"), windows.dense_index(fx.recordings(spark, d), "recording_id", "group_idx"))


@query("fanout_degradations", "SELECT source_idx, local_idx, k::INTEGER AS degradation_idx FROM win, range(0, 3) t(k)")
def fanout_degradations(spark, d):
    return windows.fan_out(windows.make_windows(fx.recordings(spark, d), SEGMENT, HOP), 3).select(F.col("doc_id").alias("source_idx"), "local_idx", "degradation_idx")


@query("pair_to_clean", "SELECT p.window_idx, p.degradation_idx, o_custkey AS clean FROM pairs p JOIN orders ON p.window_idx = o_orderkey")
def pair_to_clean(spark, d):
    bank = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("window_idx"), F.col("o_custkey").alias("clean"))
    return fx.pairs(spark, d).select("window_idx", "degradation_idx").join(bank, "window_idx").select("window_idx", "degradation_idx", "clean")


@query("overlap_range_join", f"SELECT t.group_idx, t.source_idx, t.local_idx, v.local_idx AS val_local FROM split t JOIN split v ON t.group_idx = v.group_idx AND abs(t.local_idx - v.local_idx) <= {RADIUS + 1} WHERE t.split = 'train' AND v.split = 'validate'")
def overlap_range_join(spark, d):
    """With a radius one over that of the split, so that rows come out."""
    return split.overlaps(all_split(spark, d), RADIUS + 1).select("group_idx", "source_idx", "local_idx", "val_local")


@query("verify_checksums", "SELECT 'doc_' || doc_id AS name, found_sha256 AS found, listed_sha256 AS listed FROM assets WHERE found_sha256 <> listed_sha256")
def verify_checksums(spark, d):
    a = fx.assets(spark, d).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "doc_id", F.col("found_sha256").alias("found"), F.col("listed_sha256").alias("listed"))
    return manifest.checksum_faults(a.select("name", "found"), a.select("name", "listed"))


NOISE_PICK = f"('0x' || substr(md5('{SEED}:' || source_idx || ':' || local_idx || ':noise'), 1, 13))::UBIGINT::BIGINT"


@query("assign_noise", f"SELECT source_idx, local_idx, {NOISE_PICK} % (SELECT count(*) FROM noise) AS noise_idx FROM win")
def assign_noise(spark, d):
    rows = all_windows(spark, d).select("source_idx", "local_idx")
    return augment.assign_noise(rows, fx.noise(spark, d), SEED, "source_idx", "local_idx").select("source_idx", "local_idx", "noise_idx")


@query("retained_membership", "SELECT split, count(*) AS n FROM split WHERE split <> 'discard' GROUP BY split")
def retained_membership(spark, d):
    s = all_split(spark, d)
    ids = ["source_idx", "local_idx"]
    kept = s.join(s.where("split = 'discard'").select(*ids), ids, "left_anti")
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "condition_margin",
    "SELECT category, item, round(avg(rating) FILTER (condition = 'MODEL') - avg(rating) FILTER (condition = 'INPUT'), 6) + 0.0 AS improvement, round(avg(rating) FILTER (condition = 'MODEL') - avg(rating) FILTER (condition = 'RIVAL_A'), 6) + 0.0 AS margin FROM rat GROUP BY category, item",
)
def condition_margin(spark, d):
    return evaluate.condition_margin(fx.ratings(spark, d), "MODEL", "RIVAL_A", "INPUT")


@query("order_by_request", "SELECT pos, r.window_idx, p.n IS NOT NULL AS found FROM (SELECT event_id AS pos, event_id * 7 AS window_idx FROM events) r LEFT JOIN (SELECT window_idx, n FROM pairs WHERE degradation_idx = 0) p ON r.window_idx = p.window_idx")
def order_by_request(spark, d):
    ids = fx.table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7).alias("window_idx"))
    return evaluate.order_by_request(fx.pairs(spark, d).where("degradation_idx = 0").select("window_idx"), ids, "window_idx").select("pos", "window_idx", "found")


# D. Aggregations


@query("windows_per_source", f"SELECT doc_id, CASE WHEN num_frames >= {SEGMENT} THEN (num_frames - {SEGMENT}) // {HOP} + 1 ELSE 0 END AS n_windows FROM rec")
def windows_per_source(spark, d):
    return fx.recordings(spark, d).select("doc_id", windows.window_count(F.col("num_frames"), SEGMENT, HOP).alias("n_windows"))


@query(
    "split_audit",
    "SELECT dataset, count(*) AS total, count_if(split = 'train')::BIGINT AS train, count_if(split = 'validate')::BIGINT AS validate, count_if(split = 'discard')::BIGINT AS discard, round(coalesce(count_if(split = 'validate') / nullif(count_if(split <> 'discard'), 0)::DOUBLE, 0), 6) AS share, count(DISTINCT group_idx) AS n_groups FROM split JOIN rec ON source_idx = doc_id GROUP BY dataset",
)
def split_audit(spark, d):
    return split.audit(all_split(spark, d), "dataset")


STATS = "SELECT i - 1 AS channel, round(avg(v), 6) + 0.0 AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)), 6) AS std FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS i FROM lat) GROUP BY i"


@query("channel_stats", f"SELECT channel::INTEGER AS channel, mean, std FROM ({STATS})")
def channel_stats(spark, d):
    return evaluate.channel_stats(fx.latents(spark, d))


@query("one_full_mix_rule", "SELECT recording_id, count_if(kind = 'full_mix')::BIGINT AS n_full FROM dirty GROUP BY recording_id HAVING count_if(kind = 'full_mix') <> 1")
def one_full_mix_rule(spark, d):
    return manifest.full_mix_faults(fx.dirty(spark, d))


@query("duplicate_keys", "SELECT 'output_file' AS rule, output_file AS key, count(*) AS n FROM (SELECT trim(output_file) AS output_file FROM dirty) GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'kind_family', recording_id || ':' || kind || ':' || family, count(*) FROM dirty GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    m = manifest.normalize(fx.dirty(spark, d))
    one = manifest.duplicates(m, "output_file").select(F.lit("output_file").alias("rule"), F.col("output_file").alias("key"), "n")
    two = manifest.duplicates(m, "recording_id", "kind", "family")
    return one.unionAll(two.select(F.lit("kind_family").alias("rule"), F.concat_ws(":", "recording_id", "kind", "family").alias("key"), "n"))


@query("weighted_mse", "SELECT degradation_idx, round(sum(sse) / greatest(sum(n), 1.0), 6) AS mse FROM pairs GROUP BY degradation_idx")
def weighted_mse(spark, d):
    return evaluate.weighted_mse(fx.pairs(spark, d), "degradation_idx")


@query("per_item_mse", "SELECT round(avg(m), 6) AS mean, count(*) AS n_items FROM (SELECT window_idx, avg(sse) AS m FROM pairs GROUP BY window_idx)")
def per_item_mse(spark, d):
    return evaluate.two_level_mean(fx.pairs(spark, d), "window_idx", "sse")


@query("metric_means", "SELECT metric, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM (SELECT 'sse' AS metric, sse AS value FROM pairs UNION ALL SELECT 'n', n FROM pairs) GROUP BY metric")
def metric_means(spark, d):
    return evaluate.metric_means(fx.pairs(spark, d).select(F.expr("stack(2, 'sse', sse, 'n', n) AS (metric, value)")))


GOOD = "rat WHERE rater IN (SELECT rater FROM rat GROUP BY rater HAVING avg(rating) FILTER (condition = 'GROUND_TRUTH') >= 3.0)"


@query("listener_filter", f"SELECT event_id, rater, condition, rating FROM {GOOD}")
def listener_filter(spark, d):
    return evaluate.reliable_raters(fx.ratings(spark, d), "GROUND_TRUTH", 3.0).select("event_id", "rater", "condition", "rating")


def _summary_sql(condition: str, source: str) -> str:
    t = ", ".join(f"({k}, {v})" for k, v in evaluate.t_table())
    return (
        f"SELECT category, {condition}, ratings, participants, round(mean, 6) AS participant_mean, round(sd, 6) + 0.0 AS participant_mean_sd, round(mean - t * sd / sqrt(participants), 6) + 0.0 AS ci95_low, round(mean + t * sd / sqrt(participants), 6) + 0.0 AS ci95_high FROM "
        f"(SELECT category, {condition}, sum(k)::BIGINT AS ratings, count(*) AS participants, avg(m) AS mean, stddev_samp(m) AS sd FROM "
        f"(SELECT rater, coalesce(category, 'overall') AS category, {condition}, avg(rating) AS m, count(*) AS k FROM ({source}) GROUP BY GROUPING SETS ((rater, category, {condition}), (rater, {condition}))) GROUP BY ALL) s "
        f"LEFT JOIN (VALUES {t}) q(df, t) ON s.participants - 1 = q.df"
    )


@query("mos_summary", _summary_sql("condition", f"SELECT * FROM {GOOD}"))
def mos_summary(spark, d):
    return evaluate.opinion_summary(evaluate.reliable_raters(fx.ratings(spark, d), "GROUND_TRUTH", 3.0))


@query("preservation_summary", _summary_sql("candidate_condition", f"SELECT rater, category, rating, condition AS candidate_condition FROM {GOOD} AND condition NOT IN ('INPUT', 'GROUND_TRUTH')"))
def preservation_summary(spark, d):
    good = evaluate.reliable_raters(fx.ratings(spark, d), "GROUND_TRUTH", 3.0).where("condition NOT IN ('INPUT', 'GROUND_TRUTH')")
    return evaluate.opinion_summary(good.withColumnRenamed("condition", "candidate_condition"), "candidate_condition")


@query("clipping_audit", "SELECT user_id % 3 AS split_no, count(*) AS n, count_if(c > 0)::BIGINT AS files, sum(c)::BIGINT AS samples FROM (SELECT user_id, len(list_filter(x, lambda v: abs(v) > 1)) AS c FROM hot) GROUP BY 1")
def clipping_audit(spark, d):
    c = fx.pieces(spark, d, 100.0).groupBy("user_id").agg(F.sum(arrays.clipped_samples(F.col("x"))).alias("c")).withColumn("split_no", F.col("user_id") % 3)
    return c.groupBy("split_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") > 0).alias("files"), F.sum("c").alias("samples"))


@query("degradation_completeness", "SELECT window_idx, count(*) AS rows, min(degradation_idx) AS low, max(degradation_idx) AS high, count(DISTINCT degradation_idx) AS kinds FROM pairs GROUP BY window_idx HAVING count(*) <> 4 OR min(degradation_idx) <> 0 OR max(degradation_idx) <> 3 OR count(DISTINCT degradation_idx) <> 4")
def degradation_completeness(spark, d):
    return evaluate.completeness(fx.pairs(spark, d), 4)


@query("corpus_summary", "SELECT coalesce(category, 'overall') AS category, count(*) AS n, round(sum(seconds) / 3600, 6) AS hours FROM (SELECT lang AS category, n_chars / 10.0::DOUBLE AS seconds FROM documents) GROUP BY ROLLUP (category)")
def corpus_summary(spark, d):
    return evaluate.corpus_summary(fx.table(spark, d, "documents").select(F.col("lang").alias("category"), (F.col("n_chars") / 10.0).alias("seconds")))


@query(
    "throughput_summary",
    "SELECT run, count(*) AS n_steps, round(avg(secs), 6) AS mean_secs, round(24 * sum(workers) / sum(secs), 6) AS samples_per_sec, max(peak) AS peak, round(max(peak) / 100000.0::DOUBLE, 6) AS peak_fraction, any_value(disjoint) AS disjoint, round(max(secs) - min(secs), 6) + 0.0 AS spread FROM (SELECT run, step, max(secs) AS secs, max(peak) AS peak, count(DISTINCT worker) AS workers FROM steps WHERE step > 100 GROUP BY run, step) JOIN (SELECT run, bool_and(ok) AS disjoint FROM (SELECT run, step, count(DISTINCT worker) = 1 AS ok FROM steps GROUP BY run, step) GROUP BY run) USING (run) GROUP BY run",
)
def throughput_summary(spark, d):
    s = fx.steps(spark, d)
    return evaluate.throughput(s, 100, 24, 100000.0).join(evaluate.shards_disjoint(s.select("run", "worker", F.col("step").alias("sample"))), "run")


@query("cross_worker_reduce", "SELECT run, step, round(avg(secs), 6) AS mean, max(secs) AS max, round(sum(secs), 6) AS sum FROM steps GROUP BY run, step")
def cross_worker_reduce(spark, d):
    return evaluate.across_workers(fx.steps(spark, d))


@query("slowest_stage", "SELECT run, step, round(sum(secs), 6) AS total, (list(stage ORDER BY secs DESC, stage))[1] AS stage FROM (SELECT run, step, stage, round(sum(secs), 6) AS secs FROM steps GROUP BY ALL) GROUP BY run, step")
def slowest_stage(spark, d):
    return evaluate.slowest_stage(fx.steps(spark, d))


@query("balance_check", "SELECT category, count(DISTINCT item) AS n_items, count(DISTINCT condition) AS n_conditions, count(*) AS n FROM rat GROUP BY category")
def balance_check(spark, d):
    return fx.ratings(spark, d).groupBy("category").agg(F.countDistinct("item").alias("n_items"), F.countDistinct("condition").alias("n_conditions"), F.count(F.lit(1)).alias("n"))


MIX_KEY = "('0x' || substr(md5('42:' || song || ':' || stem), 1, 13))::UBIGINT::BIGINT"


@query(
    "mix_stems",
    f"SELECT song, n_stems, peak, round(peak_after, 6) AS peak_after FROM (SELECT song, count(DISTINCT stem) AS n_stems, round(max(abs(v)), 6) AS peak FROM (SELECT song, i, sum(v) AS v FROM (SELECT song, stem, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY song ORDER BY {MIX_KEY}) AS r FROM (SELECT user_id // 5 AS song, user_id AS stem, x FROM hot)) WHERE r <= 2 + song % 2) GROUP BY song, i) JOIN (SELECT song, stem FROM (SELECT song, stem, row_number() OVER (PARTITION BY song ORDER BY {MIX_KEY}) AS r FROM (SELECT user_id // 5 AS song, user_id AS stem FROM hot)) WHERE r <= 2 + song % 2) USING (song) GROUP BY song), LATERAL (SELECT least(peak, 1.0) AS peak_after)",
)
def mix_stems(spark, d):
    rows = fx.pieces(spark, d, 100.0).select(F.floor(F.col("user_id") / 5).alias("song"), F.col("user_id").alias("stem"), "piece", "x")
    order = F.row_number().over(Window.partitionBy("song").orderBy(rng.key(SEED, F.col("song"), F.col("stem"))))
    # Stems are chosen by name, before any sample moves; a song has a few.
    stems = fx.table(spark, d, "events").select(F.floor(F.col("user_id") / 5).alias("song"), F.col("user_id").alias("stem")).distinct()
    chosen = fx.saved(stems.withColumn("r", order).where(F.col("r") <= 2 + F.col("song") % 2).select("song", "stem"), "stems")
    count = chosen.groupBy("song").agg(F.count(F.lit(1)).alias("n_stems"))
    mixed = pieces.mixed(rows.join(chosen, ["song", "stem"]), "song")
    peak = mixed.groupBy("song").agg(F.max(arrays.peak(F.col("x"))).alias("peak"))
    after = mixed.join(peak, "song").select("song", "peak", F.when(F.col("peak") > 1, F.transform("x", lambda v: v / F.col("peak"))).otherwise(F.col("x")).alias("x"))
    out = after.groupBy("song", "peak").agg(F.max(arrays.peak(F.col("x"))).alias("peak_after"))
    return out.join(count, "song").select("song", "n_stems", F.round("peak", 6).alias("peak"), F.round("peak_after", 6).alias("peak_after"))


# E. Window functions


@query("source_index", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS source_idx FROM files")
def source_index(spark, d):
    return windows.dense_index(fx.files(spark, d), "name", "source_idx")


@query("group_index", "SELECT doc_id, dense_rank() OVER (ORDER BY recording_id) - 1 AS group_idx FROM rec")
def group_index(spark, d):
    return windows.dense_index(fx.recordings(spark, d), "recording_id", "group_idx").select("doc_id", "group_idx")


GLOBAL = "SELECT source_idx, local_idx, row_number() OVER (ORDER BY source_idx, local_idx) - 1 AS global_idx FROM win"


@query("global_window_index", GLOBAL)
def global_window_index(spark, d):
    return windows.global_index(sources(spark, d), SEGMENT, HOP).select("source_idx", "local_idx", "global_idx")


@query("contiguous_shard", f"SELECT global_idx, ((global_idx + 1) * 7 - 1) // (SELECT count(*) FROM win) AS shard FROM ({GLOBAL})")
def contiguous_shard(spark, d):
    rows = global_window_index(spark, d)
    n = sources(spark, d).agg(F.sum(windows.window_count(F.col("num_frames"), SEGMENT, HOP)).alias("total"))
    return rows.join(F.broadcast(n)).select("global_idx", windows.contiguous_shard(F.col("global_idx"), F.col("total"), 7).alias("shard"))


@query("strided_shard", f"SELECT global_idx, global_idx % 7 AS shard FROM ({GLOBAL})")
def strided_shard(spark, d):
    return global_window_index(spark, d).select("global_idx", windows.strided_shard(F.col("global_idx"), 7).alias("shard"))


@query("first_per_window", "SELECT window_idx, min(degradation_idx) AS degradation_idx FROM pairs GROUP BY window_idx ORDER BY window_idx LIMIT 1000")
def first_per_window(spark, d):
    """The number of previews is a feature: no more than asked for are shown."""
    return evaluate.first_per_window(fx.pairs(spark, d), 1000).select("window_idx", "degradation_idx")


@query("first_per_window_requested", "SELECT event_id AS pos, window_idx, degradation_idx FROM events JOIN (SELECT window_idx, min(degradation_idx) AS degradation_idx FROM pairs GROUP BY window_idx) ON window_idx = event_id * 7")
def first_per_window_requested(spark, d):
    ids = fx.table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7).alias("window_idx"))
    return evaluate.first_per_window(fx.pairs(spark, d), requested=ids).select("pos", "window_idx", "degradation_idx")


@query("running_best", "SELECT tag, step, loss FROM (SELECT *, min(loss) OVER (PARTITION BY tag ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM loss WHERE NOT isnan(loss)) WHERE b IS NULL OR loss < b")
def running_best(spark, d):
    return evaluate.running_best(fx.losses(spark, d)).select("tag", "step", "loss")


STEP = "regexp_extract(path, 'step_(\\d+)', 1)"


@query("keep_last_n", f"SELECT run, path, step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC, path) AS r FROM (SELECT run, path, nullif({STEP}, '')::BIGINT AS step FROM arts) WHERE step IS NOT NULL) WHERE r > 5")
def keep_last_n(spark, d):
    return evaluate.prunable(fx.artifacts(spark, d), 5)


@query("overlap_guard", f"SELECT source_idx, local_idx FROM split t WHERE split <> 'validate' AND EXISTS (SELECT 1 FROM split v WHERE v.split = 'validate' AND v.group_idx = t.group_idx AND v.local_idx BETWEEN t.local_idx - {RADIUS} AND t.local_idx + {RADIUS})")
def overlap_guard(spark, d):
    return split.guarded(all_split(spark, d), RADIUS).select("source_idx", "local_idx")


# F. Sorts and limits


@query("seeded_permutation", "SELECT source_idx, local_idx, h FROM win")
def seeded_permutation(spark, d):
    rows = all_windows(spark, d).select("source_idx", "local_idx")
    return split.seeded_order(rows, SEED, "source_idx", "local_idx")


@query("topk_margin", "SELECT category, item, margin FROM (SELECT category, item, round(avg(rating) FILTER (condition = 'MODEL') - avg(rating) FILTER (condition = 'RIVAL_A'), 6) + 0.0 AS margin FROM rat GROUP BY category, item) ORDER BY margin DESC, category, item LIMIT 3")
def topk_margin(spark, d):
    return condition_margin(spark, d).select("category", "item", "margin").orderBy(F.desc("margin"), "category", "item").limit(3)


@query("latest_artifact", f"SELECT run, coalesce(max(CASE WHEN path = 'latest.pt' THEN path END), arg_max(path, nullif({STEP}, '')::BIGINT)) AS path FROM arts GROUP BY run")
def latest_artifact(spark, d):
    return evaluate.latest_artifact(fx.artifacts(spark, d))


@query("run_inventory", "SELECT run, count_if(path <> 'latest.pt')::BIGINT AS n_artifacts, bool_or(has_config) AS has_config FROM arts GROUP BY run")
def run_inventory(spark, d):
    return evaluate.run_inventory(fx.artifacts(spark, d))


# G. Splitting


def _independent(name: str) -> str:
    return SQL["split_aligned_views"].replace("doc_id // 3 AS group_idx", "doc_id AS group_idx").replace("SELECT source_idx, local_idx, split FROM split", name)


@query("split_aligned_views", "SELECT source_idx, local_idx, split FROM split")
def split_aligned_views(spark, d):
    return all_split(spark, d).select("source_idx", "local_idx", "split")


@query("split_independent")
def split_independent(spark, d):
    rows = all_windows(spark, d).withColumn("group_idx", F.col("source_idx"))
    return split.split_windows(rows, "group_idx", RADIUS, TARGET).select("source_idx", "local_idx", "split")


SQL["split_independent"] = _independent("SELECT source_idx, local_idx, split FROM split")


def broken_split(spark: SparkSession, d: str) -> DataFrame:
    """A split with planted faults: training windows beside validation, rows in two splits, rows in none."""
    s = all_split(spark, d).select("source_idx", "group_idx", "local_idx", "start_sample", "split")
    i = F.col("local_idx")
    return s.withColumn("split", F.when(i % 97 == 5, "train").when(i % 101 == 11, "other").otherwise(F.col("split"))).unionAll(s.where(i % 89 == 3).withColumn("split", F.lit("discard")))


@query(
    "audit_split",
    "SELECT 'views_apart' AS rule, (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY group_idx, start_sample HAVING count_if(split = 'validate') BETWEEN 1 AND count(*) - 1)) AS bad UNION ALL SELECT 'in_two_splits', (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY source_idx, local_idx HAVING count(*) > 1)) UNION ALL "
    f"SELECT 'train_near_validate', (SELECT count(*) FROM broken t JOIN broken v ON t.group_idx = v.group_idx AND abs(t.local_idx - v.local_idx) <= {RADIUS} WHERE t.split = 'train' AND v.split = 'validate') UNION ALL SELECT 'without_split', (SELECT count(*) FROM broken WHERE split = 'other')",
)
def audit_split(spark, d):
    """Of a split with planted faults."""
    return split.problems(broken_split(spark, d), RADIUS)


# H. Array, math and string functions


@query("make_windows", "SELECT source_idx, local_idx, start_sample FROM win")
def make_windows(spark, d):
    return windows.make_windows(fx.recordings(spark, d), SEGMENT, HOP).select(F.col("doc_id").alias("source_idx"), "local_idx", "start_sample")


@query("resolve_hop", "SELECT hop, count(*) AS n FROM (SELECT unnest(range(0, (num_frames - 401) // hop + 1)) AS i, hop FROM rec, (VALUES (40), (20), (100)) t(hop) WHERE num_frames >= 401) GROUP BY hop")
def resolve_hop(spark, d):
    hops = [windows.resolve_hop(401), windows.resolve_hop(401, hop_seconds=20 / 44100), windows.resolve_hop(401, hop_fraction=0.25)]
    out = None
    for h in hops:
        one = windows.make_windows(fx.recordings(spark, d), 401, h).agg(F.count(F.lit(1)).alias("n")).select(F.lit(h).alias("hop"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("downmix", digest_sql("user_id", "list_transform(x, lambda v: (v + -v / 2) / 2)", "sig"))
def downmix(spark, d):
    s = fx.pieces(spark, d)
    return digest_pieces(pieces.each(s, arrays.downmix(F.col("x"), F.transform("x", lambda v: -v / 2))), "user_id")


PEAK = "list_max(list_transform(x, lambda v: abs(v)))"


@query("peak_normalize", digest_sql("user_id", f"CASE WHEN {PEAK} > 1 THEN list_transform(x, lambda v: v / {PEAK}) ELSE x END", "hot"))
def peak_normalize(spark, d):
    return digest_pieces(pieces.peak_normalize(fx.pieces(spark, d, 100.0), "user_id"), "user_id")


LOUD = "10 * log10(list_sum(list_transform(x, lambda v: v * v)) / len(x))"


@query("loudness_normalize", digest_sql("user_id", "CASE WHEN p > 1 THEN list_transform(y, lambda v: v / p) ELSE y END", f"(SELECT user_id, y, list_max(list_transform(y, lambda v: abs(v))) AS p FROM (SELECT user_id, list_transform(x, lambda v: v * pow(10, (-6.0 - loud) / 20)) AS y FROM (SELECT user_id, x, {LOUD} AS loud FROM sig)))"))
def loudness_normalize(spark, d):
    s = fx.pieces(spark, d)
    loud = pieces.peaks(s, "user_id").select("user_id", (10 * F.log10("mean_square")).alias("loudness"))
    return digest_pieces(pieces.loudness_normalize(s, "user_id", loud, -6.0), "user_id")


#: A signal of the tables has under a hundred samples: blocks of 16 of them, at 8,000 a second.
LOUD_RATE, LOUD_BLOCK = 8000.0, 0.002
_RESPONSE = "[" + ", ".join(repr(float(v)) for v in loudness.response(LOUD_RATE, 512)) + "]"
_ENERGY = "list_transform(range(0, (len(x) - 16) // 4 + 1), lambda b: list_sum(list_transform(y[(b * 4 + 1):(b * 4 + 16)], lambda v: v * v)) / 16)"


@query(
    "gated_loudness",
    f"SELECT user_id, round(-0.691 + 10 * log10(avg(e) FILTER (e > gate)), 6) + 0.0 AS loudness FROM (SELECT user_id, e, avg(e) FILTER (-0.691 + 10 * log10(e) > -70) OVER (PARTITION BY user_id) * 0.1 AS gate FROM (SELECT user_id, unnest({_ENERGY}) AS e FROM (SELECT user_id, x, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(range(0, i), lambda k: h[k + 1] * x[i - k]))) AS y FROM sig, (SELECT {_RESPONSE} AS h) WHERE len(x) >= 16)) WHERE e > 0) WHERE -0.691 + 10 * log10(e) > -70 GROUP BY user_id",
)
def gated_loudness(spark, d):
    chunk = loudness.stretch(LOUD_RATE, LOUD_BLOCK, 1024)[2]
    e = loudness.energies(fx.pieces(spark, d, halo=chunk), "user_id", LOUD_RATE, LOUD_BLOCK, span=1024)
    return loudness.gated_loudness(e, "user_id").select("user_id", F.round("loudness", 6).alias("loudness"))


@query("level_stats", f"SELECT user_id, round({LOUD}, 6) + 0.0 AS mean_db, round(20 * log10({PEAK}), 6) + 0.0 AS peak_db FROM sig")
def level_stats(spark, d):
    return pieces.peaks(fx.pieces(spark, d), "user_id").select("user_id", F.round(10 * F.log10("mean_square"), 6).alias("mean_db"), F.round(20 * F.log10("peak"), 6).alias("peak_db"))


@query("clamp_quantize_pcm16", "SELECT user_id, sum(round_even(greatest(-1.0, least(1.0, v)) * 32767, 0))::BIGINT AS total, min(round_even(greatest(-1.0, least(1.0, v)) * 32767, 0))::BIGINT AS low, max(round_even(greatest(-1.0, least(1.0, v)) * 32767, 0))::BIGINT AS high FROM (SELECT user_id, unnest(x) AS v FROM hot) GROUP BY user_id")
def clamp_quantize_pcm16(spark, d):
    s = fx.pieces(spark, d, 100.0).select("user_id", arrays.quantize_pcm16(F.col("x")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, v: a + v)
    return s.groupBy("user_id").agg(F.sum(total).alias("total"), F.min(F.array_min("v")).cast("long").alias("low"), F.max(F.array_max("v")).cast("long").alias("high"))


NORMAL = f"(SELECT vec_id, x, (SELECT list(mean ORDER BY channel) FROM ({STATS})) AS m, (SELECT list(std ORDER BY channel) FROM ({STATS})) AS s FROM lat)"


def _with_stats(spark, d):
    lat = fx.latents(spark, d)
    return lat.join(F.broadcast(evaluate.stats_arrays(evaluate.channel_stats(lat))))


@query("normalize_channels", digest_sql("vec_id", "list_transform(x, lambda v, i: (v - m[i]) / (s[i] + 1e-6))", NORMAL))
def normalize_channels(spark, d):
    return digest(_with_stats(spark, d).select("vec_id", arrays.normalize(F.col("x"), F.col("means"), F.col("stds")).alias("x")), "vec_id", "x")


@query("unnormalize_channels", digest_sql("vec_id", "x", "lat"))
def unnormalize_channels(spark, d):
    z = _with_stats(spark, d).withColumn("z", arrays.normalize(F.col("x"), F.col("means"), F.col("stds")))
    return digest(z.select("vec_id", arrays.unnormalize(F.col("z"), F.col("means"), F.col("stds")).alias("x")), "vec_id", "x")


@query("align_pair", "SELECT vec_id, least(len(a), 40 + vec_id % 30)::BIGINT AS n, round(list_sum(a[1:least(len(a), 40 + vec_id % 30)]), 6) + 0.0 AS left_total, round(list_sum(b[1:least(len(a), 40 + vec_id % 30)]), 6) + 0.0 AS right_total FROM lp")
def align_pair(spark, d):
    p = fx.latent_pairs(spark, d).withColumn("b", F.slice("b", 1, (40 + F.col("vec_id") % 30).cast("int")))
    a, b = arrays.align(F.col("a"), F.col("b"))
    return p.select("vec_id", F.size(a).cast("long").alias("n"), F.round(arrays.total(a), 6).alias("left_total"), F.round(arrays.total(b), 6).alias("right_total"))


@query("channel_first", "SELECT vec_id, 2::BIGINT AS channels, len(a) AS frames, round(list_sum(b), 6) + 0.0 AS second_total FROM lp")
def channel_first(spark, d):
    frames = F.zip_with("a", "b", lambda p, q: F.array(p, q))
    x = fx.latent_pairs(spark, d).select("vec_id", arrays.channel_first(frames, 2).alias("x"))
    return x.select("vec_id", F.size("x").cast("long").alias("channels"), F.size(F.get("x", F.lit(0))).cast("long").alias("frames"), F.round(arrays.total(F.get("x", F.lit(1))), 6).alias("second_total"))


def _key_sql(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(f"({p})" for p in parts) + "), 1, 13))::UBIGINT::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


def _gauss_sql(of, *parts: str) -> str:
    mean, std, low, high = of
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {mean} + {std} * sqrt(-2 * ln({_key_sql(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_key_sql(*parts, chr(39) + 'b' + chr(39))})))"


KEYS = ("'42'", "source_idx", "local_idx")


@query("clipped_gaussian", f"SELECT source_idx, local_idx, round({_gauss_sql((0.0, 6.0, -15.0, 15.0), *KEYS)}, 6) + 0.0 AS draw FROM win")
def clipped_gaussian(spark, d):
    return all_windows(spark, d).select("source_idx", "local_idx", F.round(rng.clipped_gaussian(0.0, 6.0, -15.0, 15.0, SEED, F.col("source_idx"), F.col("local_idx")), 6).alias("draw"))


def _draw_sql(what: str, of) -> str:
    return _gauss_sql(of, *KEYS, f"'{what}'")


@query(
    "degradation_params",
    "SELECT source_idx, local_idx, round(" + " + ".join(_draw_sql(f"eq1_{k}", augment.MODEL.eq1[k]) for k in range(10)) + f", 6) + 0.0 AS eq1_total, round({_draw_sql('drive', augment.MODEL.drive)}, 6) AS drive, round({_draw_sql('wet', augment.MODEL.wet)}, 6) + 0.0 AS wet, round(least({_draw_sql('low', augment.MODEL.low_cut)}, {_draw_sql('high', augment.MODEL.high_cut)}), 6) AS low_cut, round({_draw_sql('low_slope', augment.MODEL.low_slope)}, 6) AS low_slope, round({_draw_sql('snr', augment.MODEL.snr)}, 6) + 0.0 AS snr FROM win",
)
def degradation_params(spark, d):
    # A recording is many windows and a window 32 keys: as many tasks as the table has row groups would be too few.
    own = dealt(all_windows(spark, d).select("source_idx", "local_idx"), "source_idx", "local_idx", rows=COSTLY_ROWS)
    p = augment.degradation_params(own, SEED, "source_idx", "local_idx")
    return p.select("source_idx", "local_idx", F.round(arrays.total(F.col("eq1")), 6).alias("eq1_total"), *[F.round(c, 6).alias(c) for c in ("drive", "wet", "low_cut", "low_slope", "snr")])


@query("eq_curve", "SELECT vec_id, round(pow(10, CASE WHEN f <= log2(100) THEN g1 WHEN f <= log2(1000) THEN g1 + (g2 - g1) * (f - log2(100)) / (log2(1000) - log2(100)) ELSE g2 END / 20), 6) AS gain FROM (SELECT vec_id, log2(greatest(vec_id * 7.5, 1.0)) AS f, x[1] * 10 AS g1, x[2] * 10 AS g2 FROM lat)")
def eq_curve(spark, d):
    gains = [F.get("x", F.lit(0)) * 10, F.get("x", F.lit(1)) * 10]
    return fx.latents(spark, d).select("vec_id", F.round(arrays.eq_gain(F.col("vec_id") * 7.5, [100.0, 1000.0], gains), 6).alias("gain"))


@query("bandpass_curve", "SELECT vec_id, round(pow(10, greatest(-80, least(0, CASE WHEN f < 300 THEN -12 * log2(300 / f) WHEN f > 3000 THEN -18 * log2(f / 3000) ELSE 0 END)) / 20), 6) AS gain FROM (SELECT vec_id, greatest(vec_id * 7.5, 0.5)::DOUBLE AS f FROM lat)")
def bandpass_curve(spark, d):
    g = arrays.bandpass_gain(F.col("vec_id") * 7.5, F.lit(300.0), F.lit(3000.0), F.lit(12.0), F.lit(18.0))
    return fx.latents(spark, d).select("vec_id", F.round(g, 6).alias("gain"))


@query("soft_saturate", digest_sql("user_id", "list_transform(x, lambda v: 0.4 * v + 0.6 * tanh(3 * v) / 3)", "hot"))
def soft_saturate(spark, d):
    return digest_pieces(pieces.each(fx.pieces(spark, d, 100.0), arrays.soft_saturate(F.col("x"), 0.6, 3.0)), "user_id")


MIX = "(SELECT user_id, x, n[(1 + user_id % (len(n) - len(x) + 1)):(len(x) + user_id % (len(n) - len(x) + 1))] AS p FROM (SELECT user_id, x, CASE WHEN len(samples) < len(x) THEN flatten(list_transform(range(len(x) // len(samples) + 1), lambda i: samples)) ELSE samples END AS n FROM sig JOIN noise ON noise_idx = user_id % (SELECT count(*) FROM noise)))"
MEAN_SQUARE = "greatest(list_sum(list_transform({0}, lambda v: v * v)) / len({0}), 1e-10)"


@query("mix_at_snr", digest_sql("user_id", "list_transform(x, lambda v, i: v + g * p[i])", f"(SELECT user_id, x, p, sqrt({MEAN_SQUARE.format('x')} / pow(10, 12.0 / 10) / {MEAN_SQUARE.format('p')}) AS g FROM {MIX})"))
def mix_at_snr(spark, d):
    n = fx.noise(spark, d)
    s = fx.pieces(spark, d)
    users = fx.table(spark, d, "events").select("user_id").distinct()
    clip = users.join(F.broadcast(n.agg(F.count(F.lit(1)).alias("k")))).withColumn("noise_idx", F.col("user_id") % F.col("k")).join(n, "noise_idx").select("user_id", "samples")
    return digest_pieces(pieces.mix_at_snr(s, "user_id", clip, F.col("user_id"), 12.0), "user_id")


@query("artifact_name", "SELECT window_idx, degradation_idx, format('window_{:06d}_degradation_{:02d}.pt', window_idx, degradation_idx) AS name FROM pairs")
def artifact_name(spark, d):
    return fx.pairs(spark, d).select("window_idx", "degradation_idx", audio.pair_name().alias("name"))


@query("mse", "SELECT vec_id, round(list_sum(list_transform(a, lambda v, i: (v - b[i]) * (v - b[i]))) / len(a), 6) AS mse FROM lp")
def mse(spark, d):
    return fx.latent_pairs(spark, d).select("vec_id", F.round(arrays.mse(F.col("a"), F.col("b")), 6).alias("mse"))


@query("hann_weights", "SELECT user_id, round(list_sum(list_transform(x, lambda v, i: v * 0.5 * (1 - cos(2 * pi() * ((i - 1) % 16) / 16)))), 6) + 0.0 AS faded FROM sig")
def hann_weights(spark, d):
    """Every 16 samples of a signal under one window."""
    x = F.transform("x", lambda v, i: v * F.get(arrays.hann(16), i % 16))
    return fx.pieces(spark, d).groupBy("user_id").agg(F.round(F.sum(arrays.total(x)), 6).alias("faded"))


# I. Set operations


@query(
    "split_partition_check",
    "SELECT 'not_covered_or_unknown' AS \"check\", (SELECT sum(abs(n - 1))::BIGINT FROM (SELECT count(*) FILTER (split <> 'other') AS n FROM broken GROUP BY source_idx, local_idx)) AS n UNION ALL "
    + " UNION ALL ".join(f"SELECT '{x}_and_{y}', (SELECT count(*) FROM (SELECT source_idx, local_idx FROM broken WHERE split = '{x}' INTERSECT SELECT source_idx, local_idx FROM broken WHERE split = '{y}'))" for x, y in (("train", "validate"), ("train", "discard"), ("validate", "discard"))),
)
def split_partition_check(spark, d):
    """Of a split with planted faults."""
    return split.partition_check(broken_split(spark, d), all_windows(spark, d), "source_idx", "local_idx")


@query("inventory_set_equality", "(SELECT output_file AS name, 'left' AS side FROM rec EXCEPT SELECT name, 'left' FROM files) UNION ALL (SELECT name, 'right' FROM files EXCEPT SELECT output_file, 'right' FROM rec)")
def inventory_set_equality(spark, d):
    return split.difference(fx.recordings(spark, d).select(F.col("output_file").alias("name")), fx.files(spark, d).select("name"))


@query("merge_worker_previews", "SELECT window_idx, min(degradation_idx) AS degradation_idx FROM pairs WHERE degradation_idx IN (1, 2, 4) GROUP BY window_idx")
def merge_worker_previews(spark, d):
    p = fx.pairs(spark, d)
    return evaluate.first_per_window(p.where("degradation_idx = 1").unionByName(p.where("degradation_idx = 2")).unionByName(p.where("degradation_idx = 4"))).select("window_idx", "degradation_idx")


# J. Jobs over arrays


CHUNK, OVERLAP = 16, 8


@query("chunk_signals", "SELECT user_id, k::INTEGER AS chunk_idx, round(list_sum(x[(k * 8 + 1):(k * 8 + 16)]), 6) + 0.0 AS total FROM (SELECT user_id, x, unnest(range(0, greatest(ceil((len(x) - 16) / 8.0), 0)::BIGINT + 1)) AS k FROM sig)")
def chunk_signals(spark, d):
    size, overlap = chunks.chunk_sizes(14, 9, 4)
    return chunks.chunk_pieces(fx.pieces(spark, d, halo=size), size, overlap, "user_id").select("user_id", "chunk_idx", F.round(arrays.total(F.col("x")), 6).alias("total"))


def _samples(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("user_id", "start", F.posexplode("x").alias("i", "v"))
    return rows.select("user_id", (F.col("start") + F.col("i")).cast("int").alias("pos"), F.round("v", 6).alias("v"))


@query("overlap_add", "SELECT user_id, (i - 1)::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM (SELECT user_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM sig)")
def overlap_add(spark, d):
    """Chunks of unchanged signals give the signals back."""
    c = chunks.chunk_pieces(fx.pieces(spark, d, halo=CHUNK), CHUNK, OVERLAP, "user_id")
    return _samples(chunks.overlap_add_blocks(c, CHUNK, OVERLAP, "user_id"))


@query("batch_restore", "SELECT user_id, (i - 1)::INTEGER AS pos, round(v * 0.5, 6) + 0.0 AS v FROM (SELECT user_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM sig)")
def batch_restore(spark, d):
    return _samples(chunks.restore_pieces(fx.pieces(spark, d, halo=CHUNK), lambda x: x * 0.5, CHUNK, OVERLAP, "user_id"))


#: Pieces of signals stand for windows: their length is bounded.
IDS = ("user_id", "piece")


GAINS = [3.0, 0.0, 0.0, -3.0, 0.0, 0.0, 6.0, 0.0, 0.0, -6.0]


def _gain_sql(f: str) -> str:
    """Amplitude factor of the equaliser at a frequency."""
    at = [f"log2({n})" for n in augment.NODES]
    steps = "".join(f" WHEN g <= {at[k + 1]} THEN {GAINS[k]} + {GAINS[k + 1] - GAINS[k]} * (g - {at[k]}) / ({at[k + 1]} - {at[k]})" for k in range(len(at) - 1))
    return f"(SELECT pow(10, CASE WHEN g <= {at[0]} THEN {GAINS[0]}{steps} ELSE {GAINS[-1]} END / 20) FROM (SELECT log2(greatest({f}, 1.0)) AS g))"


@query(
    "apply_frequency_response",
    digest_sql("user_id", "y", "(SELECT user_id, list(v ORDER BY i) AS y FROM (SELECT user_id, i, sum(CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END * gain * (re * cos(2 * pi() * k * i / n) - im * sin(2 * pi() * k * i / n))) / any_value(n) AS v FROM (SELECT user_id, n, k, "
    + _gain_sql("k * 44100.0::DOUBLE / n")
    + " AS gain, list_sum(list_transform(x, lambda v, j: v * cos(2 * pi() * k * (j - 1) / n))) AS re, -list_sum(list_transform(x, lambda v, j: v * sin(2 * pi() * k * (j - 1) / n))) AS im, unnest(range(0, n)) AS i FROM (SELECT user_id, x, len(x) AS n, unnest(range(0, len(x) // 2 + 1)) AS k FROM sig)) GROUP BY user_id, i) GROUP BY user_id)"),
)
def apply_frequency_response(spark, d):
    x = augment.frequency_response(fx.pieces(spark, d), GAINS, 44100.0, *IDS)
    return digest_pieces(x.withColumn("begin", F.col("piece") * pieces.SIZE), "user_id")


AUG_KEY = ("'42'", "user_id", "0", "degradation_idx")


def _interpolated(g: str, prefix: str) -> str:
    """Gains (columns prefix0, prefix1, ...) over log2 frequency, flat outside the nodes."""
    at = [f"log2({n})" for n in augment.NODES]
    steps = "".join(f" WHEN {g} <= {at[k + 1]} THEN {prefix}{k} + ({prefix}{k + 1} - {prefix}{k}) * ({g} - {at[k]}) / ({at[k + 1]} - {at[k]})" for k in range(len(at) - 1))
    return f"CASE WHEN {g} <= {at[0]} THEN {prefix}0{steps} ELSE {prefix}{len(at) - 1} END"


def _filtered(source: str, x: str, out: str, db: str) -> str:
    """source with the array x through a filter (dB at bins k of frequency f) as the array out."""
    wave = "list_sum(list_transform({x}, lambda v, j: v * {f}(2 * pi() * k * (j - 1) / n)))"
    bins = f"SELECT *, {wave.format(x=x, f='cos')} AS re, -{wave.format(x=x, f='sin')} AS im, pow(10, {db} / 20) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS gain FROM (SELECT *, k * 44100.0::DOUBLE / n AS f, log2(greatest(k * 44100.0::DOUBLE / n, 1.0)) AS g FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM {source}))"
    sums = f"SELECT user_id, degradation_idx, i, sum(gain * (re * cos(2 * pi() * k * i / n) - im * sin(2 * pi() * k * i / n))) / any_value(n) AS v FROM (SELECT *, unnest(range(0, n)) AS i FROM ({bins})) GROUP BY user_id, degradation_idx, i"
    return f"(SELECT s.*, {out} FROM {source} s JOIN (SELECT user_id, degradation_idx, list(v ORDER BY i) AS {out} FROM ({sums}) GROUP BY user_id, degradation_idx) USING (user_id, degradation_idx))"


def _augmented_sql() -> str:
    """Definitions up to chain: user_id, degradation_idx and the signal after each stage, one to five."""
    m, draw = augment.MODEL, lambda what, of: _gauss_sql(of, *AUG_KEY, f"'{what}'")
    params = [f"{draw(f'{e}_{k}', of)} AS {e}_{k}" for e in ("eq1", "eq2") for k, of in enumerate(getattr(m, e))]
    params += [f"{draw(w, getattr(m, w))} AS {w}" for w in ("drive", "wet", "low_slope", "high_slope", "snr")]
    params += [f"{kind}({draw('low', m.low_cut)}, {draw('high', m.high_cut)}) AS {name}" for kind, name in (("least", "low_cut"), ("greatest", "high_cut"))]
    band = "greatest(-80.0, least(0.0, CASE WHEN greatest(f, 0.5) < low_cut THEN -low_slope * log2(low_cut / greatest(f, 0.5)) WHEN greatest(f, 0.5) > high_cut THEN -high_slope * log2(greatest(f, 0.5) / high_cut) ELSE 0 END))"
    second = _interpolated("g", "eq2_")
    key = lambda what: "('0x' || substr(md5(" + " || ':' || ".join(f"({p})" for p in (*AUG_KEY, f"'{what}'")) + "), 1, 13))::UBIGINT::BIGINT"
    steps = {
        "par": f"SELECT *, {', '.join(params)} FROM (SELECT user_id, x, len(x) AS n, unnest(range(0, 3)) AS degradation_idx FROM sig)",
        "st1": "SELECT * FROM " + _filtered("par", "x", "one", _interpolated("g", "eq1_")),
        "st2": "SELECT *, list_transform(one, lambda v: (1 - wet) * v + wet * tanh(drive * v) / drive) AS two FROM st1",
        "st3": "SELECT * FROM " + _filtered("st2", "two", "three", second),
        "st4": "SELECT * FROM " + _filtered("st3", "two", "four", f"({second} + {band})"),
        "st5": f"SELECT a.*, tape[(pick % (len(tape) - n + 1) + 1):(pick % (len(tape) - n + 1) + n)] AS part FROM (SELECT a.*, CASE WHEN len(samples) < n THEN flatten(list_transform(range(n // len(samples) + 1), lambda i: samples)) ELSE samples END AS tape FROM (SELECT *, {key('start')} AS pick, {key('noise')} % (SELECT count(*) FROM noise) AS noise_idx FROM st4) a JOIN noise USING (noise_idx)) a",
        "chain": f"SELECT *, list_transform(four, lambda v, i: v + amount * part[i]) AS five FROM (SELECT *, sqrt({MEAN_SQUARE.format('four')} / pow(10, snr / 10) / {MEAN_SQUARE.format('part')}) AS amount FROM st5)",
    }
    fx.SQL.update(steps)
    return ", ".join(steps)


_augmented_sql()


def _totals(df: DataFrame, *by: str) -> DataFrame:
    moment = F.aggregate(F.transform("x", lambda a, i: a * (i + 1)), F.lit(0.0), lambda s, a: s + a)
    return df.select(*by, F.size("x").cast("long").alias("n"), F.round(arrays.total(F.col("x")), 5).alias("total"), F.round(moment, 4).alias("moment"))


def _totals_sql(y: str) -> str:
    return f"len({y}) AS n, round(list_sum({y}), 5) + 0.0 AS total, round(list_sum(list_transform({y}, lambda v, i: v * i)), 4) + 0.0 AS moment"


@query("augment_windows", f"SELECT user_id, degradation_idx::INTEGER AS degradation_idx, {_totals_sql('five')} FROM chain")
def augment_windows(spark, d):
    return _totals(augment.augment(fx.pieces(spark, d), fx.noise(spark, d), 3, SEED, 44100.0, *IDS), "user_id", "degradation_idx")


@query("augment_stages", " UNION ALL ".join(f"SELECT user_id, {k + 1} AS stage, {_totals_sql(name)} FROM chain WHERE degradation_idx = 0" for k, name in enumerate(("one", "two", "three", "four", "five"))))
def augment_stages(spark, d):
    return _totals(augment.augment(fx.pieces(spark, d), fx.noise(spark, d), 1, SEED, 44100.0, *IDS, stages=True), "user_id", "stage")


def _spectra(spark, d):
    return augment.stft_features(fx.pieces(spark, d), *IDS, n_fft=32, hop=8, win=32)


def _cells(df: DataFrame, *of: str) -> DataFrame:
    """user_id, frame, bin and the values of arrays of bins x frames."""
    bins = F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in of])).alias("bin", "_r")
    rows = df.select("user_id", bins)
    frames = F.posexplode(F.arrays_zip(*[F.col(f"_r.{c}").alias(c) for c in of])).alias("frame", "_v")
    return rows.select("user_id", "bin", frames).select("user_id", "frame", "bin", *[F.round(f"_v.{c}", 6).alias(c) for c in of])


@query("stft_features", "SELECT user_id, frame, bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spec")
def stft_features(spark, d):
    return _cells(_spectra(spark, d), "re", "im")


@query("istft_signal", "SELECT user_id, (i - 1)::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM (SELECT user_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM sig)")
def istft_signal(spark, d):
    """Spectra of the signals give the signals back."""
    x = augment.istft_signals(_spectra(spark, d), *IDS, n_fft=32, hop=8, win=32)
    return _samples(x.withColumn("start", F.col("piece") * pieces.SIZE))


@query("log_spectrogram", "SELECT user_id, frame, bin, round(CASE WHEN high > low THEN (m - low) / (high - low) ELSE 0 END, 6) + 0.0 AS spectrogram FROM (SELECT *, min(m) OVER (PARTITION BY user_id) AS low, max(m) OVER (PARTITION BY user_id) AS high FROM (SELECT user_id, frame, bin, ln(1 + sqrt(re * re + im * im)) AS m FROM spec))")
def log_spectrogram(spark, d):
    return _cells(augment.log_spectrogram(_spectra(spark, d), *IDS), "spectrogram")


@query("stft_channel_stats", "SELECT part, bin, round(avg(v), 6) + 0.0 AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)), 6) AS std FROM (SELECT 're' AS part, bin, re AS v FROM spec UNION ALL SELECT 'im', bin, im FROM spec) GROUP BY part, bin")
def stft_channel_stats(spark, d):
    return augment.stft_stats(_spectra(spark, d)).select("part", "bin", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _metric_rows(spark, d):
    """Signals against a softly saturated version of themselves."""
    s = fx.pieces(spark, d)
    return augment.spectral_metrics(s.select(*IDS, arrays.soft_saturate(F.col("x"), 0.6, 3.0).alias("a"), F.col("x").alias("b")), 44100.0, *IDS)


@query("pair_spectral_metrics")
def pair_spectral_metrics(spark, d):
    return evaluate.metric_means(_metric_rows(spark, d).select("metric", "value"))


@query("score_fn", "SELECT user_id, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS score FROM sig")
def score_fn(spark, d):
    scored = augment.score_items(fx.pieces(spark, d), lambda x: abs(x).max(), *IDS)
    return scored.groupBy("user_id").agg(F.round(F.max("score"), 6).alias("score"))


@query("augment_fn", "SELECT user_id, degradation_idx::INTEGER AS degradation_idx, " + _totals_sql("y") + " FROM (SELECT user_id, degradation_idx, list_transform(x, lambda v: v * wet) AS y FROM par WHERE degradation_idx < 2)")
def augment_fn(spark, d):
    """A user's function in place of the built-in chain."""
    made = augment.augment(fx.pieces(spark, d), fx.noise(spark, d), 2, SEED, 44100.0, *IDS, augment_fn=lambda x, p, noise, pick, rate: [x * p["wet"]])
    return _totals(made, "user_id", "degradation_idx")


@query("encode_pairs", "SELECT vec_id, k::INTEGER AS degradation_idx, n, round(list_sum(list_transform(x[1:n], lambda v: (v - 0.1) / (0.5 + 1e-6))), 6) + 0.0 AS clean_total, round(list_sum(list_transform(x[1:n], lambda v: (v * (0.5 + 0.25 * k) - 0.1) / (0.5 + 1e-6))), 6) + 0.0 AS cond_total FROM (SELECT vec_id, x, 40 + vec_id % 20 AS n FROM lat), range(0, 2) t(k)")
def encode_pairs(spark, d):
    """Of each vector and two variants, of which one is shorter: all are cropped to its length."""
    rows = fx.latents(spark, d)
    one = rows.select("vec_id", F.lit(0).alias("degradation_idx"), F.transform("x", lambda v: v * 0.5).alias("x"))
    two = rows.select("vec_id", F.lit(1).alias("degradation_idx"), F.slice(F.transform("x", lambda v: v * 0.75), 1, (40 + F.col("vec_id") % 20).cast("int")).alias("x"))
    z = dataset.encode_pairs(rows, one.unionAll(two), "samples", [0.1], [0.5], "vec_id")
    first = lambda c: F.get(c, F.lit(0))
    return z.select("vec_id", "degradation_idx", F.size(first("z_cond")).cast("long").alias("n"), F.round(arrays.total(first("z_clean")), 6).alias("clean_total"), F.round(arrays.total(first("z_cond")), 6).alias("cond_total"))


@query("encoder_fn", "SELECT 0 AS channel, round(avg(v), 6) + 0.0 AS mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)), 6) AS std FROM (SELECT unnest(x) AS v FROM sig)")
def encoder_fn(spark, d):
    """A user's function as encoder."""
    return dataset.latent_stats(fx.pieces(spark, d), lambda x: x[None, :]).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("encoder_roundtrip", "SELECT user_id, (i - 1)::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM (SELECT user_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM sig)")
def encoder_roundtrip(spark, d):
    """Chunks through a codec and back, added up: the signals again."""
    made = dataset.codec("cosines").check(CHUNK)
    return _samples(chunks.restore_pieces(fx.pieces(spark, d, halo=CHUNK), dataset.round_trip(made), CHUNK, OVERLAP, "user_id"))


@query(
    "validate_dataset",
    "SELECT 'incomplete' AS rule, (SELECT count(*) FROM (SELECT 1 FROM pairs GROUP BY window_idx HAVING count(*) <> 4 OR min(degradation_idx) <> 0 OR max(degradation_idx) <> 3 OR count(DISTINCT degradation_idx) <> 4)) AS bad UNION ALL SELECT 'unexpected', (SELECT count(*) FROM pairs WHERE window_idx NOT IN (SELECT event_id FROM events)) UNION ALL SELECT 'missing', (SELECT count(*) FROM events WHERE event_id NOT IN (SELECT window_idx FROM pairs)) UNION ALL SELECT 'not_finite', (SELECT count(*) FROM pairs WHERE window_idx % 97 = 4)",
)
def validate_dataset(spark, d):
    """Of pairs with planted faults of every kind."""
    p = fx.pairs(spark, d)
    z = F.array(F.array(F.when(F.col("window_idx") % 97 == 4, float("nan")).otherwise(F.col("sse"))))
    return dataset.validate(p.select(F.col("window_idx").alias("global_idx"), "degradation_idx", z.alias("z_cond")), fx.table(spark, d, "events").select(F.col("event_id").alias("global_idx")), 4)


from . import files  # noqa: E402,F401  adds the queries of sources and sinks
