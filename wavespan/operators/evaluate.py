"""Evaluation: error metrics, listening tests, run logs and artifacts."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mse(df: DataFrame, *by: str) -> DataFrame:
    """Sum of squared errors over the number of samples, not a mean of means."""
    return df.groupBy(*by).agg(F.round(F.sum("sse") / F.greatest(F.sum("n"), F.lit(1.0)), 6).alias("mse"))


def two_level_mean(df: DataFrame, item: str, value: str) -> DataFrame:
    """Mean within items, then of items with equal weight."""
    return df.groupBy(item).agg(F.avg(value).alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.lit(1)).alias("n_items"))


def metric_means(df: DataFrame) -> DataFrame:
    """metric, mean, n from rows (metric, value)."""
    return df.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def first_per_window(pairs: DataFrame, most: int | None = None, requested: DataFrame | None = None) -> DataFrame:
    """Row of the least degradation of each window; the first `most` windows by id, or of `requested` (pos, window_idx) by position."""
    w = Window.partitionBy("window_idx").orderBy("degradation_idx")
    one = pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if requested is not None:
        one = one.join(requested.select("pos", "window_idx"), "window_idx").orderBy("pos")
    elif most is not None:
        one = one.orderBy("window_idx")
    return one if most is None else one.limit(most)


def condition_margin(ratings: DataFrame, ours: str, rival: str, base: str) -> DataFrame:
    """item, category, improvement over the input and margin over a rival."""
    wide = ratings.groupBy("category", "item").pivot("condition", [ours, rival, base]).agg(F.avg("rating"))
    return wide.select("category", "item", F.round(F.col(ours) - F.col(base), 6).alias("improvement"), F.round(F.col(ours) - F.col(rival), 6).alias("margin"))


def reliable_raters(ratings: DataFrame, truth: str, least: float, base: str | None = None, most: float | None = None) -> DataFrame:
    """Ratings of raters whose mean on the ground truth is high enough (and, if asked, on the input low enough)."""
    keep = F.avg(F.when(F.col("condition") == truth, F.col("rating"))) >= least
    if base is not None:
        keep = keep & (F.avg(F.when(F.col("condition") == base, F.col("rating"))) < most)
    good = ratings.groupBy("rater").agg(keep.alias("ok")).where("ok").select("rater")
    return ratings.join(good, "rater", "left_semi")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_quantile(df: int, upper: float = 0.025) -> float:
    """Student-t value with so much probability above it."""

    def above(t: float) -> float:
        a, b, x = df / 2, 0.5, df / (df + t * t)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
        part = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
        return part / 2

    low, high = 0.0, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > upper else (low, mid)
    return (low + high) / 2


def t_expansion(df: Column) -> Column:
    """Two-sided 95 % value for many degrees of freedom: the expansion in 1 / df, right to 1e-9 from 200 on."""
    z = 1.959963984540054
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum((F.lit(t) / F.pow(df, F.lit(k)) for k, t in enumerate(terms[1:], 1)), F.lit(terms[0]))


@lru_cache(maxsize=1)
def t_table(n: int = 200) -> tuple[tuple[int, float], ...]:
    """Two-sided 95 % values for 1 .. n degrees of freedom."""
    return tuple((k, round(t_quantile(k), 9)) for k in range(1, n + 1))


def opinion_summary(ratings: DataFrame, condition: str = "condition") -> DataFrame:
    """By category and overall: ratings, participants, mean and sample sd of participants' means, 95 % interval."""
    spark = ratings.sparkSession
    one = ratings.groupBy("rater", "category", condition).agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("k"))
    whole = ratings.groupBy("rater", condition).agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("k")).withColumn("category", F.lit("overall"))
    both = one.unionByName(whole).groupBy("category", condition).agg(F.sum("k").alias("ratings"), F.count(F.lit(1)).alias("participants"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    table = t_table()
    t = spark.createDataFrame(table, "df int, t double")
    df = F.col("participants") - 1
    half = F.when(df > len(table), t_expansion(df.cast("double"))).otherwise(F.col("t")) * F.col("sd") / F.sqrt("participants")
    return both.join(F.broadcast(t), df == F.col("df"), "left").select(
        "category", condition, "ratings", "participants", F.round("mean", 6).alias("participant_mean"), F.round("sd", 6).alias("participant_mean_sd"),
        F.round(F.col("mean") - half, 6).alias("ci95_low"), F.round(F.col("mean") + half, 6).alias("ci95_high"),
    )


def corpus_summary(df: DataFrame) -> DataFrame:
    """Recordings and hours by category and overall."""
    return df.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds") / 3600, 6).alias("hours")).select(F.coalesce("category", F.lit("overall")).alias("category"), "n", "hours")


def running_best(losses: DataFrame) -> DataFrame:
    """Steps with a new least loss of their tag; NaN never counts."""
    before = F.min("loss").over(Window.partitionBy("tag").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return losses.where(~F.isnan("loss")).withColumn("_b", before).where("_b IS NULL OR loss < _b").drop("_b")


def due_steps(steps: DataFrame, validate_every: int, audio_every: int) -> DataFrame:
    """step, validation, audio: what is due at a step."""
    s = F.col("step")
    return steps.select("step", ((s == 1) | (s % validate_every == 0)).alias("validation"), ((s > 1) & (s % audio_every == 0)).alias("audio")).where("validation OR audio")


def throughput(steps: DataFrame, warm_up: int, batch: int, memory: float) -> DataFrame:
    """By run, after the warm-up: mean step time of the slowest worker, samples a second, peak and its fraction of the memory, spread of step times."""
    one = steps.where(F.col("step") > warm_up).groupBy("run", "step").agg(F.max("secs").alias("secs"), F.max("peak").alias("peak"), F.countDistinct("worker").alias("workers"))
    return one.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("secs"), 6).alias("mean_secs"), F.round(batch * F.sum("workers") / F.sum("secs"), 6).alias("samples_per_sec"),
        F.max("peak").alias("peak"), F.round(F.max("peak") / memory, 6).alias("peak_fraction"), F.round(F.max("secs") - F.min("secs"), 6).alias("spread"),
    )


def shards_disjoint(samples: DataFrame) -> DataFrame:
    """run, disjoint: whether no sample of a run was seen by two workers. samples: run, worker, sample."""
    one = samples.groupBy("run", "sample").agg((F.min("worker") == F.max("worker")).alias("ok"))
    return one.groupBy("run").agg(F.bool_and("ok").alias("disjoint"))


def across_workers(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run", "step").agg(F.round(F.avg("secs"), 6).alias("mean"), F.max("secs").alias("max"), F.round(F.sum("secs"), 6).alias("sum"))


def slowest_stage(steps: DataFrame) -> DataFrame:
    """Total time of each step and its slowest stage (the first by name in a tie)."""
    one = steps.groupBy("run", "step", "stage").agg(F.round(F.sum("secs"), 6).alias("secs"))
    worst = F.min_by("stage", F.struct(-F.col("secs"), "stage"))
    return one.groupBy("run", "step").agg(F.round(F.sum("secs"), 6).alias("total"), worst.alias("stage"))


def step_number(path: str | Column) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({path}, 'step_(\\\\d+)', 1), '') AS BIGINT)")


def prunable(artifacts: DataFrame, keep: int) -> DataFrame:
    """Artifacts of each run beyond the newest ones by step."""
    w = Window.partitionBy("run").orderBy(F.desc("step"), "path")
    return artifacts.withColumn("step", step_number("path")).where("step IS NOT NULL").withColumn("_r", F.row_number().over(w)).where(F.col("_r") > keep).select("run", "path", "step")


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    """The pointer to the latest where a run has it, else its highest step."""
    pointer = F.max(F.when(F.col("path") == "latest.pt", F.col("path")))
    return artifacts.withColumn("step", step_number("path")).groupBy("run").agg(F.coalesce(pointer, F.max_by("path", "step")).alias("path"))


def run_inventory(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("run").agg(F.count_if(F.col("path") != "latest.pt").alias("n_artifacts"), F.max("has_config").alias("has_config")).orderBy("run")


def order_by_request(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows in the order of a request (pos, key); a key that df lacks has found = false."""
    return ids.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("pos")


def completeness(pairs: DataFrame, n: int) -> DataFrame:
    """Windows that don't have degradations 0 .. n - 1 once each."""
    g = pairs.groupBy("window_idx").agg(F.count(F.lit(1)).alias("rows"), F.min("degradation_idx").alias("low"), F.max("degradation_idx").alias("high"), F.countDistinct("degradation_idx").alias("kinds"))
    return g.where((F.col("rows") != n) | (F.col("low") != 0) | (F.col("high") != n - 1) | (F.col("kinds") != n))


def channel_stats(df: DataFrame, value: str = "x") -> DataFrame:
    """channel, mean, std (population, floored) over all rows of an array column; sums combine before the shuffle."""
    x = df.select(F.posexplode(value).alias("channel", "v")).groupBy("channel").agg(F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"))
    return x.select("channel", F.round("m", 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-12))), 6).alias("std"))


def stats_arrays(stats: DataFrame) -> DataFrame:
    """One row with the means and deviations in channel order; its size is the number of channels."""
    z = F.array_sort(F.collect_list(F.struct("channel", "mean", "std")))
    return stats.agg(z.alias("z")).select(F.transform("z", lambda r: r["mean"]).alias("means"), F.transform("z", lambda r: r["std"]).alias("stds"))
