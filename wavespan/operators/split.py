"""Leak-free split of overlapping windows into train, validate and discard.

A window has a keyed rank h. It is promoted at p, the least h among all views at its position, and it leaves
training at b, the least p within the overlap radius. For a threshold x: p <= x validates, b > x trains, the rest is
discarded. The smallest x that gives the wanted share of validation is found from a histogram of the ranks' high
bits and an exact search in one bin, never by a window over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..shared import dealt, saved, tasks

#: Bits of a rank below the histogram's 65,536 bins.
LOW_BITS = 36
#: Rows of a span of positions that is worked on together when a group is long.
SPAN = 4096


def ranked(windows: DataFrame, seed: int, *ids: str) -> DataFrame:
    """windows with h, a rank by key of the seed and the named columns."""
    return windows.withColumn("h", rng.key(seed, *[F.col(c) for c in ids]))


def promotion(windows: DataFrame, group: str, radius: int, h: str = "h") -> DataFrame:
    """windows (group, local_idx, h) with p and b.

    Groups are cut into spans of positions, and least ranks near a cut are copied to the neighbour, so that a group
    that holds a third of the rows is spread over many tasks.
    """
    span = (F.col("local_idx") / SPAN).cast("long")
    n, place = tasks(windows), [group, "_span", "local_idx"]
    rows = windows.withColumn("_span", span).repartition(n, *place).withColumn("p", F.min(h).over(Window.partitionBy(*place)))
    least = rows.groupBy(*place).agg(F.min("p").alias("p"))
    at = F.col("local_idx")
    near = F.array_distinct(F.array(((at - radius) / SPAN - F.when(at < radius, 1).otherwise(0)).cast("long"), F.col("_span"), ((at + radius) / SPAN).cast("long")))
    halo = least.select(group, F.explode(near).alias("_near"), "_span", "local_idx", "p").where("_near >= 0")
    around = Window.partitionBy(group, "_near").orderBy("local_idx").rangeBetween(-radius, radius)
    guard = halo.repartition(n, group, "_near").withColumn("b", F.min("p").over(around)).where("_near = _span").select(*place, "b")
    return rows.join(guard.repartition(n, *place), place).drop("_span")


def threshold(promoted: DataFrame, target: float) -> int:
    """Smallest x whose validation share of the usable windows reaches the target."""
    if not 0 < target < 1:
        raise ValueError("the target must be between 0 and 1")
    ends = promoted.select(F.explode(F.array(F.struct(F.col("p").alias("x"), F.lit(1).alias("v"), F.lit(0).alias("t")), F.struct(F.col("b").alias("x"), F.lit(0).alias("v"), F.lit(1).alias("t")))).alias("e")).select("e.*")
    bins = ends.groupBy(F.shiftright("x", LOW_BITS).alias("bin")).agg(F.sum("v").alias("v"), F.sum("t").alias("t")).orderBy("bin").collect()
    total = sum(r["v"] for r in bins)
    if not total:
        raise ValueError("there are no windows")

    def search(rows, name: str, val: int, gone: int):
        for r in rows:
            before = (val, gone)
            val, gone = val + r["v"], gone + r["t"]
            if val / (val + total - gone) >= target:
                return r[name], before
        raise ValueError("unreachable target")

    bin_, before = search(bins, "bin", 0, 0)
    inside = ends.where(F.shiftright("x", LOW_BITS) == bin_).groupBy("x").agg(F.sum("v").alias("v"), F.sum("t").alias("t")).orderBy("x").toLocalIterator()
    return search(inside, "x", *before)[0]


def split_windows(windows: DataFrame, group: str, radius: int, target: float, h: str = "h") -> DataFrame:
    """windows with a column split. Views at one position of a group are always validated together."""
    # Written once: the histogram, the search in one bin and the result all read it.
    promoted = saved(promotion(windows, group, radius, h), "promoted")
    x = threshold(promoted, target)
    return promoted.withColumn("split", F.when(F.col("p") <= x, "validate").when(F.col("b") > x, "train").otherwise("discard")).drop("p", "b")


def audit(split: DataFrame, *by: str) -> DataFrame:
    """total, train, validate, discard, share of validation in usable windows, and groups."""
    count = lambda name: F.count_if(F.col("split") == name)
    usable = count("train") + count("validate")
    return split.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), count("train").alias("train"), count("validate").alias("validate"), count("discard").alias("discard"),
        F.round(F.when(usable > 0, count("validate") / usable).otherwise(0.0), 6).alias("share"), F.countDistinct("group_idx").alias("n_groups"),
    )


def overlaps(split: DataFrame, radius: int) -> DataFrame:
    """Pairs of a training and a validation window of a group within the radius; none if the split is sound."""
    near = F.explode(F.sequence(F.col("local_idx") - radius, F.col("local_idx") + radius))
    val = split.where("split = 'validate'").select("group_idx", F.col("source_idx").alias("val_source"), F.col("local_idx").alias("val_local"), near.alias("local_idx"))
    return split.where("split = 'train'").select("group_idx", "source_idx", "local_idx").join(val, ["group_idx", "local_idx"])


def guarded(split: DataFrame, radius: int) -> DataFrame:
    """Windows near a validation window of their group that are not validation themselves."""
    near = split.where("split = 'validate'").select("group_idx", F.explode(F.sequence(F.col("local_idx") - radius, F.col("local_idx") + radius)).alias("local_idx")).distinct()
    return split.where("split <> 'validate'").join(near, ["group_idx", "local_idx"], "left_semi")


def problems(split: DataFrame, radius: int) -> DataFrame:
    """Every broken rule of a split with the number of its rows; all zero if it is sound."""
    views = split.groupBy("group_idx", "start_sample").agg(F.count_if(F.col("split") == "validate").alias("v"), F.count(F.lit(1)).alias("n"))
    apart = views.agg(F.count_if((F.col("v") > 0) & (F.col("v") < F.col("n"))).alias("bad")).select(F.lit("views_apart").alias("rule"), "bad")
    twice = split.groupBy("source_idx", "local_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad")).select(F.lit("in_two_splits").alias("rule"), "bad")
    leak = overlaps(split, radius).agg(F.count(F.lit(1)).alias("bad")).select(F.lit("train_near_validate").alias("rule"), "bad")
    none = split.agg(F.count_if(F.col("split").isNull() | ~F.col("split").isin("train", "validate", "discard")).alias("bad")).select(F.lit("without_split").alias("rule"), "bad")
    return apart.unionAll(twice).unionAll(leak).unionAll(none)


def seeded_order(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """df sorted by key: a permutation that depends on the seed and ids alone."""
    return ranked(df, seed, *ids).orderBy("h", *ids)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; no row if both hold the same set."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def partition_check(split: DataFrame, all_ids: DataFrame, *ids: str) -> DataFrame:
    """Sizes of all intersections of splits and of the difference from all ids."""
    names = ("train", "validate", "discard")
    own = split.select(*ids, *[(F.col("split") == s).cast("int").alias(s) for s in names], F.lit(0).alias("all"))
    wanted = all_ids.select(*ids, *[F.lit(0).alias(s) for s in names], F.lit(1).alias("all"))
    met = dealt(own.unionByName(wanted), *ids).groupBy(*ids).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*names, "all")])
    off = F.coalesce(F.sum(F.abs(F.col("train") + F.col("validate") + F.col("discard") - F.col("all"))), F.lit(0))
    both = (("train", "validate"), ("train", "discard"), ("validate", "discard"))
    counts = met.agg(off.alias("_off"), *[F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_and_{b}") for a, b in both])
    rows = [F.struct(F.lit("not_covered_or_unknown").alias("check"), F.col("_off").alias("n")), *[F.struct(F.lit(f"{a}_and_{b}").alias("check"), F.col(f"{a}_and_{b}").alias("n")) for a, b in both]]
    return counts.select(F.inline(F.array(*rows)))
