"""Positions of rows in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id below the partition's number.
LOCAL = 33


def in_order(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt out by ranges of the sort keys and sorted within them, with _at: partition and place in it.

    Write the result before it is used twice: the ranges are drawn from a sample of each run.
    """
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())


def with_positions(placed: DataFrame, name: str, weight: Column | None = None, start: int = 0) -> DataFrame:
    """placed (a written table of in_order) with the position of each row, or with the sum of the weights of all rows before it.

    The driver sees one number for each partition.
    """
    pid, value = F.shiftright("_at", LOCAL), F.lit(1).cast("long") if weight is None else weight
    sums = placed.groupBy(pid.alias("pid")).agg(F.sum(value).cast("long").alias("n")).orderBy("pid").collect()
    before, offsets = start, []
    for r in sums:
        offsets.append((r["pid"], before))
        before += r["n"] or 0
    spark = placed.sparkSession
    known = F.broadcast(spark.createDataFrame(offsets, "_pid long, _before long"))
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL) - 1))
    if weight is not None:
        from pyspark.sql import Window

        local = F.coalesce(F.sum(value).over(Window.partitionBy(pid).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_local", local).withColumn("_pid", pid)
    return rows.join(known, "_pid").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_pid", "_before", "_local", "_at")
