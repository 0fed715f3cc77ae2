"""Helpers shared by the text operators: tables, scratch tables in the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the separators of a word: space and the control characters 9 to 13.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The session names it; in local mode (tests) one is made where it doesn't."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write a table into the shared folder (one part for each value of `by`) and read it: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table of saved() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of exactly that name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame) -> Column:
    """All columns of docs as one, named row, so that no name that is added can clash with theirs."""
    return F.struct(*[column(c) for c in docs.columns]).alias("row")


def of_row(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of docs out of row, some of them changed."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns]


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as crc 0."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(mod))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now, not when the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at most, those with the least hashes of a key.

    A threshold on the hash leaves about 1.5 n rows of the whole table, so tasks send few rows, however many there are.
    """
    total = df.count()
    h = F.xxhash64(key)
    near = F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.5 * n + 100) / max(total, 1)))
    return df.where(near).orderBy(h, key).limit(n)
