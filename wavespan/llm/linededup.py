"""Line dedup by distinct-site spread.

Lines are normalised and hashed once, in the only pass that reads them as lines; the rest works on hashes. Lines that
are used often enough to stand on many sites get a HyperLogLog sketch of their sites (`source`); sketches merge by
aggregation, so a hot line costs one small row for each task. Lines whose estimate is clearly above the limit are
boilerplate, those clearly below are not, and those near it get exact distinct counts. Of a boilerplate line the first
occurrence (smallest doc_id, then first in the text) stays; all others are removed.

Defined cases
* null text stays null, empty text empty. Lines without a word are never removed.
* null site: a site of its own. Null doc_id: after all ids. Rows that share a doc_id, or have none, and differ in text
  are documents of their own, in the order of text hashes; repeated rows are one document, and both are returned.
* a text all of whose lines go becomes empty; the row stays. Equal lines are equal after lower-casing and
  collapsing white space.
* other columns pass through whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop_saved, of_row, saved

#: Sites from which a line is boilerplate; estimates within this share of it are counted exactly.
MIN_SITES = 8
NEAR = 0.25
#: log2 of the registers of a sketch.
LG_K = 10
#: What names a document: no doc_id?, doc_id, hash of the text.
KEY = ("nameless", "doc", "th")


def _key(text: Column, doc_id: Column) -> list[Column]:
    return [doc_id.isNull().cast("int").alias("nameless"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(11)).alias("th")]


def _hash_lines(batches):
    """h1, h2 (of the normalised line), site, the document's key, line number, of every line with a word."""
    for b in batches:
        rows, numbers, found = [], [], []
        for k, text in enumerate(b.column("text").to_pylist()):
            for i, line in enumerate(text.lower().encode("utf-8", "surrogatepass").split(b"\n")):
                words = line.split()
                if words:
                    rows.append(k)
                    numbers.append(i)
                    found.append(xxhash.xxh3_128_digest(b" ".join(words)))
        h, at = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2), pa.array(rows, pa.int64())
        rest = {c: b.column(c).take(at) for c in ("site", *KEY)}
        yield pa.record_batch({"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), **rest, "line": pa.array(numbers, pa.int32())})


def _spread_lines(docs: DataFrame, min_sites: int) -> DataFrame:
    """The lines that are used at least min_sites times: h1, h2, site, key, line."""
    site = F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("site")
    rows = docs.where("text IS NOT NULL").select("text", site, *_key(F.col("text"), F.col("doc_id")))
    lines = saved(rows.mapInArrow(_hash_lines, "h1 long, h2 long, site string, nameless int, doc long, th long, line int"), "lines")
    often = saved(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= min_sites).select("h1", "h2"), "often")
    out = saved(lines.join(often, ["h1", "h2"]), "shared-lines")
    drop_saved(lines)
    drop_saved(often)
    return out


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """h1, h2, n_sites (exact near the limit, else an estimate), first (key and line) of each line spread over min_sites sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"), F.min(F.struct(*KEY, "line")).alias("first"))
    spread = saved(spread.where(F.col("n") >= min_sites * (1 - near)), "spread")
    unsure = spread.where(F.col("n") <= min_sites * (1 + near)).select("h1", "h2")
    exact = lines.join(unsure, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    found = spread.join(exact, ["h1", "h2"], "left").withColumn("n_sites", F.coalesce("exact", "n"))
    out = saved(found.where(F.col("n_sites") >= min_sites).select("h1", "h2", "n_sites", "first"), "boilerplate")
    drop_saved(spread)
    return out


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """row (all columns of docs), kept (text without boilerplate lines), n_lines, n_removed."""
    lines = _spread_lines(docs, min_sites)
    bad = boilerplate(lines, min_sites)
    # Both sides are tables, so Spark can split a line that very many documents have.
    hits = lines.join(bad, ["h1", "h2"]).where(F.struct(*KEY, "line") != F.col("first"))
    hits = saved(hits.groupBy(*KEY).agg(F.collect_set("line").alias("bad")), "hits")
    drop_saved(lines)
    drop_saved(bad)
    rows = docs.select(as_row(docs), F.col("text").alias("text"), *_key(F.col("text"), F.col("doc_id"))).join(hits, list(KEY), "left")
    split = F.split(F.col("text"), "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("bad")), lambda i: F.get(split, i))
    return rows.select(
        "row", F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.when(F.col("bad").isNull(), 0).otherwise(F.size("bad")).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs, with boilerplate lines taken out of text."""
    return _cleaned(docs, min_sites).select(*of_row(docs, text=F.col("kept")))


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_md5 of every document."""
    out = _cleaned(docs.select("doc_id", "text", "source"), min_sites)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


#: The same rows by DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS site, coalesce(text, '') AS text, text IS NULL AS gone FROM documents),
l AS (SELECT doc_id, site, line, i, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM
  (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
b AS (SELECT norm, min(doc_id) AS first_doc FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT l.*, b.norm IS NULL OR (l.doc_id = b.first_doc AND row_number() OVER (PARTITION BY l.doc_id, l.norm ORDER BY i) = 1) AS kept FROM l LEFT JOIN b ON l.norm = b.norm),
r AS (SELECT doc_id, count(*) AS n_lines, count_if(NOT kept) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '')) AS kept_md5 FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone THEN 0 ELSE n_lines END AS n_lines, n_removed, kept_md5 FROM d JOIN r USING (doc_id)
"""
