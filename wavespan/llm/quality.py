"""Quality rules with a cross-document line-frequency filter, in SQL functions only.

Base measures are taken from each text alone. The filter hashes normalised lines, counts for each host
(`source`) the distinct documents a line occurs in, removes lines above the limit, and rejects a document
that keeps too little of itself.

Defined cases
* null or empty text: no words, so base_failed and not kept.
* null host: a host of its own. Null doc_id: such rows are measured like others.
* a document is an id with a text: copies under other ids count each, rows that repeat id and text count once.
* repeated rows: each is returned, with the same result. Empty table: empty result.
* other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, let, saved, words

#: A line is boilerplate in a host when more than MIN_DOCS documents have it, and more than HOST_SHARE of
#: the host's documents or more than MAX_DOCS, however large the host is.
MIN_DOCS = 8
HOST_SHARE = 0.05
MAX_DOCS = 100
#: A document is depleted when fewer of its words than this share are left, or fewer than MIN_WORDS.
KEEP_SHARE = 0.5
MIN_WORDS = 10


def _covered_words(w: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the array w."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def union(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            last = F.size(s) - 1
            at = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & F.coalesce(same(F.greatest(j - 1, F.lit(0)), j), F.lit(False))) | ((j < last) & F.coalesce(same(F.least(j + 1, last), j), F.lit(False))))
            starts = F.array_sort(F.transform(at, lambda j: F.get(s, j)["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, x: F.struct((a["n"] + x + 5 - F.greatest(x, a["end"])).alias("n"), (x + 5).alias("end")),
                lambda a: a["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, union))

    return F.when(F.size(w) < 6, F.lit(0)).otherwise(let(hashes, count))


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, with host and text hash kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("_host"),
        F.xxhash64(text, F.lit(7)).alias("_th"),
        text.alias("_text"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _covered_words(w).alias("r"))).alias("_w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("_w")["n"].cast("long"), F.col("_w")["r"].cast("long")
    return out.select(
        "doc_id", "_host", "_th", "_text", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        r.alias("n_repeat_words"), ((n < MIN_WORDS) | (100 * r > 20 * n)).alias("base_failed"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised line with a word of each document: the first 128 bits of its SHA-256 and the words it takes up."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = lambda x: F.trim(F.lower(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    lines = F.filter(F.transform(F.split(text, "\n", -1), norm), lambda x: x != "")
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("host"),
        F.xxhash64(text, F.lit(7)).alias("th"),
        F.posexplode(lines).alias("pos", "line"),
    ).select(
        "doc_id", "host", "th", "pos", F.unhex(F.substring(F.sha2(F.col("line").cast("binary"), 256), 1, 32)).alias("h"),
        (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("n"),
    )


def boilerplate_lines(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS, lines: DataFrame | None = None) -> DataFrame:
    """host, h, n_docs of the lines above the limits. lines: of the documents, where they are known already."""
    lines = (_lines(docs) if lines is None else lines).select("host", "h", F.xxhash64("doc_id", "th").alias("doc"))
    # The distinct rows spread by document too, and their counts are summed before the shuffle by line: no line is one task's.
    spread = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    keys = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("\x00null")).alias("host"),
        F.xxhash64("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(7))).alias("doc"),
    )
    hosts = keys.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    above = (F.col("n_docs") > host_share * F.col("host_docs")) | (F.col("n_docs") > max_docs)
    return spread.join(hosts, "host").where(above).select("host", "h", "n_docs")


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Base measures of every row, n_removed_words by the line filter, and kept."""
    base = base_measures(docs).drop("_text")
    # Lines are split, normalised and hashed once; the bad ones are a table, so that Spark can split a line that very many documents have.
    lines = saved(_lines(docs).select("doc_id", "host", "th", "h", "n"), "lines")
    bad = saved(boilerplate_lines(docs, min_docs, host_share, max_docs, lines), "bad-lines")
    removed = saved(lines.join(bad, ["host", "h"]).groupBy("doc_id", "host", "th").agg(F.sum("n").alias("n_removed")), "removed-lines")
    drop_saved(lines)
    drop_saved(bad)
    # Repeated rows each add their lines: divide by how many rows share the id, host and text.
    rows = base.groupBy("doc_id", "_host", "_th").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    removed = removed.join(rows, removed.doc_id.eqNullSafe(rows.doc_id) & (removed.host == rows._host) & (removed.th == rows._th), "left").select(
        removed.doc_id.alias("_id"), "host", "th", (F.col("n_removed") / F.coalesce(F.col("n_rows"), F.lit(1))).cast("long").alias("n_removed_words")
    )
    out = base.join(removed, base.doc_id.eqNullSafe(removed._id) & (base._host == removed.host) & (base._th == removed.th), "left")
    left = F.col("n_words") - F.coalesce(F.col("n_removed_words"), F.lit(0))
    depleted = (left < MIN_WORDS) | (left < keep_share * F.col("n_words"))
    return out.select(
        base.doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(F.col("n_removed_words"), F.lit(0)).alias("n_removed_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


#: The same rows by DuckDB. Hashes are replaced by the lines themselves.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS e, lead(w, 4) OVER p AS f FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, b, c, e, f) > 1 AND f IS NOT NULL AS rep FROM g),
m AS (SELECT doc_id, count(*) AS n_words, count_if(cov) AS n_repeat_words FROM
  (SELECT doc_id, bool_or(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cov FROM k) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, line FROM
  (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE norm <> '' GROUP BY doc_id),
s AS (SELECT host, norm, count(*) AS n FROM (SELECT DISTINCT host, norm, doc_id, text FROM l WHERE norm <> '') GROUP BY host, norm HAVING count(*) > {MIN_DOCS}),
hd AS (SELECT host, count(*) AS host_docs FROM (SELECT DISTINCT host, doc_id, text FROM d) GROUP BY host),
bad AS (SELECT s.host, s.norm FROM s JOIN hd USING (host) WHERE s.n > {HOST_SHARE} * hd.host_docs OR s.n > {MAX_DOCS}),
r AS (SELECT doc_id, sum(length(l.norm) - length(replace(l.norm, ' ', '')) + 1)::BIGINT AS n_removed_words FROM l JOIN bad USING (host, norm) GROUP BY doc_id),
o AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM d LEFT JOIN m USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS} AND n_words - n_removed_words >= {KEEP_SHARE} * n_words AS kept FROM b
"""
