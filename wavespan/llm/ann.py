"""Approximate nearest neighbours by additive quantisation, with exact reranking.

Codebooks are full-dimensional: the first ones fit the residuals of those before (k-means), then all are fitted
together to the codes (least squares). A vector is encoded by beam search over sums of one word of each book, and
stored as a few bytes and the squared norm of that sum. Queries go in blocks of a fixed size: a table of their
products with all words scores every stored code, each partition returns its best RERANK, and the best of all are
reranked by exact distance on the original vectors.

Equal vectors form a class that is encoded once and keeps its smallest ids, so that a vector which a third of the
table repeats neither crowds out other candidates nor gathers in a task.

Defined cases
* vectors that are null, zero, or hold null or non-finite components take no part, nor do null vec_ids; vectors of
  another length than the commonest (the shorter in a tie) take no part.
* rows that share a vec_id count once, with the smallest vector. Fewer candidates than k: all of them.
* ties in distance go to the smaller vec_id. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, drop_saved, saved

BOOKS = 32
WORDS = 64
BEAM = 8
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Distinct vectors reranked for each query, and queries scored together.
RERANK = 1000
QUERY_BLOCK = 1024
#: Partitions whose best meet first.
GROUP = 64


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (np.einsum("ij,ij->i", c, c)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n x books) of the best sums that a beam search finds."""
    m, k, dim = books.shape
    flat = books.reshape(m * k, dim)
    gram = flat @ flat.T
    norm = np.diagonal(gram)
    out = np.zeros((len(x), m), np.uint8)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        dots = part @ flat.T
        codes = np.zeros((len(part), 1, 0), np.int64)
        error = np.zeros((len(part), 1))
        for j in range(m):
            s = slice(j * k, (j + 1) * k)
            new = error[:, :, None] + (norm[s] - 2 * dots[:, s])[:, None, :]
            for i in range(j):
                new = new + 2 * gram[i * k + codes[:, :, i], s]
            width = min(beam, new.shape[1] * k)
            new = new.reshape(len(part), -1)
            best = np.argpartition(new, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(new, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
        out[lo : lo + 256] = np.take_along_axis(codes, error.argmin(1)[:, None, None], 1)[:, 0]
    return out


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2) -> np.ndarray:
    """Codebooks (books x words x dimension) for a sample."""
    rng = np.random.default_rng(7)
    words = max(1, min(words, len(x) // 2 or 1))
    c, rest = np.zeros((books, words, x.shape[1])), x.copy()
    for j in range(books):
        c[j] = _kmeans(rest, words, rng)
        own = (np.einsum("ij,ij->i", c[j], c[j])[None, :] - 2 * rest @ c[j].T).argmin(1)
        rest = rest - c[j][own]
    for _ in range(rounds):
        codes = encode(x, c) + np.arange(books) * words
        b = np.zeros((len(x), books * words), np.float32)
        b[np.arange(len(x))[:, None], codes] = 1
        c = np.linalg.solve((b.T @ b).astype(float) + 0.1 * np.eye(books * words), b.T @ x.astype(np.float32) + 0.1 * c.reshape(-1, x.shape[1])).reshape(c.shape)
    return c


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _encoder(held):
    def run(batches):
        books = held.value
        at = np.arange(len(books))
        for b in batches:
            if b.num_rows:
                codes = encode(_matrix(b.column("vector")), books)
                norm = np.square(books[at, codes].sum(1)).sum(1)
                yield pa.record_batch({"rep": b.column("rep"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": pa.array(norm)})

    return run


def _scorer(held_books, held_queries, most: int):
    def run(batches):
        books, (ids, q) = held_books.value, held_queries.value
        m, k, _ = books.shape
        table = (q @ books.reshape(m * k, -1).T).astype(np.float32)
        best = np.full((len(q), 0), np.inf, np.float32)
        reps = np.zeros((len(q), 0), np.int64)
        for b in batches:
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, m).astype(np.int64) + np.arange(m) * k
            norm, rep = b.column("norm").to_numpy().astype(np.float32), b.column("rep").to_numpy()
            for lo in range(0, len(rep), 2048):
                s = slice(lo, lo + 2048)
                score = np.repeat(norm[None, s], len(q), 0)
                for j in range(m):
                    score -= 2 * table[:, codes[s, j]]
                best = np.concatenate([best, score], 1)
                reps = np.concatenate([reps, np.broadcast_to(rep[s], score.shape)], 1)
                if best.shape[1] > most:
                    keep = np.argpartition(best, most - 1, axis=1)[:, :most]
                    best, reps = np.take_along_axis(best, keep, 1), np.take_along_axis(reps, keep, 1)
        if best.shape[1]:
            yield pa.record_batch({"query_id": pa.array(ids), "reps": pa.array([r.tobytes() for r in reps], pa.binary()), "near": pa.array([x.astype(np.float32).tobytes() for x in best], pa.binary())})

    return run


def _best_of_some(most: int):
    """The best of one query in a group of partitions, of which a row for each came in."""

    def run(key, got):
        rep = np.frombuffer(b"".join(got.column("reps").to_pylist()), np.int64)
        near = np.frombuffer(b"".join(got.column("near").to_pylist()), np.float32)
        keep = np.lexsort((rep, near))[:most]
        return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "reps": pa.array([rep[keep].tobytes()], pa.binary()), "near": pa.array([near[keep].tobytes()], pa.binary())})

    return run


def _best_of_all(most: int):
    """The groups' best of one query; a row for each group came in."""

    def run(key, got):
        rep = np.frombuffer(b"".join(got.column("reps").to_pylist()), np.int64)
        near = np.frombuffer(b"".join(got.column("near").to_pylist()), np.float32)
        keep = np.lexsort((rep, near))[:most]
        return pa.table({"query_id": pa.array(np.full(len(keep), key[0].as_py(), np.int64)), "rep": pa.array(rep[keep])})

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    found = found.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    common = found.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return found.where(F.size("vector") == (common[0]["n"] if common else 0))


def search(vectors: DataFrame, queries: Column, k: int = 10, rerank: int = RERANK, books: int = BOOKS, words: int = WORDS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance). queries: condition on vec_id. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    rows = saved(valid_vectors(vectors), "vectors")
    # k + 1 ids are enough of a class, as only the query itself is left out. The limit also holds before the shuffle.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("r", order).where(F.col("r") <= k + 1)
    classes = saved(few.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    sample = bounded_sample(classes.select("vector", "rep"), "rep", SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(fit(np.array(sample.sort_values("rep")["vector"].tolist()), books, words))
    index = saved(classes.mapInArrow(_encoder(held), "rep long, codes binary, norm double"), "codes")
    asked = saved(rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "queries")
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    tables = []
    # Blocks by hash: each is broadcast alone, and its size doesn't grow with the table.
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toPandas()
        if len(mine):
            q = spark.sparkContext.broadcast((mine["query_id"].to_numpy(np.int64), np.array(mine["query"].tolist())))
            found = index.mapInArrow(_scorer(held, q, rerank), "query_id long, reps binary, near binary")
            # Best of GROUP partitions first, so that no task holds a row of every partition.
            some = found.withColumn("g", (F.spark_partition_id() / GROUP).cast("int")).groupBy("query_id", "g").applyInArrow(_best_of_some(rerank), "query_id long, reps binary, near binary")
            tables.append(saved(some.groupBy("query_id").applyInArrow(_best_of_all(rerank), "query_id long, rep long"), "near"))
    if not tables:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = spark.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables])
    drop_saved(index)
    drop_saved(rows)
    pairs = near.join(classes, "rep").join(asked, "query_id")
    far = F.sqrt(F.aggregate(F.zip_with("query", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    found = pairs.select("query_id", far.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
