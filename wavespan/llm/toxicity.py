"""Toxicity: a linear classifier on character n-grams, features scaled by naive Bayes log-count ratios.

Training has two Spark passes over a bounded sample of labelled rows (SAMPLE of each class, taken in the order of
a hash of doc_id): one counts in how many documents of each class each hashed n-gram occurs and gives the ratios
r = log(P(f | toxic) / P(f | not)); the other takes the selected features of each document. A document's feature
is r where the n-gram occurs and 0 elsewhere; logistic regression gives the weights. The intercept is moved from
the sample's class shares to those of all labelled training rows.

Defined cases
* null or empty text: scored from the intercept alone (0 features). Null doc_id: scored, fold 0, never trained on.
* doc_id with several labels: toxic if any label says so. Null labels are left out.
* no training rows of one class: every score is the share of toxic labels (0 when there are none).
* repeated rows: each is returned. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .chars import MULTIPLIER, blocks, code_points, letter_table
from .common import as_row, fold, of_row

#: Labelled rows of each class that training reads at most.
SAMPLE = 3000
BITS = 20
SIZES = (3, 4, 5, 6)
#: Features kept, by |r| weighted with support; documents a feature needs.
FEATURES = 8000
SUPPORT = 4
THRESHOLD = 0.7
L2 = 1e-3


def _features(texts: list[str | None], keep: np.ndarray | None = None):
    """(text, feature) of every distinct n-gram of each text; n-grams stay within a word and its two boundaries."""
    code, ends = code_points(texts)
    letter = letter_table()[code]
    c = np.where(letter, code, np.where(code == 0, np.uint32(0), np.uint32(1))).astype(np.uint32)
    # Runs of boundaries never start or end inside an n-gram: only its first and last code point may be one.
    inner = np.concatenate([[0], np.cumsum(~letter)])
    rows, found = [], []
    h = c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:-1] * MULTIPLIER + c[n - 1 :] * np.uint32(2654435761)
        if n not in SIZES:
            continue
        x = h ^ (h >> np.uint32(15))
        x = ((x * np.uint32(0x2C1B3C6D)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        ok = (inner[n - 1 : len(c)] - inner[1 : len(c) - n + 2] == 0) & (c[: len(x)] > 0) & (c[n - 1 :] > 0) & (letter[: len(x)] | letter[n - 1 :])
        if keep is not None:
            x = keep[x]
            ok &= x >= 0
        at = np.flatnonzero(ok)
        rows.append(np.searchsorted(ends, at))
        found.append(x[at].astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate(rows) << 32 | np.concatenate(found))
    return key >> 32, key & 0xFFFFFFFF


def _count(batches):
    counts = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        rows = list(zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True))
        for run in blocks(rows, lambda r: len(r[0] or "")):
            y = np.array([r[1] for r in run])
            i, f = _features([r[0] for r in run])
            for k in (0, 1):
                counts[k] += np.bincount(f[y[i] == k], minlength=1 << BITS)
    at = np.flatnonzero(counts.sum(0))
    yield pa.record_batch({"f": pa.array(at, pa.int64()), "neg": pa.array(counts[0][at]), "pos": pa.array(counts[1][at])})


def _take(keep):
    def take(batches):
        for b in batches:
            for part in blocks(list(zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True)), lambda r: len(r[1] or "")):
                i, f = _features([r[1] for r in part], keep.value)
                cut = np.searchsorted(i, np.arange(len(part) + 1))
                yield pa.record_batch({"y": pa.array([r[0] for r in part], pa.int32()), "f": pa.array([f[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(len(part))], pa.binary())})

    return take


def _fit(y: np.ndarray, doc: np.ndarray, feat: np.ndarray, r: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of presence (r included) and intercept, by accelerated full gradients."""
    n, x = len(y), r[feat].astype(np.float32)
    w, b = np.zeros(len(r)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    vw, vb = w.copy(), b
    scale = np.bincount(doc, x * x, minlength=n)
    step = 4.0 / (np.percentile(scale, 90) + 1.0)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, x * vw[feat], minlength=n) + vb, -30, 30)))
        g = (p - y) / n
        nw = vw - step * n / 50 * (np.bincount(feat, x * g[doc], minlength=len(r)) + L2 * vw)
        nb = vb - step * n / 50 * g.sum()
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w * r, b


class Model:
    """Feature of each hash bucket (-1: none), weight of each feature, intercept."""

    def __init__(self, keep: np.ndarray, weight: np.ndarray, intercept: float):
        self.keep, self.weight, self.intercept = keep, weight, intercept


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Whoever calls leaves held-out labels away."""
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where("y IN (0, 1)")
    total = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        share = 0.0 if 1 not in total else 1.0
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), 30.0 * (2 * share - 1))
    drawn = [labels.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionAll(drawn[1])), "doc_id").select("text", "y")
    counts = rows.mapInArrow(_count, "f long, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("neg") + F.col("pos") >= SUPPORT)
    n = [min(sample, total[k]) for k in (0, 1)]
    r = F.log((F.col("pos") + 1) / F.lit(n[1] + 2.0)) - F.log((F.col("neg") + 1) / F.lit(n[0] + 2.0))
    chosen = counts.select("f", r.alias("r"), (F.abs(r) * F.sqrt(F.col("pos") + F.col("neg"))).alias("gain")).orderBy(F.desc("gain"), "f").limit(FEATURES).toPandas()
    keep = np.full(1 << BITS, -1, np.int32)
    keep[chosen["f"].to_numpy(np.int64)] = np.arange(len(chosen))
    got = rows.mapInArrow(_take(spark.sparkContext.broadcast(keep)), "y int, f binary").toPandas()
    feats = [np.frombuffer(x, np.int32) for x in got["f"]]
    y = got["y"].to_numpy(float)
    weight, intercept = _fit(y, np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in feats]), np.concatenate([*feats, np.zeros(0, np.int32)]), chosen["r"].to_numpy(float))
    shift = np.log(total[1] / total[0]) - np.log(n[1] / n[0])
    return Model(keep, weight, float(intercept + shift))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs) and score of every row; reads whole texts in one narrow pass."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = held.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                z = []
                for part in blocks(b.column("row").field(at).to_pylist(), lambda t: len(t or ""), 1 << 19):
                    i, f = _features(part, m.keep)
                    z.append(np.bincount(i, m.weight[f], minlength=len(part)) + m.intercept)
                p = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p)], ["row", "score"])

    rows = docs.select(as_row(docs))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    doc_id = F.col("row.doc_id")
    return scored(docs, model).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold, with the columns of docs."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).where(F.col("score") < threshold).select(*of_row(docs))
