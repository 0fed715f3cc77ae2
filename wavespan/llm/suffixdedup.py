"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every string of LENGTH bytes that also starts earlier (smaller doc_id, or same document and earlier start) is
removed. Sorting all suffixes of a corpus is not affordable, and not needed: only equality of LENGTH bytes counts.

1. Anchors. Of the 24-byte grams inside a string, the one with the least hash is its anchor; equal strings have equal
   anchors at equal distance, so a string needs comparing only with those that have its anchor, and neighbouring
   strings share anchors (about one for 40 bytes). The bytes around an anchor that stands alone never move.
2. Refinement. Stretches of bytes around equal anchors meet in a task, equal stretches once. Positions fall into
   initial buckets by their 8 bytes. Sorting positions on the bucket numbers at p and p + 8 gives buckets of 16 bytes;
   their numbers at p and p + 16 give 32, and so on to 64; 64 and 32 give 96, and the 8 at p + 92 complete LENGTH.
   Each sort renumbers the buckets that the next one points to, at all later offsets. Strings alone in their bucket
   leave, and with the last of a stretch its positions. Bucket numbers stand for bytes, not for hashes of them.
3. Of each final bucket the earliest string stays; the starts of the others are removed.

Hot anchors: a batch of documents sends each distinct stretch around an anchor once, so a passage that millions of
documents share costs one row for each batch. Anchors that stay over HOT rows are not gathered: their strings are
aggregated one by one (minimum by two 64-bit identifiers, each of all LENGTH bytes, combined before the shuffle) and joined back.

Defined cases
* null or empty text, and texts under LENGTH bytes: nothing is removed. Matches never cross documents.
* null doc_id: sorts after all others. Rows with one doc_id (or none) and one text count as one document, and each is
  returned; different texts with one doc_id (or none) are documents of their own, in the order of 63-bit text hashes.
* equal whole texts (by SHA-256 and length): all but the smallest doc_id lose everything (from LENGTH bytes on)
  without further work.
* other columns are ignored, or pass through whatever their names. Empty table: empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import blocks
from .common import as_row, drop_saved, release, saved

LENGTH = 100
Q = 24
WINDOW = LENGTH - Q + 1
#: Rows up to which a bucket is gathered in a task.
HOT = 4000
LAST_ID = 2**63 - 1
#: Bytes that are worked on together, and bytes of a batch in which equal stretches are sent once.
BLOCK, BATCH = 1 << 19, 1 << 24
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """64-bit hash of the Q bytes at every offset."""
    x = a.astype(_U)
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << _U(8 * n))
    y = _mix(x)
    m = len(a) - Q + 1
    return _mix(y[:m] * _U(0x9E3779B97F4A7C15) + y[8 : 8 + m] * _U(0xD6E8FEB86659FD93) + y[16 : 16 + m] * _U(0xA0761D6478BD642F | 1))


def _anchors(text: np.ndarray, ends: np.ndarray):
    """Anchor, least and largest start it stands for, bucket; of every document in text (ends: one for each)."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, _U)]
    h = _gram_hashes(text)
    valid = np.ones(n, bool)
    for e in ends:
        valid[max(0, e - LENGTH + 1) : min(n, e)] = False
    parts = []
    step = 1 << 23
    for at in range(0, n, step):
        k = min(step, n - at)
        low = h[at : at + k + WINDOW - 1]
        m = (low & ~_U(0xFFFFFF)) | np.arange(len(low), dtype=_U)
        size = 1
        while size * 2 <= WINDOW:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if WINDOW > size:
            m = np.minimum(m[: len(m) - (WINDOW - size)], m[WINDOW - size :])
        parts.append((m & _U(0xFFFFFF)).astype(np.int64) + at)
    anchor = np.concatenate(parts)
    p = np.flatnonzero(valid)
    if not len(p):
        return [p, p, p, np.zeros(0, _U)]
    own = anchor[p]
    first = np.concatenate([[True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1)])
    cut = np.flatnonzero(first)
    last = np.concatenate([cut[1:], [len(p)]]) - 1
    return own[cut], p[cut], p[last], h[own[cut]]


def _encoded(batches, columns: list[str], most: int = BATCH):
    """Runs of rows of about `most` bytes, with the text as bytes."""

    def rows():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in columns]
            yield from zip(*cols, strict=True)

    run, total = [], 0
    for row in rows():
        data = (row[1] or "").encode("utf-8", "surrogatepass")
        run.append((row[0], data, *row[2:]))
        total += len(data)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def _emit_anchors(batches):
    """bucket, doc, tie, place (anchor, least and largest distance to a start), part (0: first of its bucket in this batch)."""
    for run in _encoded(batches, ["doc", "text", "tie"]):
        docs, ties, places, buckets = [], [], [], []
        for part in blocks([r for r in run if len(r[1]) >= LENGTH], lambda r: len(r[1]), BLOCK):
            text = np.frombuffer(b"".join(r[1] for r in part), np.uint8)
            ends = np.cumsum([len(r[1]) for r in part])
            a, lo, hi, b = _anchors(text, ends)
            at = np.searchsorted(ends, lo, side="right")
            docs.append(np.array([r[0] for r in part], np.int64)[at])
            ties.append(np.array([r[2] for r in part], np.int64)[at])
            places.append(((a - np.concatenate([[0], ends])[at]) << 16) | ((a - hi) << 8) | (a - lo))
            buckets.append(b.view(np.int64))
        if not docs:
            continue
        doc, tie, place, bucket = np.concatenate(docs), np.concatenate(ties), np.concatenate(places), np.concatenate(buckets)
        _, first, which, count = np.unique(bucket, return_index=True, return_inverse=True, return_counts=True)
        part = np.ones(len(bucket), np.int64)
        part[first] = 0
        yield pa.record_batch({"bucket": pa.array(bucket), "doc": pa.array(doc), "tie": pa.array(tie), "place": pa.array(place), "part": pa.array(np.where(part == 0, 0, 1 + (doc & 1023))), "here": pa.array(count[which])})


def _levels(data: np.ndarray):
    """Identifiers of 24, 48, 96 and LENGTH bytes at every offset of data where they fit."""
    g24 = _gram_hashes(data)
    g48 = _mix(g24[:-24] * _U(0x9E3779B97F4A7C15) + (g24[24:] ^ (g24[24:] >> _U(31))) * _U(0xD6E8FEB86659FD93))
    g96 = _mix(g48[:-48] * _U(0x8CB92BA72F3D8DD7) + (g48[48:] ^ (g48[48:] >> _U(30))) * _U(0xCA9B0C7EBA1DA115))
    m = len(data) - LENGTH + 1
    g100 = _mix(g96[:m] * _U(0xAAAAAAAAAAAAAAAB) + g24[76 : 76 + m] * _U(0x9E3779B185EBCA87))
    return g24, g48, g96, g100


def _second_identifier(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """64-bit chained hash of the LENGTH bytes at some offsets, eight bytes at a time, the last eight overlapping."""
    x = data.astype(_U)
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << _U(8 * n))
    h = np.full(len(where), LENGTH, _U)
    for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        h = (h ^ x[where + at]) * _U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        h ^= h >> _U(29)
    return h


def _ranks(doc: np.ndarray, tie: np.ndarray):
    """Rank of each row's (doc, tie) among the distinct ones, and these in order."""
    order = np.lexsort((tie, doc))
    d, t = doc[order], tie[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])[: len(d)]
    rank = np.empty(len(d), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, d[new], t[new]


def _offsets(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + sizes[i]."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _runs(doc: np.ndarray, p: np.ndarray):
    """doc, first, last of runs of neighbouring starts; input sorted by doc and p."""
    if not len(p):
        return doc, p, p
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (p[1:] > p[:-1] + 1)]))
    return doc[cut], p[cut], p[np.concatenate([cut[1:], [len(p)]]) - 1]


def _emit_stretches(batches):
    """Rows for refinement: kind 0, a stretch around an anchor; 1, one string of a hot bucket; 2, starts to remove."""
    names = ["kind", "bucket", "id2", "doc", "tie", "first", "last", "stretch"]
    kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
    for run in _encoded(batches, ["doc", "text", "tie", "places"]):
        rank, docs, ties = _ranks(np.array([r[0] for r in run], np.int64), np.array([r[2] for r in run], np.int64))
        # doc stands for the rank among the run's documents from here on.
        run = sorted(((k, r[1], r[3]) for k, r in zip(rank.tolist(), run, strict=True)), key=lambda r: r[0])
        seen: dict[tuple, tuple] = {}
        gone, hot = [], []
        for doc, data, places in run:
            for x in sorted(places):
                place = x >> 1
                a, near, far = place >> 16, (place >> 8) & 255, place & 255
                lo, hi = a - far, a - near
                if x & 1:
                    hot.append((doc, lo, data[lo : hi + LENGTH]))
                    continue
                key = (near, data[lo : hi + LENGTH])
                if key in seen:
                    if seen[key] != (doc, lo):
                        gone.append((doc, lo, hi))
                else:
                    seen[key] = (doc, lo)
        if seen:
            stretch = [k[1] for k in seen]
            at = [far_lo[1] for far_lo in seen.values()]
            near = np.array([k[0] for k in seen], np.int64)
            size = np.array([len(s) for s in stretch], np.int64)
            grams = b"".join(s[len(s) - LENGTH + n : len(s) - LENGTH + n + Q] for s, n in zip(stretch, near, strict=True))
            bucket = _gram_hashes(np.frombuffer(grams, np.uint8))[:: Q].view(np.int64)
            doc = np.array([v[0] for v in seen.values()], np.int64)
            lo = np.array(at, np.int64)
            for k in range(0, len(doc), 50_000):
                s = slice(k, k + 50_000)
                zero = np.zeros(len(doc[s]), np.int64)
                yield pa.record_batch([pa.array(zero, pa.int32()), pa.array(bucket[s]), pa.array(zero), pa.array(docs[doc[s]]), pa.array(ties[doc[s]]), pa.array(lo[s]), pa.array((lo + size - LENGTH)[s]), pa.array(stretch[s], pa.binary())], names=names)
        if hot:
            data = np.frombuffer(b"".join(s for _, _, s in hot), np.uint8)
            size = np.array([len(s) for _, _, s in hot], np.int64)
            n = size - LENGTH + 1
            where = _offsets(np.cumsum(size) - size, n)
            g100 = _levels(data)[3]
            # A second identifier of all LENGTH bytes, made without the first: these are compared across the whole corpus.
            id2 = _second_identifier(data, where)
            doc, p = np.repeat(np.array([d for d, _, _ in hot], np.int64), n), _offsets(np.array([x for _, x, _ in hot], np.int64), n)
            order = np.lexsort((p, doc, id2, g100[where]))
            i1, i2, doc, p = g100[where][order].view(np.int64), id2[order].view(np.int64), doc[order], p[order]
            new = np.concatenate([[True], (i1[1:] != i1[:-1]) | (i2[1:] != i2[:-1])])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            same = (doc != doc[head]) | (p != p[head])
            at = np.flatnonzero(same)
            at = at[np.lexsort((p[at], doc[at]))]
            gone += list(zip(*(x.tolist() for x in _runs(doc[at], p[at])), strict=True))
            keep = np.flatnonzero(new)
            for k in range(0, len(keep), 200_000):
                s = keep[k : k + 200_000]
                yield pa.record_batch([pa.array(np.ones(len(s)), pa.int32()), pa.array(i1[s]), pa.array(i2[s]), pa.array(docs[doc[s]]), pa.array(ties[doc[s]]), pa.array(p[s]), pa.array(p[s]), pa.nulls(len(s), pa.binary())], names=names)
        if gone:
            cols = list(zip(*gone, strict=True))
            own = np.array(cols[0], np.int64)
            none = np.zeros(len(gone), np.int64)
            yield pa.record_batch([pa.array(np.full(len(gone), 2), pa.int32()), pa.array(none), pa.array(none), pa.array(docs[own]), pa.array(ties[own]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.nulls(len(gone), pa.binary())], names=names)
        yield pa.record_batch([pa.array([], k) for k in kinds], names=names)


def _ranked(key: np.ndarray) -> np.ndarray:
    """Number of each key among the distinct ones, in order."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) if len(k) else k
    return out


def _in_company(key: np.ndarray) -> np.ndarray:
    n = np.bincount(key)
    return n[key] > 1


def _same_strings(stretches: list[bytes]):
    """Stretch, start in it, and final bucket of all strings that stand in several places of the stretches."""
    own, size = np.arange(len(stretches)), np.array([len(s) for s in stretches], np.int64)
    data = np.frombuffer(b"".join([*stretches, b"\0" * LENGTH]), np.uint8)
    n = size - LENGTH + 1
    row, where = np.repeat(own, n), _offsets(np.cumsum(size) - size, n)
    x = data.astype(_U)
    for k in (1, 2, 4):
        x = x[:-k] | (x[k:] << _U(8 * k))
    held = {8: _ranked(x)}
    for length, first, second in ((16, 8, 8), (32, 16, 16), (64, 32, 32), (96, 64, 32), (LENGTH, 96, 8)):
        a, b, step = held[first], held[second], length - second
        m = min(len(a), len(b) - step)
        if length == LENGTH:
            key = _ranked(a[where] * (int(b.max()) + 1) + b[where + step])
            keep = _in_company(key)
            return own[row[keep]], where[keep] - (np.cumsum(size) - size)[row[keep]], key[keep]
        held[length] = _ranked(a[:m] * (int(b.max()) + 1) + b[step : step + m])
        keep = _in_company(held[length][where])
        row, where = row[keep], where[keep]
        # Stretches without a string left are taken out, and bucket numbers move up with the positions.
        live = np.zeros(len(size), bool)
        live[row] = True
        if not live.any():
            return row, where, where
        if 2 * size[live].sum() < size.sum():
            begin = np.cumsum(size) - size
            spot = np.concatenate([_offsets(begin[live], size[live]), np.full(LENGTH, int(size.sum()))])
            held = {k: v[np.minimum(spot, len(v) - 1)] for k, v in held.items()}
            moved = np.cumsum(size * live) - size * live
            where = where - begin[row] + moved[row]
            row = (np.cumsum(live) - 1)[row]
            own, size = own[live], size[live]
    return row, where, where


def _refine(bucket, doc, first, stretches):
    """doc, first, last of runs of starts to remove of whole buckets."""
    order = np.lexsort((first, doc)).tolist()
    lead: dict[tuple, int] = {}
    gone_doc, gone_lo, gone_hi, several, company = [], [], [], {}, set()
    b, d, f = bucket.tolist(), doc.tolist(), first.tolist()
    for k in order:
        s = stretches[k]
        held = lead.setdefault((b[k], s), k)
        if held != k:
            if (d[held], f[held]) != (d[k], f[k]):
                gone_doc.append(d[k])
                gone_lo.append(f[k])
                gone_hi.append(f[k] + len(s) - LENGTH)
        elif several.setdefault(b[k], k) != k:
            company.add(b[k])
    rest = [k for (x, _), k in lead.items() if x in company]
    out = [np.array(x, np.int64) for x in (gone_doc, gone_lo, gone_hi)]
    if rest:
        at, start, key = _same_strings([stretches[k] for k in rest])
        rest = np.array(rest)
        d, p = doc[rest[at]], first[rest[at]] + start
        order = np.lexsort((p, d, key))
        key, d, p = key[order], d[order], p[order]
        if len(key):
            head = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
            later = (d != d[head]) | (p != p[head])
            d, p = d[later], p[later]
            order = np.lexsort((p, d))
            out = [np.concatenate(x) for x in zip(out, _runs(d[order], p[order]), strict=True)]
    return out


def _refine_buckets(batches):
    """Input sorted by bucket; whole buckets are taken together, about 10,000 rows at a time."""
    held = None
    for b in _with_end(batches):
        t = b if held is None else (pa.concat_tables([held, b]) if b is not None else held)
        if t is None:
            break
        t = t.combine_chunks() if t is not None else t
        if b is None:
            cut = t.num_rows
        else:
            if t.num_rows < 10_000:
                held = t
                continue
            keys = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
        now, held = t.slice(0, cut), t.slice(cut)
        if now.num_rows:
            rank, docs, ties = _ranks(now.column("doc").to_numpy(), now.column("tie").to_numpy())
            d, lo, hi = _refine(now.column("bucket").to_numpy(), rank, now.column("first").to_numpy(), now.column("stretch").to_pylist())
            yield pa.record_batch({"doc": pa.array(docs[d]), "tie": pa.array(ties[d]), "first": pa.array(lo), "last": pa.array(hi)})


def _with_end(batches):
    for b in batches:
        yield pa.Table.from_batches([b])
    yield None


def repeated_starts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, tie, first, last: runs of starts of strings that also start earlier. docs: doc, tie (never null), text.

    doc and tie together name one text.
    """
    spark = docs.sparkSession
    found = docs.mapInArrow(_emit_anchors, "bucket long, doc long, tie long, place long, part long, here long")
    # The first of a bucket in each batch meets the others'; the rest are known to have company and are spread out.
    total = F.expr("sum(CASE WHEN part = 0 THEN here END) OVER (PARTITION BY bucket, part)")
    found = found.withColumn("total", total).where("part > 0 OR total > 1").select("bucket", "doc", "tie", "place")
    found = saved(found, "anchors")
    release(spark)
    # Saved, so that Spark can split the hot anchors on the other side of the join.
    large = saved(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("bucket", F.lit(True).alias("is_hot")), "hot")
    places = found.join(large, "bucket", "left").groupBy("doc", "tie").agg(F.collect_set(2 * F.col("place") + F.when(F.col("is_hot"), 1).otherwise(0)).alias("places"))
    size = F.octet_length("text").cast("long")
    classes = docs.where(size >= LENGTH).select("doc", "tie", size.alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    firsts = classes.groupBy("sha", "n").agg(F.min(F.struct("doc", "tie")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    firsts = saved(firsts, "firsts")
    copies = saved(classes.join(firsts, ["sha", "n"]).where("struct(doc, tie) <> lead").select("doc", "tie", F.lit(0).cast("long").alias("first"), (F.col("n") - LENGTH).alias("last")), "copies")
    todo = docs.join(places.join(copies.select("doc", "tie"), ["doc", "tie"], "left_anti"), ["doc", "tie"]).select("doc", "text", "tie", "places")
    stretches = saved(todo.mapInArrow(_emit_stretches, "kind int, bucket long, id2 long, doc long, tie long, first long, last long, stretch binary"), "stretches")
    release(spark)
    gathered = stretches.where("kind = 0").select("bucket", "doc", "tie", "first", "stretch").repartition("bucket").sortWithinPartitions("bucket")
    gone = gathered.mapInArrow(_refine_buckets, "doc long, tie long, first long, last long")
    single = stretches.where("kind = 1").select("bucket", "id2", "doc", "tie", "first")
    lead = saved(single.groupBy("bucket", "id2").agg(F.min(F.struct("doc", "tie", "first")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "leads")
    later = single.join(lead, ["bucket", "id2"]).where("struct(doc, tie, first) <> lead").select("doc", "tie", "first", F.col("first").alias("last"))
    out = saved(gone.unionAll(later).unionAll(stretches.where("kind = 2").select("doc", "tie", "first", "last")).unionAll(copies), "starts")
    release(spark)
    for done in (found, stretches, copies, large, firsts, lead):
        drop_saved(done)
    return out


def _removed(n: int, runs) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, from runs of starts."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((max(0, r["first"]), min(n, r["last"] + LENGTH)) for r in runs or ()):
        if hi <= lo:
            continue
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _kept(data: bytes, spans) -> bytes:
    at, kept = 0, []
    for lo, hi in spans:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def _digest(batches):
    for b in batches:
        out = []
        for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans = _removed(len(data), runs)
            out.append((doc, len(data), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text, doc, tie; doc and tie together name a text: tie is 0 but for texts that share a doc_id, or have none, with others.

    Ties of a null doc_id are positive, so that these rows also come after a row whose doc_id is LAST_ID.
    """
    doc_id = F.col("doc_id").cast("long")
    own = F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc")
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)), 1)
    tie = F.when(doc_id.isNull(), h).otherwise(-h - 1).alias("own_tie")
    shared = docs.select(own, tie).groupBy("doc").agg(F.min("own_tie").alias("a"), F.max("own_tie").alias("b")).where("a <> b")
    # Saved, so that its size is known when the join is planned: it is small as a rule, and texts do not move then.
    shared = saved(shared.select("doc", F.lit(True).alias("is_shared")), "shared")
    rows = docs.select(as_row(docs), F.col("text").alias("text"), own, tie).join(shared, "doc", "left")
    return rows.select("row", "text", "doc", F.when(F.col("is_shared"), F.col("own_tie")).otherwise(F.lit(0).cast("long")).alias("tie"))


def _with_runs(docs: DataFrame, hot: int) -> DataFrame:
    """row, text, runs of starts to remove."""
    rows = _keyed(docs)
    starts = repeated_starts(rows.select("doc", F.coalesce("text", F.lit("")).alias("text"), "tie"), hot)
    runs = starts.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return rows.join(runs, ["doc", "tie"], "left").select("row", "text", "runs")


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hot).select(F.col("row.doc_id").alias("doc_id"), "text", "runs")
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(at: int):
    """Rows with the runs cut out of column number `at`, the text."""

    def cut(batches):
        for b in batches:
            texts = []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                if text is not None and runs:
                    data = text.encode("utf-8", "surrogatepass")
                    inside = lambda k, d=data: k < len(d) and d[k] & 0xC0 == 0x80
                    spans = []
                    for lo, hi in _removed(len(data), runs):
                        while inside(lo):
                            lo += 1
                        while inside(hi):
                            hi -= 1
                        spans.append((lo, hi))
                    text = _kept(data, spans).decode("utf-8", "surrogatepass")
                texts.append(text)
            row = b.column("row")
            cols = row.flatten()
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in row.type])

    return cut


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with repeated bytes taken out of text (whole characters only); same columns, every row stays."""
    return _with_runs(docs, hot).select("row", "text", "runs").mapInArrow(_cut(docs.columns.index("text")), docs.schema)
