"""Exact Jaccard join of documents on word shingles, as a join of regions of a metric space.

Links are pairs with 100 * intersection >= 90 * union; symmetric difference and Jaccard distance are metrics.

1. Equal sets collapse to the smallest doc_id (aggregation).
2. Regions of the whole. Jaccard distances of unrelated documents to any pivot are 1 or nearly so: a window of the
   triangle inequality round sampled pivots would replicate every document to every region. The first level therefore
   uses the symmetric difference. The empty set is its pivot: a document's distance to it is its size, and the triangle
   inequality leaves partners in the same annulus of sizes or the next one, so every document goes to two annuli. In an
   annulus a link differs in at most H shingles. Shingles are dealt into H + M parts by hash; H differences leave M
   parts equal, so partners share M regions (annulus, part, contents of that part). A document that has company in
   fewer regions of an annulus has no partner there and leaves; with it go those that only it kept company.
3. Documents that share a region are candidates; connected candidates form a group. In every group pivots far from
   each other are drawn. Documents within the join distance of a pivot are linked to it, and those of the largest
   component need no comparison with each other. Every other document lies in the Voronoi region of its nearest pivot, and all
   documents whose distances to that pivot and to their own nearest one differ by no more than twice the join distance
   are replicated to it. Regions are joined by new pivots again, until they are small or no longer shrink.
   A group of up to GATHER documents is joined in one task. A larger one is mostly held together by lines and passages
   that many documents have, and is first divided by regions of its own shingles: of n shingles a partner has at least
   n * PERCENT / 100, so it has one of the rarest n - n * PERCENT / 100 + 1, in whatever order rarity is counted (and
   shingles that no other document of a large group has don't count). Documents that share such a shingle, in one annulus,
   stay in one group. Of what is still large, the first level of pivots is a Spark join over slices of the group, and its
   regions are compared in blocks, so no task holds a group; blocks are dealt out to rounds, so that what is replicated
   for one round is no more than the group itself, or ROUND bytes.
4. Links give connected components.

Defined cases
* null text or no word: empty set, n_shingles 0, linked with nothing, component_id is the own doc_id.
* under 3 words: the whole sequence is one shingle. Very long texts are read whole.
* null doc_id: n_shingles is given, component_id null; it takes no part. Repeated rows: each is returned; rows that
  share a doc_id but not a text count as linked. Other columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chars import blocks
from .common import as_row, drop_saved, of_row, release, saved
from .graph import components

WORDS = 3
#: Least percentage of intersection in union.
PERCENT = 90
#: Documents of a group that one task joins; of a block; of a slice against a block; pivots; of a region that is not divided further.
#: A document counts for one for each TYPICAL shingles that it has, so that long ones don't fill a task.
GATHER = 1024
BLOCK = 256
SLICE = 1024
PIVOTS = 8
LEAF = 2
#: Bytes that may be replicated at once for regions of large groups, if the groups' own sets are not more.
ROUND = 1 << 28
#: Least number of parts that shingles of large groups are dealt to; there are more when a part would hold over BATCH bytes.
PARTS = 16
#: Of H + M parts, M is 2 and this share of H.
SPARE = 0.25
TYPICAL = 500
BATCH = 1 << 23
#: Longest word, in bytes, whose hash is a sum over its bytes.
SUMMED = 32
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_BYTES = _mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
_LOWER = bytes(range(256)).lower()


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.empty(max(n, 1 << 20), _U)
        held[0] = 1
        np.multiply.accumulate(np.full(len(held) - 1, base, _U), out=held[1:])
        _powers[name] = held
    return held[:n]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lower-cased), and the index of its text."""
    a = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if not len(a):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    sep = (a == 0x20) | (a - np.uint8(9) < 5)
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[a] * _power("r", _R, len(a)), dtype=_U)])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    w = _mix((sums[end] - sums[start]) * _power("i", _INV, len(a))[start] + (end - start).astype(_U) * _U(0x8CB92BA72F3D8DD7))
    # Sums of powers can't tell some long words apart, such as a word made by doubling and its complement.
    for k in np.flatnonzero(end - start > SUMMED).tolist():
        w[k] = xxhash.xxh3_64_intdigest(a[start[k] : end[k]])
    return w, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends), prepend=0))


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    w, doc = hashed_words(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    s = _join_words(w, width)
    out = []
    for k in range(len(texts)):
        lo, hi = cut[k], cut[k + 1]
        if hi - lo >= width:
            out.append(np.unique(s[lo : hi - width + 1]))
        elif hi > lo:
            h = _mix(np.array([hi - lo], _U))
            for x in w[lo:hi]:
                h = _mix(h * _U(3) + x)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def _join_words(w: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(w) - width + 1)
    s = np.full(n, width, _U)
    for j in range(width):
        s = _mix(s * _U(0xD6E8FEB86659FD93) + w[j : j + n])
    return s


def _annuli(percent: int) -> np.ndarray:
    """Least sizes of the annuli: partners are in the same one or in neighbours."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def _regions(sets: list[np.ndarray], percent: int, parity: int | None = None):
    """Of all annuli or of the even or odd ones: index of set, region, annulus (0 own, 1 next) and regions with company that a partner needs, by the parts of each set's two annuli."""
    low = _annuli(percent)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, _U)])
    row = np.repeat(np.arange(len(sets)), size)
    own = np.searchsorted(low, size, side="right") - 1
    out = []
    for shift in (0, 1):
        tag = own + shift
        # |x| + |y| < 2 * upper; D * (100 + percent) <= (|x| + |y|) * (100 - percent)
        most = 2 * (low[np.maximum(tag, 0) + 1] - 1) * (100 - percent) // (100 + percent)
        spare = 2 + (most * SPARE).astype(np.int64)
        parts = np.where((size > 0) & (most > 0) & ((tag & 1 == parity) if parity is not None else True), most + spare, 0)
        base = np.cumsum(parts) - parts
        use = parts[row] > 0
        h, r = flat[use], row[use]
        slot = base[r] + ((_mix(h + _U(0x51ED270B)) >> _U(20)) % parts[r].astype(_U)).astype(np.int64)
        total = int(parts.sum())
        lo = np.bincount(slot, (h & _U(0xFFFFFFFF)).astype(np.float64), total).astype(_U)
        hi = np.bincount(slot, (h >> _U(32)).astype(np.float64), total).astype(_U)
        n = np.bincount(slot, minlength=total)
        doc = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(total) - base[doc]
        key = _mix(_mix(lo + _U(0x9E3779B9)) * _U(0xD6E8FEB86659FD93) + hi + _mix((tag[doc] << 32 | part).astype(_U)))
        # Of `spare` parts that partners share, those that both have empty are not sent, unless there may be no others.
        empty = np.bincount(doc, n == 0, len(sets)).astype(np.int64)
        keep = (n > 0) | (empty >= spare)[doc]
        out.append((doc[keep], key[keep], np.full(int(keep.sum()), shift), np.maximum(1, spare - empty)[doc[keep]]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _batches(batches, most: int = BATCH):
    run, total = [], 0
    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            run.append((doc, data))
            total += len(data)
            if total >= most:
                yield run
                run, total = [], 0
    if run:
        yield run


def _with_sets(run, width):
    for part in blocks(run, lambda r: len(r[1]), 1 << 19):
        yield part, shingle_sets([r[1] for r in part], width)


def _digest(width):
    def digest(batches):
        for run in _batches(batches):
            for part, sets in _with_sets(run, width):
                size = np.array([len(s) for s in sets], np.int64)
                flat, row = np.concatenate([*sets, np.zeros(0, _U)]), np.repeat(np.arange(len(sets)), size)
                sums = [np.bincount(row, x.astype(np.float64), len(sets)).astype(_U) for h in (flat, _mix(flat)) for x in (h & _U(0xFFFFFFFF), h >> _U(32))]
                h1, h2 = _mix(sums[0] + _mix(sums[1] + _U(1))), _mix(sums[2] + _mix(sums[3] + _U(2)))
                yield pa.record_batch({"doc": pa.array([r[0] for r in part], pa.int64()), "n": pa.array(size), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64))})

    return digest


def _emit_regions(width, percent, parity):
    """region, doc, meta: part (11 bits; 0 for the first of a region in this batch), annulus, regions needed (20 bits), how often the region is here."""

    def emit(batches):
        for run in _batches(batches):
            run.sort(key=lambda r: r[0])
            seen, docs, keys, metas = set(), [], [], []
            for part, sets in _with_sets(run, width):
                fresh = []
                for k, s in enumerate(sets):
                    raw = s.tobytes()
                    if raw and raw not in seen:
                        seen.add(raw)
                        fresh.append(k)
                d, key, shift, need = _regions([sets[k] for k in fresh], percent, parity)
                docs.append(np.array([part[k][0] for k in fresh], np.int64)[d])
                keys.append(key)
                metas.append(shift << 11 | need << 12)
            doc, key, meta = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((docs, np.int64), (keys, _U), (metas, np.int64)))
            key = key.view(np.int64)
            _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            part = 1 + (doc & 1023)
            part[first] = 0
            yield pa.record_batch({"region": pa.array(key), "doc": pa.array(doc), "meta": pa.array(meta | part | count[which] << 32)})

    return emit


def _set_rows(width):
    def rows(batches):
        for b in batches:
            meta = list(zip(b.column("doc").to_pylist(), b.column("cluster").to_pylist(), b.column("large").to_pylist(), (t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()), strict=True))
            for part in blocks(meta, lambda r: len(r[3]), 1 << 19):
                sets = shingle_sets([r[3] for r in part], width)
                cols = [pa.array([r[1] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([r[2] for r in part], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["cluster", "doc", "shingles", "large"])

    return rows


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shared shingles."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(s or [np.zeros(0, _U)]), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    spots = []
    for flat, row in sides:
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        ok = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        spots.append((at[ok][order], row[ok][order]))
    step = 4096
    for k in range(0, len(shared), step):
        both = []
        for (at, row), n in zip(spots, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(at, [k, k + step])
            m = np.zeros((n, min(step, len(shared) - k)), np.float32)
            m[row[lo:hi], at[lo:hi] - k] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    inter = inter.astype(np.int64)
    return (inter > 0) & (100 * inter >= percent * (a[:, None] + b[None, :] - inter))


class _Links:
    """Smallest index reachable by the links so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = a[self.root[a] != self.root[b]], b[self.root[a] != self.root[b]]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root[x], self.root[y]
            if x != y:
                self.root[self.root == max(x, y)] = min(x, y)


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of the numbers of the shingles that several sets have, and the sizes of the whole sets: overlaps stay the same."""
    size = np.array([len(s) for s in sets], np.int64)
    _, at, n = np.unique(np.concatenate([*sets, np.zeros(0, _U)]), return_inverse=True, return_counts=True)
    kept = n > 1
    number = (np.cumsum(kept) - 1)[at]
    return [x[k] for x, k in zip(np.split(number, np.cumsum(size)[:-1]), np.split(kept[at], np.cumsum(size)[:-1]), strict=True)], size


def _far_apart(sets: list[np.ndarray], size: np.ndarray, percent: int):
    """Pivots (each the farthest from those before), distances of all to them, and who is within the join distance. sets: of numbers."""
    pivots, far, near = [], [], []
    nearest = np.full(len(sets), np.inf)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    held = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    k = 0
    while len(pivots) < PIVOTS:
        held[sets[k]] = True
        inter = np.bincount(row[held[flat]], minlength=len(sets))
        held[sets[k]] = False
        inter[k] = size[k]
        union = np.maximum(size + size[k] - inter, 1)
        pivots.append(k)
        far.append(1 - inter / union)
        near.append((inter > 0) & (100 * inter >= percent * union))
        nearest = np.minimum(nearest, far[-1])
        k = int(nearest.argmax())
        if nearest[k] == 0:
            break
    return pivots, np.stack(far, 1), np.stack(near, 1)


def _join_region(at: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, percent: int, links: _Links) -> None:
    """Add all links among the documents `at`, up to those that join what is joined already. sets, sizes: of _numbered."""
    own, size = [sets[k] for k in at], sizes[at]
    if len(at) <= LEAF:
        i, j = np.nonzero(_linked(_overlaps(own, own), size, size, percent))
        links.add(at[i], at[j])
        return
    pivots, far, near = _far_apart(own, size, percent)
    for c, p in enumerate(pivots):
        links.add(np.full(int(near[:, c].sum()), at[p]), at[near[:, c]])
    home = far.argmin(1)
    window = far <= far.min(1, keepdims=True) + 2 * (1 - percent / 100) + 1e-9
    # Those of one component need no comparison with each other: the largest may be left out, but no second one, as links
    # between two components that are both left out would be lost.
    _, first, count = np.unique(links.root[at], return_index=True, return_counts=True)
    main = at[first[count.argmax()]]
    for c in range(len(pivots)):
        mine, close = np.flatnonzero(home == c), np.flatnonzero(window[:, c])
        rest = mine[links.root[at[mine]] != links.root[main]]
        if not len(rest):
            continue
        if len(close) <= len(at) * 3 // 4:
            _join_region(at[close], sets, sizes, percent, links)
            continue
        for lo in range(0, len(rest), BLOCK):
            some = rest[lo : lo + BLOCK]
            i, j = np.nonzero(_linked(_overlaps([own[k] for k in some], [own[k] for k in close]), size[some], size[close], percent))
            links.add(at[some[i]], at[close[j]])


def _pairs_of_cluster(sets: list[np.ndarray], percent: int) -> list[int]:
    """Smallest index reachable by links, for each set."""
    links = _Links(len(sets))
    _join_region(np.arange(len(sets)), *_numbered(sets), percent, links)
    return links.root.tolist()


def _compare_clusters(percent):
    """Input sorted by cluster: doc, label of each document of whole clusters."""

    def flush(cluster, docs, raws):
        sets = [np.frombuffer(r, _U) for r in raws]
        label = _pairs_of_cluster(sets, percent) if len(docs) > 1 else [0]
        return [(d, docs[k]) for d, k in zip(docs, label, strict=True)]

    def run(batches):
        now, docs, raws, out = None, [], [], []
        for b in batches:
            for c, d, r in zip(b.column("cluster").to_pylist(), b.column("doc").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                if c != now and docs:
                    out += flush(now, docs, raws)
                    docs, raws = [], []
                now = c
                if not docs or docs[-1] != d:
                    docs.append(d)
                    raws.append(r)
            if len(out) > 10_000:
                yield pa.record_batch({"node": pa.array([x[0] for x in out], pa.int64()), "label": pa.array([x[1] for x in out], pa.int64())})
                out = []
        if docs:
            out += flush(now, docs, raws)
        yield pa.record_batch({"node": pa.array([x[0] for x in out], pa.int64()), "label": pa.array([x[1] for x in out], pa.int64())})

    return run


def _dealt(docs: np.ndarray, sizes: np.ndarray, flat: np.ndarray, row: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, doc, n, shingles: those of documents (flat, which row's), dealt out by hash."""
    part = (_mix(flat + _U(0x2545F491)) % _U(parts)).astype(np.int64)
    order = np.lexsort((row, part))
    part, row = part[order], row[order]
    first = np.flatnonzero(np.diff(part * len(docs) + row, prepend=-1))
    ends = np.append(first, len(flat)).astype(np.int32) * 8
    raws = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(docs[row[first]]), pa.array(sizes[row[first]]), raws], ["part", "doc", "n", "shingles"])


def _flat(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of raw arrays, and whose they are."""
    raws = table.column(column).to_pylist()
    flat = np.frombuffer(b"".join(raws), kind)
    return flat, np.repeat(np.arange(len(raws)), [len(x) // flat.itemsize for x in raws])


def _deal_sets(parts):
    def deal(batches):
        for b in batches:
            for some in blocks(list(zip(b.column("doc").to_pylist(), b.column("shingles").to_pylist(), strict=True)), lambda r: len(r[1]), BATCH):
                size = np.array([len(r[1]) // 8 for r in some], np.int64)
                yield _dealt(np.array([r[0] for r in some], np.int64), size, np.frombuffer(b"".join(r[1] for r in some), _U), np.repeat(np.arange(len(some)), size), parts)

    return deal


def _shared(table: pa.Table) -> pa.Table:
    """A part of all shingles: doc, n, those that another document has, too, and how many have them."""
    flat, row = _flat(table, "shingles", _U)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    kept = n[at] > 1
    cut = np.searchsorted(row[kept], np.arange(table.num_rows + 1))
    some = np.flatnonzero(np.diff(cut))
    flat, held = flat[kept], n[at][kept].astype(np.int32)
    raws = [[x[cut[k] : cut[k + 1]].tobytes() for k in some.tolist()] for x in (flat, held)]
    return pa.table({"doc": table.column("doc").take(some), "n": table.column("n").take(some), "shingles": pa.array(raws[0], pa.binary()), "held": pa.array(raws[1], pa.binary())})


def _whole(batches):
    """Input sorted by doc: each document, its size, its shared shingles and how many have them."""
    now, own = None, []
    for b in batches:
        for doc, n, *raws in zip(*(b.column(c).to_pylist() for c in ("doc", "n", "shingles", "held")), strict=True):
            if own and doc != now[0]:
                yield *now, *(b"".join(x) for x in zip(*own, strict=True))
                own = []
            now = doc, n
            own.append(raws)
    if own:
        yield *now, *(b"".join(x) for x in zip(*own, strict=True))


def _rarest(percent, parts):
    """Input sorted by doc: of each document that can have a partner the rarest shared shingles, one of which the partner has, too."""

    def flush(docs, sizes, found):
        return _dealt(np.array(docs), np.array(sizes), np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found]), parts)

    def run(batches):
        docs, sizes, found, total = [], [], [], 0
        for doc, n, raw, held in _whole(batches):
            flat = np.frombuffer(raw, _U)
            few = len(flat) - max(1, -(-percent * n // 100)) + 1
            if few > 0:
                docs.append(doc)
                sizes.append(n)
                found.append(flat[np.lexsort((flat, np.frombuffer(held, np.int32)))[:few]])
                total += few
            if total >= BATCH // 8:
                yield flush(docs, sizes, found)
                docs, sizes, found, total = [], [], [], 0
        if docs:
            yield flush(docs, sizes, found)

    return run


def _tied(percent):
    """A part of the rarest shingles: documents (b) that share one with others of an annulus, and the first (a) of those that hang together."""

    def run(table):
        table = table.sort_by("doc")  # so that the first is the smallest, as it is in most parts, which saves rounds of components
        docs = table.column("doc").to_numpy()
        flat, row = _flat(table, "shingles", _U)
        own = np.searchsorted(_annuli(percent), table.column("n").to_numpy(), side="right")[row]
        key = np.concatenate([_mix(flat + (own + shift).astype(_U) * _U(_R)) for shift in (0, 1)])
        order = np.argsort(key, kind="stable")
        key, row = key[order], np.concatenate([row, row])[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        count = np.diff(np.append(first, len(key)))
        row, count = row[np.repeat(count > 1, count)], count[count > 1]
        first, label = np.cumsum(count) - count, np.arange(len(docs))
        while len(row):  # each round hands the smallest number to all that share a shingle, until none changes
            low = label.copy()
            np.minimum.at(low, row, np.repeat(np.minimum.reduceat(label[row], first), count))
            low = low[low]
            if (low == label).all():
                break
            label = low
        met = np.flatnonzero(label != np.arange(len(docs)))
        return pa.table({"a": pa.array(docs[label[met]], pa.int64()), "b": pa.array(docs[met], pa.int64())})

    return run


def _divided(sets: DataFrame, percent: int) -> DataFrame:
    """node, label of documents that share one of their rarest shingles with another, by what hangs together. sets: doc (distinct), shingles."""
    parts = max(PARTS, math.ceil((sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) / BATCH))
    kind = "part int, doc long, n long, shingles binary"
    shared = sets.mapInArrow(_deal_sets(parts), kind).groupBy("part").applyInArrow(_shared, "doc long, n long, shingles binary, held binary")
    shared = saved(shared, "shared")
    release(sets.sparkSession)
    rarest = saved(shared.repartition("doc").sortWithinPartitions("doc").mapInArrow(_rarest(percent, parts), kind), "rarest")
    drop_saved(shared)
    release(sets.sparkSession)
    links = saved(rarest.groupBy("part").applyInArrow(_tied(percent), "a long, b long"), "links")
    drop_saved(rarest)
    out = components(links)
    drop_saved(links)
    return out


def _near_pivots(percent):
    """Distances of the documents of a slice to the cluster's pivots, their component, and the first pivot of each component they link to.

    Pivots stand in the slices, too: each is tied to the first of its own component, so one link to that one says as much as
    links to all, and the number of links grows with the documents and not with documents times pivots.
    """

    def run(key, left, right):
        right = right.sort_by("r")
        names = right.column("doc").to_pylist()
        piv = [np.frombuffer(x, _U) for x in right.column("shingles").to_pylist()]
        docs, raws = left.column("doc").to_pylist(), left.column("shingles").to_pylist()
        sets = [np.frombuffer(x, _U) for x in raws]
        a, z = np.array([len(s) for s in sets], np.int64), np.array([len(s) for s in piv], np.int64)
        inter = _overlaps(sets, piv)
        far = 1 - inter / np.maximum(a[:, None] + z[None, :] - inter, 1)
        link = _linked(inter, a, z, percent)
        group = np.array(_pairs_of_cluster(piv, percent) if len(piv) > 1 else [0])
        own = np.where(link.any(1), group[link.argmax(1)], -1)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int64())]
        cols = [left.column("cluster").to_pylist(), docs, raws, far.tolist(), own.tolist(), [[names[g] for g in np.unique(group[row])] for row in link]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["cluster", "doc", "shingles", "far", "own", "links"])

    return run


def _against_block(percent):
    """Links between a slice of documents and a block: one for each document of a component and its first, not all pairs."""

    def run(key, left, right):
        sides = [t.column("doc").to_numpy() for t in (left, right)]
        sets = [[np.frombuffer(x, _U) for x in t.column("shingles").to_pylist()] for t in (left, right)]
        if not sets[0] or not sets[1]:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        hit = _linked(_overlaps(*sets), *(np.array([len(s) for s in side], np.int64) for side in sets), percent)
        ids, met = np.concatenate(sides), hit.any(1)
        label = np.full(len(ids), len(ids))
        label[: len(met)][met] = np.flatnonzero(met)
        while True:  # each round hands the smallest number over every link, until none changes
            before = label.copy()
            top, low = label[: len(met)], label[len(met) :]
            low[:] = np.minimum(low, np.where(hit, top[:, None], len(ids)).min(0))
            top[:] = np.minimum(top, np.where(hit, low[None, :], len(ids)).min(1))
            if (label == before).all():
                break
        own = label < len(ids)
        return pa.table({"a": pa.array(ids[own]), "b": pa.array(ids[label[own]])})

    return run


def _slice(n: Column) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(5)), F.ceil(n / SLICE)).cast("int")


def _renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _join_large(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the documents of clusters over GATHER. sets: cluster, doc, shingles; nodes: cluster, doc, weight, size."""
    slices = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / SLICE).cast("int") - 1)).alias("s")
    best = Window.partitionBy("cluster").orderBy(F.desc("weight"), "doc")
    chosen = nodes.withColumn("r", F.row_number().over(best)).where(F.col("r") <= PIVOTS).select("cluster", "doc", "r", "size")
    pivots = sets.join(chosen, ["cluster", "doc"]).select("cluster", "doc", "shingles", "r", slices)
    # Sizes, components and regions are tables of their own, so that Spark can split a group that very many documents have.
    sizes = saved(nodes.groupBy("cluster").agg(F.first("size").alias("size")), "sizes")
    mine = sets.join(sizes, "cluster").withColumn("s", _slice(F.col("size")))
    kind = "cluster long, doc long, shingles binary, far array<double>, own int, links array<long>"
    near = met = saved(mine.groupBy("cluster", "s").cogroup(_renewed(pivots).groupBy("cluster", "s")).applyInArrow(_near_pivots(percent), kind), "near")
    links = near.select(F.col("doc").alias("a"), F.explode("links").alias("b"))
    count = near.groupBy("cluster", "own").agg(F.count(F.lit(1)).alias("n"))
    main = saved(count.groupBy("cluster").agg(
        F.max_by(F.when(F.col("own") >= 0, F.col("own")), F.when(F.col("own") >= 0, F.struct("n", -F.col("own")))).alias("main"),
        (F.sum("n") - F.coalesce(F.max(F.when(F.col("own") >= 0, F.col("n"))), F.lit(0))).alias("left_over"),
    ), "main")
    # No more regions than blocks are needed: the first pivots that many serve.
    used = F.slice("far", 1, F.greatest(F.lit(1), F.least(F.size("far"), F.ceil(F.col("left_over") / BLOCK).cast("int"))))
    near = near.join(main, "cluster").withColumn("far", used)
    region = (F.array_position("far", F.array_min("far")) - 1).cast("int")
    rest = near.where("own < 0 OR main IS NULL OR own <> main").select("cluster", "doc", "shingles", region.alias("region"))
    held = saved(rest.groupBy("cluster", "region").agg(F.ceil(F.sum(F.greatest(F.lit(1.0), F.octet_length("shingles") / (8 * TYPICAL)))).alias("rest")), "held")
    window = 2 * (1 - percent / 100) + 1e-9
    close = F.filter(F.transform("far", lambda d, i: F.when(d - F.array_min("far") <= window, i.cast("int"))), lambda i: i.isNotNull())
    spread = near.select("cluster", "doc", "shingles", F.explode(close).alias("region")).join(held, ["cluster", "region"]).join(sizes, "cluster")
    numbers = F.sequence(F.lit(0), F.ceil(F.col("rest") / BLOCK).cast("int") - 1)
    right = rest.join(held, ["cluster", "region"]).join(sizes, "cluster")
    length = lambda df, times: df.agg(F.sum(F.octet_length("shingles") * times)).first()[0] or 0
    moved = length(spread, F.ceil(F.col("rest") / BLOCK)) + length(right, F.ceil(F.col("size") / SLICE))
    rounds = max(1, math.ceil(moved / max(ROUND, length(sets, F.lit(1)))))
    keys, found = ["cluster", "region", "k", "s"], [saved(links.where("a <> b"), "links")]
    for now in range(rounds):
        in_turn = lambda k, now=now: F.pmod(F.xxhash64("cluster", "region", k, F.lit(7)), F.lit(rounds)) == now
        left = spread.select("cluster", "region", "doc", "shingles", _slice(F.col("size")).alias("s"), F.explode(F.filter(numbers, lambda k: in_turn(k))).alias("k"))
        block = right.withColumn("k", F.pmod(F.xxhash64("doc"), F.ceil(F.col("rest") / BLOCK)).cast("int")).where(in_turn(F.col("k")))
        block = _renewed(block.select("cluster", "region", "doc", "shingles", "k", slices))
        pairs = left.groupBy(*keys).cogroup(block.groupBy(*keys)).applyInArrow(_against_block(percent), "a long, b long")
        found.append(saved(pairs.where("a <> b"), "links"))
        release(sets.sparkSession)
    for done in (sizes, met, main, held):
        drop_saved(done)
    return sets.sparkSession.read.schema("a long, b long").parquet(*[x._scratch_path for x in found])


def _collapsed(docs: DataFrame, width: int) -> DataFrame:
    """doc, n, lead (smallest doc with an equal set)."""
    sizes = saved(docs.mapInArrow(_digest(width), "doc long, n long, h1 long, h2 long"), "sizes")
    same = sizes.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    # A table of its own, so that Spark can split a set that very many documents have.
    same = saved(same, "same")
    out = saved(sizes.join(same, ["h1", "h2", "n"], "left").select("doc", "n", F.coalesce("lead", "doc").alias("lead")), "classes")
    drop_saved(sizes)
    drop_saved(same)
    return out


def _with_company(rows: DataFrame) -> DataFrame:
    """rows (region, ...) of regions that at least two rows have, and the smallest doc of the region as lead."""
    several = rows.groupBy("region").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    several = saved(several, "several")
    out = saved(rows.join(several, "region"), "company")
    drop_saved(several)
    return out


def candidates(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """lead, doc of documents that share a region and have enough company for a partner; equal sets are left out."""
    one = saved(classes.where("doc = lead").select("doc").distinct(), "one")
    halves = []
    # Even annuli, then odd ones: a document is in one of each, so half of the regions are on disk at a time.
    for parity in (0, 1):
        regions = docs.mapInArrow(_emit_regions(width, percent, parity), "region long, doc long, meta long").withColumn("part", F.col("meta").bitwiseAND(F.lit(2047)))
        # The first of a region in each batch meets the others'; the rest of a batch has company there, and is spread out.
        met = regions.withColumn("total", F.expr("sum(shiftright(meta, 32)) OVER (PARTITION BY region, part)"))
        met = saved(met.where("part > 0 OR total > 1").select("region", "doc", F.shiftright("meta", 11).bitwiseAND(F.lit(1)).cast("int").alias("shift"), F.shiftright("meta", 12).bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("need")), "met")
        release(docs.sparkSession)
        halves.append(_with_company(met.join(one, "doc")))
        drop_saved(met)
        release(docs.sparkSession)
    drop_saved(one)
    found = halves[0].unionAll(halves[1])
    enough = found.groupBy("doc", "shift").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need").select("doc", "shift")
    left = _with_company(found.select("region", "doc", "shift").join(enough, ["doc", "shift"]).select("region", "doc"))
    for half in halves:
        drop_saved(half)
    release(docs.sparkSession)
    return left


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the documents of clusters that one task joins. sets: cluster, doc, shingles."""
    near = sets.select("cluster", "doc", "shingles").repartition("cluster").sortWithinPartitions("cluster", "doc")
    return near.mapInArrow(_compare_clusters(percent), "node long, label long").select(F.col("node").alias("a"), F.col("label").alias("b"))


def near_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, gather: int = GATHER) -> DataFrame:
    """doc, n, component of every distinct doc. docs: doc (long, not null), text (not null)."""
    spark = docs.sparkSession
    classes = _collapsed(docs, width)
    left = candidates(docs, classes, width, percent)
    group = components(left.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
    weight = left.groupBy("doc").agg(F.count(F.lit(1)).alias("weight"))
    units = classes.where("doc = lead").groupBy("doc").agg(F.greatest(F.lit(1.0), F.max("n") / TYPICAL).alias("units"))
    grouped = saved(group.select(F.col("node").alias("doc"), F.col("label").alias("cluster")).join(weight, "doc").join(units, "doc"), "nodes")
    sizes = saved(grouped.groupBy("cluster").agg(F.ceil(F.sum("units")).alias("size")), "groups")
    nodes = grouped.join(sizes, "cluster")
    release(spark)
    # The list of documents grows with the table: texts meet it by shuffle at every size, once for groups of all sizes.
    listed = nodes.select("doc", "cluster", (F.col("size") > gather).alias("large")).hint("merge")
    rows = docs.join(listed, "doc").select("doc", "cluster", "large", "text").mapInArrow(_set_rows(width), "cluster long, doc long, shingles binary, large boolean")
    rows = saved(rows, "sets")
    release(spark)
    links, scratch = _compared(rows.where("NOT large"), percent), [left, grouped, sizes, rows]
    if rows.where("large").limit(1).count():
        sets = saved(rows.where("large").select("doc", "shingles").dropDuplicates(["doc"]), "large")
        release(spark)
        finer = _divided(sets, percent).select(F.col("node").alias("doc"), F.col("label").alias("cluster"))
        finer = saved(finer.join(grouped.drop("cluster"), "doc"), "nodes")
        counts = saved(finer.groupBy("cluster").agg(F.ceil(F.sum("units")).alias("size")), "groups")
        large = finer.join(counts, "cluster")
        parted = saved(sets.join(large.select("doc", "cluster", (F.col("size") > gather).alias("large")), "doc"), "sets")
        drop_saved(sets)
        release(spark)
        links, large = links.unionAll(_compared(parted.where("NOT large"), percent)), large.where(F.col("size") > gather)
        if large.limit(1).count():
            links = links.unionAll(_join_large(parted.where("large").select("cluster", "doc", "shingles"), large, percent))
        scratch += [finer, counts, parted]
    labels = components(links.where("a <> b"))
    release(spark)
    for done in scratch:
        drop_saved(done)
    out = classes.join(labels, classes.lead == labels.node, "left").select("doc", "n", F.coalesce("label", "lead").alias("component"))
    return out.groupBy("doc").agg(F.max("n").alias("n"), F.min("component").alias("component"))


def ngram_join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, gather: int = GATHER) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = near_components(own.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text"), width, percent, gather)
    known = own.where("doc_id IS NOT NULL").select("doc_id").join(found, F.col("doc_id") == F.col("doc")).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    nameless = own.where("doc_id IS NULL").select(F.lit(0).cast("long").alias("doc"), "text").mapInArrow(_digest(width), "doc long, n long, h1 long, h2 long")
    return known.unionAll(nameless.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, gather: int = GATHER) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (null doc_ids stay); same columns."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    gone = near_components(rows, width, percent, gather).where("component < doc").select("doc")
    return docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc")).join(gone, "doc", "left_anti").select(*of_row(docs))


#: The same rows by DuckDB, from all pairs that share a shingle: for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * i >= 90 * (a.n + b.n - i)),
c(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, c.m FROM c JOIN l ON c.doc_id = l.x WHERE c.m < l.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM c WHERE c.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
