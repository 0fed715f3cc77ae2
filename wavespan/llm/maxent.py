"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history). Words fall into classes by counts over all training
documents. The HEAD most frequent words form classes of IN_CLASS words of one group (which of a few clusters of frequent
words a word most often follows); the others share a class with those of their group and frequency band. Both factors
are log-linear models over hashed features of the history: the last word, the last two, the one before the last (skip),
and the last frequent word at any distance (skip). The second is a softmax over the words of a head class, with features
hashed together with the class. A class of rarer words has no bound, so its words are the leaves of a binary tree, in the
order of their counts: p(word | class, history) is the product of the decisions on the way to the word, each logistic over
the node, it and the last word, and it and the last frequent word, on top of the log odds that counts give to the two sides.
Words seen once stand for unseen ones: they share a class, of which Good-Turing gives the unseen words their part, in
equal shares for as many as are estimated to exist (Chao); the words seen once share the rest by a tree.

Weights are trained by distributed gradient updates: in each of ROUNDS rounds every partition starts from the shared
weights, makes its updates on every position of another part of its training texts, and the results are averaged; after
all rounds every position was used once. Texts are scored in sparse numpy batches.

Texts are cut into words once, into parts: distinct words, and tokens as places among them. Counts meet texts without
moving single tokens: packets of parts (bounded in bytes) send their distinct words once; these meet their places in the
order of all words, which say count, class and place in it, and return to the packet's parts.

Defined cases
* null or empty text: the end token alone. Null doc_id: fold 0, so a training document.
* no training token: N = V = 0, score equals base_score. Repeated rows: each is scored, and counts.
* words are told apart by 64-bit hashes. Other columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, fold, release, saved
from .ngramjoin import _mix, hashed_words

_U = np.uint64
END = np.int64(0x7E5D0C0DE)
#: Frequent words; clusters; bands of rarer words by count; head words and how many of them a class holds.
FREQUENT = 64
GROUPS = 6
BAND_COUNTS = np.array([4, 24])
BANDS = len(BAND_COUNTS) + 1
HEAD = 1024
IN_CLASS = 64
#: Classes: seen once or not at all, end, rarer words, head words (a group may leave its last class part empty).
FIRST_HEAD = 2 + GROUPS * BANDS
CLASSES = FIRST_HEAD + HEAD // IN_CLASS + GROUPS
#: Hashed features have 2**BITS rows of weights at most, and as many as there are distinct words.
BITS = (10, 14)
FEATURES = 5
ROUNDS = 4
STEP = 4096
#: Bytes of texts that share a dictionary, and of a part, at most; a longer text is alone.
PACKET, PART = 1 << 24, 1 << 20
#: A word that is less than 1 / SHARE of a part's tokens isn't named when candidates for frequent words are gathered.
SHARE = 8192
#: Trees of rarer words: weights as a power of 2, levels whose log odds come from counts (below, from numbers of words), tokens of an update.
TREE_BITS, TOP = 18, 12
TREE_STEP = 4 * STEP
ZSTD = pa.Codec("zstd", 1)


def _tokens(texts: list[bytes]):
    """Word hashes with an end token after each text, the text of each token, and where texts start."""
    w, doc = hashed_words(texts)
    n = np.bincount(doc, minlength=len(texts)) + 1
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
    out[np.arange(len(w)) + doc] = w.view(np.int64)
    out[stop - 1] = END
    return out, np.repeat(np.arange(len(texts)), n), stop - n


def _last(at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The last frequent word before each token in its text, FREQUENT if none; at: the frequent word that each token is, FREQUENT if none."""
    where = np.maximum.accumulate(np.where(at < FREQUENT, np.arange(len(at)), -1))
    before = np.concatenate([[-1], where[:-1]])
    return np.where(before >= start[doc], at[np.maximum(before, 0)], FREQUENT)


def _last_frequent(w: np.ndarray, doc: np.ndarray, start: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index of the last frequent word before each token in its text; FREQUENT if none."""
    return _last(_among(frequent, w), doc, start)


def _among(frequent: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which frequent word each of u is; FREQUENT if none."""
    if not len(frequent):
        return np.full(len(u), FREQUENT)
    at = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
    return np.where(frequent[at] == u, at, FREQUENT)


def _cluster(m: np.ndarray) -> np.ndarray:
    """Cluster of each frequent word by what follows it (m: how often one is the last before another)."""
    if not len(m):
        return np.zeros(FREQUENT + 1, np.int64)
    m = m + m.T + 1e-3
    x = np.sqrt(m / m.sum(1, keepdims=True))
    centre = [int(m.sum(1).argmax())]
    while len(centre) < min(GROUPS, len(x)):
        centre.append(int(np.min([((x - x[c]) ** 2).sum(1) for c in centre], axis=0).argmax()))
    c = x[centre]
    for _ in range(20):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return np.concatenate([own, np.zeros(FREQUENT + 1 - len(own), np.int64)])


def _rows(batches, *names):
    """Rows one by one, as a part of texts is large."""
    for b in batches:
        for k in range(b.num_rows):
            yield tuple(b.column(n)[k].as_py() for n in names)
        del b
        pa.default_memory_pool().release_unused()


PARTS = "packet long, turn int, docs array<long>, held_out boolean, u binary, i binary"


def _parts(batches):
    """Parts of PART bytes at most, learnt from or held out: distinct words (u), tokens as places among them (i)."""
    task, total, made = TaskContext.get().partitionId(), 0, 0
    runs, sizes = {False: [], True: []}, {False: 0, True: 0}

    def part(out):
        nonlocal total, made
        w, _, _ = _tokens([r[0] for r in runs[out]])
        u, at = np.unique(w, return_inverse=True)
        cols = [task << 32 | total // PACKET, -1 if out else (task + made) % ROUNDS, [r[1] for r in runs[out]], out, *_packed(u, at)]
        total, made = total + sizes[out], made + (not out)
        runs[out], sizes[out] = [], 0
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    for data, doc, out in _rows(batches, "text", "doc_id", "held_out"):
        data = data or b""
        if runs[out] and sizes[out] + len(data) > PART:
            yield part(out)
        runs[out].append((data, doc))
        sizes[out] += len(data)
    for out in runs:
        if runs[out]:
            yield part(out)


def _packed(u: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct words as compressed planes of bytes of their differences, and tokens compressed; numbers of bytes ahead."""
    step = np.diff(u.view(_U), prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = at.astype("<u2" if len(u) <= 1 << 16 else "<u4").tobytes()
    return tuple(len(x).to_bytes(8, "little") + ZSTD.compress(x, asbytes=True) for x in (step, raw))


def _unpacked(x: bytes) -> bytes:
    return ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)


def _words_of(u: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(_unpacked(u), np.uint8).reshape(8, -1).T).view(_U).ravel(), dtype=_U).view(np.int64)


def _opened(u: bytes, i: bytes):
    """Distinct words, tokens as places among them, text of each token, and start of texts."""
    u = _words_of(u)
    at = np.frombuffer(_unpacked(i), "<u2" if len(u) <= 1 << 16 else "<u4")
    return u, at, *_ends(at, np.searchsorted(u, END))


def _ends(at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each token, and start of texts, each of which has an end."""
    stop = np.flatnonzero(at == end) + 1
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    return np.repeat(np.arange(len(stop)), stop - start), start


def _count_some(share: int | None, among: np.ndarray | None = None):
    """h, c, missed: of each part the words that are 1 / share of it or more (all, if None), or those among some; by how much others may be more."""

    def run(batches):
        for raw in _rows(batches, "u", "i"):
            u, at, _, _ = _opened(*raw)
            c = np.bincount(at, minlength=len(u))
            least = max(1, len(at) // share) if share else 1
            keep = np.flatnonzero((np.isin(u, among) if among is not None else c >= least) & (u != END))
            missed = np.zeros(len(keep) + 1, np.int64)
            missed[-1] = least - 1
            yield pa.record_batch({"h": pa.array(np.append(u[keep], END)), "c": pa.array(np.append(c[keep], 0)), "missed": pa.array(missed)})

    return run


def _most_frequent(parts: DataFrame, n: int = FREQUENT) -> list[int]:
    """The n most frequent words, exactly. Words that are rare in every part can't be among them, which is checked."""

    def first(k, *how):
        got = parts.select("u", "i").mapInArrow(_count_some(*how), "h long, c long, missed long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("missed").alias("missed"))
        top = got.orderBy(F.col("h") != int(END), F.desc("c"), "h").limit(k + 1).collect()
        return top[1:], top[0]["missed"] if top else 0

    some, missed = first(SHARE, SHARE)
    least = some[n - 1]["c"] if len(some) >= n else 0
    near = [r["h"] for r in some if r["c"] >= least - missed]
    if missed and least > 2 * missed and len(near) < SHARE:
        some, _ = first(n, None, np.array(near, np.int64))
    elif missed:
        some, _ = first(n, None)
    return [r["h"] for r in some[:n]]


def _count_pairs(held):
    """k, n: how often frequent word k // FREQUENT is the last one before frequent word k % FREQUENT, by task."""

    def run(batches):
        frequent, m = held.value, np.zeros(FREQUENT * FREQUENT, np.int64)
        for raw in _rows(batches, "u", "i"):
            u, i, doc, start = _opened(*raw)
            at = _among(frequent, u)[i]
            last = _last(at, doc, start)
            both = (at < FREQUENT) & (last < FREQUENT)
            m += np.bincount(last[both] * FREQUENT + at[both], minlength=len(m))
        k = np.flatnonzero(m)
        yield pa.record_batch({"k": pa.array(k), "n": pa.array(m[k])})

    return run


def frequent_words(learn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent words of all texts or parts of them (sorted), and the cluster of each."""
    spark = learn.sparkSession
    if "text" in learn.columns:
        learn = learn.select(F.col("text").cast("binary").alias("text"), F.lit(0).alias("doc_id"), F.lit(False).alias("held_out")).mapInArrow(_parts, PARTS)
    frequent = np.sort(np.array(_most_frequent(learn), np.int64))
    m = np.zeros((FREQUENT, FREQUENT))
    if len(frequent):
        pairs = learn.select("u", "i").mapInArrow(_count_pairs(spark.sparkContext.broadcast(frequent)), "k long, n long")
        for r in pairs.groupBy("k").agg(F.sum("n").alias("n")).collect():
            m[r["k"] // FREQUENT, r["k"] % FREQUENT] = r["n"]
    return frequent, _cluster(m[: len(frequent), : len(frequent)])


def _count_words(held):
    """h, g, n: how often each word follows each cluster (GROUPS: none), summed in packets."""

    def added(hs, gs, ns):
        h, g, n = np.concatenate(hs), np.concatenate(gs), np.concatenate(ns)
        order = np.argsort(h * np.int64(2 * GROUPS + 1) + g)
        x, y = h[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        at = order[first]
        return pa.record_batch({"h": pa.array(h[at]), "g": pa.array(g[at].astype(np.int32)), "n": pa.array(np.add.reduceat(n[order], first, dtype=np.int64))})

    def run(batches):
        frequent, cluster = held.value
        of, got, total = np.append(cluster[:FREQUENT], GROUPS), [], 0
        for raw in _rows(batches, "u", "i"):
            u, i, doc, start = _opened(*raw)
            g = of[_last(_among(frequent, u)[i], doc, start)]
            n = np.bincount(i.astype(np.int64) * (GROUPS + 1) + g)
            k = np.flatnonzero(n)
            got.append((u[k // (GROUPS + 1)], (k % (GROUPS + 1)).astype(np.int8), n[k].astype(np.int32)))
            total += len(k)
            if total >= 1 << 20:
                yield added(*zip(*got, strict=True))
                got, total = [], 0
        if got:
            yield added(*zip(*got, strict=True))

    return run


def _distinct_words(batches):
    """packet, h: the distinct words of each packet; a packet that two tasks read names a word twice."""
    now, found = None, []
    for packet, u in _rows(batches, "packet", "u"):
        if found and packet != now:
            h = np.unique(np.concatenate(found))
            yield pa.record_batch({"packet": pa.array(np.full(len(h), now)), "h": pa.array(h)})
            found = []
        now = packet
        found.append(_words_of(u))
    if found:
        h = np.unique(np.concatenate(found))
        yield pa.record_batch({"packet": pa.array(np.full(len(h), now)), "h": pa.array(h)})


def _in_order(batches):
    """h, task, k: the words of a task, which are in order, by number."""
    task, k = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.record_batch({"h": b.column("h"), "task": pa.array(np.full(n, task, np.int32)), "k": pa.array(np.arange(k, k + n))})
        k += n


def _features(w: np.ndarray, doc: np.ndarray, start: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
    """Rows of weights of each token's history (tokens x FEATURES)."""
    x = w.view(_U)
    at = np.arange(len(w))
    back = [np.where(at - k >= start[doc], np.concatenate([np.zeros(k, _U), x[:-k]])[: len(x)], _U(k)) for k in (1, 2)]
    named = [back[0], back[1] * _U(3), _mix(back[0]) * _U(5) + back[1], last.astype(_U) + _U(11)]
    out = np.zeros((len(w), FEATURES), np.int32)
    for k, v in enumerate(named):
        out[:, k + 1] = 1 + (_mix(_mix(v) + _U(k + 1)) % _U((1 << bits) - 1)).astype(np.int32)
    return out


def _word_features(x: np.ndarray, kind: np.ndarray, bits: int) -> np.ndarray:
    """Rows of weights within a head class: the class, it and the last word, it and the last frequent word."""
    own = kind.astype(np.int64)
    out = np.empty((len(kind), 3), np.int32)
    out[:, 0] = own - FIRST_HEAD
    for k, f in ((1, 1), (2, 4)):
        h = _mix(x[:, f].astype(_U) * _U(CLASSES) + own.astype(_U) + _U(f << 40))
        out[:, k] = CLASSES + (h % _U((1 << bits) - CLASSES)).astype(np.int32)
    return out


class Counts:
    """What classes hold, over all training documents."""

    def __init__(self, total: int, kinds: int, once: int, twice: int, mass: np.ndarray):
        self.total, self.kinds, self.mass, self.once = total, kinds, mass, once
        self.unseen = (once + 1) / (once + 2 * twice + 2)
        #: Words that exist and were not seen, by Chao's estimate.
        self.missing = max(1.0, once * (once - 1) / (2 * (twice + 1)))
        #: Rows of weights, as a power of 2.
        self.bits = int(min(BITS[1], max(BITS[0], np.ceil(np.log2(max(kinds, 2))))))


class Places(Counts):
    """Counts with the order of all words, from the number n of words of each class y and count c.

    A word's place is its number in the order of class, falling count and hash.
    """

    def __init__(self, y: np.ndarray, c: np.ndarray, n: np.ndarray):
        order = np.lexsort((-c, y))
        y, c, n = (np.asarray(v, np.int64)[order] for v in (y, c, n))
        once, twice = (int(n[(y != 1) & (c == k)].sum()) for k in (1, 2))
        super().__init__(int((c * n).sum()), int(n.sum()), once, twice, np.bincount(y, c * n, CLASSES))
        #: Words of each class, its first place, and the levels of its tree (none, if it has a softmax or one word).
        self.size = np.bincount(y, n, CLASSES).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.depth = np.array([0 if k == 1 or k >= FIRST_HEAD else int(max(m - 1, 0)).bit_length() for k, m in enumerate(self.size)])
        #: Places at which a run of words of one count ends, and that count.
        self.ends, self.count = np.cumsum(n), c
        self.place = "<i4" if self.kinds < 1 << 31 else "<i8"
        #: Log odds of the second side of the nodes of the top levels, at 2**level + node.
        self.odds = np.zeros(FIRST_HEAD << TOP, np.float32)
        for k in np.flatnonzero(self.depth):
            for level in range(min(TOP, int(self.depth[k]))):
                edge = np.minimum(np.arange((2 << level) + 1) << int(self.depth[k] - level - 1), self.size[k]) + self.first[k]
                mass = np.diff(self._before(edge))
                both = (mass[::2] > 0) & (mass[1::2] > 0)
                self.odds[(k << TOP) + (1 << level) + np.flatnonzero(both)] = np.log(mass[1::2][both] / mass[::2][both])

    def _before(self, place: np.ndarray) -> np.ndarray:
        """Tokens of the words before a place."""
        n = np.diff(self.ends, prepend=0)
        k = np.minimum(np.searchsorted(self.ends, place, "right"), len(n) - 1)
        return (np.cumsum(n * self.count) - n * self.count)[k] + (place - (self.ends - n)[k]) * self.count[k]

    def of(self, place: np.ndarray):
        """Count, class and place in the class of words; those with place -1 were not seen."""
        if not self.kinds:
            return np.zeros((3, len(place)), np.int64)
        seen = np.maximum(place, 0)
        kind = np.searchsorted(self.first, seen, "right") - 1
        c = self.count[np.searchsorted(self.ends, seen, "right")]
        return np.where(place < 0, 0, c), np.where(place < 0, 0, kind), np.where(place < 0, 0, seen - self.first[kind])


def _tree(x: np.ndarray, kind: np.ndarray, spot: np.ndarray, counts: Places):
    """Tokens of classes with trees, deepest first; and for each level, of the first tokens of these, the decisions on the way to the word:
    whether the second side is taken, its log odds by counts (-inf: it is empty, so nothing is decided), and three rows of weights."""
    depth = counts.depth[kind]
    token = np.argsort(-depth.astype(np.int8), kind="stable")
    depth = depth[token]
    token = token[: np.searchsorted(-depth, 0)]
    narrow = np.uint32 if counts.place == "<i4" else _U
    kind = kind[token]
    spot, size, named = spot[token].astype(narrow), counts.size[kind].astype(narrow), kind << TOP
    depth = depth[: len(token)]
    below, own = depth.astype(narrow), kind.astype(np.uint32) * np.uint32(0x9E3779B1)
    more = [(_mix(x[token, f].astype(_U) + _U(f << 40)) >> _U(32)).astype(np.uint32) for f in (1, 4)]

    def levels():
        for level in range(int(depth[0]) if len(token) else 0):
            n = int(np.searchsorted(-depth, -level))
            shift = below[:n] - narrow(level + 1)
            side = spot[:n] >> shift
            node = side >> narrow(1)
            second = (side | narrow(1)) << shift
            if level < TOP:
                odds = np.take(counts.odds, named[:n] + ((1 << level) + node.astype(np.int64)))
            else:
                odds = np.zeros(n, np.float32)
                part = np.flatnonzero((second < size[:n]) & (size[:n] - second < narrow(1) << shift))
                odds[part] = np.log((size[part] - second[part]) / (narrow(1) << shift[part]))
            none = np.flatnonzero(second >= size[:n])
            if len(none):
                odds[none] = -np.inf
            key = (node.astype(np.uint32) ^ own[:n] ^ np.uint32(level << 26)) * np.uint32(0x85EBCA6B)
            at = [(h >> np.uint32(32 - TREE_BITS)).astype(np.int64) for h in (key, *((key ^ f[:n]) * np.uint32(0xC2B2AE35) for f in more))]
            yield n, (side & narrow(1)).astype(np.float32), odds, at

    return token, levels()


def _odds(weights: np.ndarray, odds: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    z = odds + np.take(weights, at[0])
    z += np.take(weights, at[1])
    z += np.take(weights, at[2])
    return z


def _decide(weights: np.ndarray, seen: np.ndarray, levels, rate: float) -> None:
    """One update on decisions of trees."""
    ps, ats = [], []
    for _, side, odds, at in levels:
        p = _odds(weights, odds, at)
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        np.reciprocal(p, out=p)
        p -= side
        ps += [p] * 3
        ats += [*at]
    if ps:
        at = np.concatenate(ats)
        n = np.bincount(at, minlength=len(weights)).astype(np.float32)
        seen += n
        weights -= (rate * np.bincount(at, np.concatenate(ps), len(weights)) / (np.sqrt(seen) + n / 4)).astype(np.float32)


def _examples(key, left, right):
    """Parts of a packet with the places of their distinct words instead of these (p, in order), tokens as
    numbers among them (i), and hashes of the words that were not seen, whose place is -1 (v)."""
    h = right.column("h").to_numpy()
    order = np.argsort(h)
    h, place = h[order], right.column("p").to_numpy()[order]
    ps, seen, vs = [], [], []
    for raw in _rows(left.to_batches(), "u", "i"):
        u, at, _, _ = _opened(*raw)
        p = place[np.searchsorted(h, u)]
        order = np.argsort(p, kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        x, y = _packed(p[order], rank[at])
        ps.append(x)
        seen.append(y)
        vs.append(u[p < 0].tobytes())
    cols = [left.column(c) for c in ("turn", "docs", "held_out")] + [pa.array(x, pa.binary()) for x in (ps, seen, vs)]
    return pa.table(cols, names=[x.split()[0] for x in EXAMPLES.split(", ")])


EXAMPLES = "turn int, docs array<long>, held_out boolean, p binary, i binary, v binary"


def _named(place: np.ndarray) -> np.ndarray:
    """What stands for words with a place, where a hash stands for those without."""
    return _mix(place.view(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _tokens_of(p: bytes, i: bytes, v: bytes, counts: Places):
    """Words, text, start of texts, count, class and place in it, of the tokens of a part."""
    place, new = _words_of(p), np.frombuffer(v, np.int64)
    at = np.frombuffer(_unpacked(i), "<u2" if len(place) <= 1 << 16 else "<u4")
    doc, start = _ends(at, np.flatnonzero(new == END)[0] if END in new else np.searchsorted(place, counts.first[1]))
    w = _named(place)
    w[: len(new)] = new
    c, kind, spot = (x[at] for x in counts.of(place))
    return w[at], doc, start, c, kind, spot


def _lower(z: np.ndarray) -> None:
    """Takes the greatest of each row off it, if exponentials could run over or (of the first outcome, which there always is) under."""
    if z.max(initial=0) > 60 or z[:, 0].min(initial=0) < -60:
        z -= z.max(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    _lower(z)
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    return z


def _sum_rows(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.take(weights, x[:, 0], 0)
    for k in range(1, x.shape[1]):
        z += np.take(weights, x[:, k], 0)
    return z


#: Rows that a sum takes one by one; more of them are added up by a reduction, which has a cost for each sum.
SHORT = 8


def _sums(p: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n[0], n[1] ... rows of p, which follow each other in rows."""
    out, first, many = np.empty((len(n), p.shape[1]), p.dtype), np.cumsum(n) - n, n > SHORT
    if many.any():
        out[many] = np.add.reduceat(np.take(p, rows[np.repeat(many, n)], 0), np.cumsum(n[many]) - n[many], axis=0)
    at = np.flatnonzero(~many)
    at = at[np.argsort(SHORT - n[at].astype(np.int8), kind="stable")]
    size = -n[at]
    some = np.take(p, rows[first[at]], 0)
    for j in range(1, -int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(size, -j))
        some[:k] += np.take(p, rows[first[at[:k]] + j], 0)
    out[at] = some
    return out


def _descend(weights: np.ndarray, seen: np.ndarray, f: np.ndarray, n: np.ndarray, step: np.ndarray, rate: float) -> None:
    """Rows f, which n positions have, go down by step, which is overwritten."""
    seen[f] += n
    step *= (rate / (np.sqrt(seen[f]) + n / 4)).astype(np.float32)[:, None]
    weights[f] = np.subtract(np.take(weights, f, 0), step, out=step)


@lru_cache(maxsize=8)
def _bars(k: int) -> np.ndarray:
    """For each number of outcomes that there are, 0 for those and -inf for the others of k."""
    return np.where(np.arange(k) >= np.arange(k + 1)[:, None], np.float32(-np.inf), np.float32(0))


def _step(weights: np.ndarray, seen: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float, few: int | None = None, room: np.ndarray | None = None) -> None:
    """One update on the positions x with outcomes y. few: a column of few values; room: outcomes that there are at each position."""
    z = _sum_rows(weights, x)
    if room is not None:
        z += np.take(_bars(z.shape[1]), room, 0)
    p = _softmax(z)
    p[np.arange(len(y)), y] -= 1
    # Column 0 is the same or nearly so everywhere: sums of it, and of the column of few values, are matrix products.
    for k in (0, few) if few is not None else (0,):
        n = np.bincount(x[:, k])
        f = np.flatnonzero(n)
        hot = np.ones((1, len(y)), np.float32) if len(f) == 1 else np.zeros((len(f), len(y)), np.float32)
        if len(f) > 1:
            hot[np.cumsum(n > 0)[x[:, k]] - 1, np.arange(len(y))] = 1
        _descend(weights, seen, f, n[f], hot @ p, rate)
    rest = [k for k in range(1, x.shape[1]) if k != few]
    flat = x[:, rest].ravel()
    flat = flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat  # numbers of 16 bits are sorted by radix
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    n = np.diff(np.append(cut, len(flat)))
    _descend(weights, seen, flat[cut].astype(np.int64), n, _sums(p, order // len(rest), n), rate)


def _update(held, held_weights, rate: float):
    """By how much this partition's updates change all weights, in blocks of rows of 16-bit floats, and how many positions it saw."""

    def run(batches):
        frequent, room, counts = held.value
        old = held_weights.value
        a, b, tree = (x.copy() for x in old)
        seen, n = [np.ones(len(x), np.float32) for x in old], 0
        for raw in _rows(batches, *"piv"):
            w, doc, start, _, kind, spot = _tokens_of(*raw, counts)
            xs = _features(w, doc, start, _last_frequent(w, doc, start, frequent), counts.bits)
            for lo in range(0, len(xs), STEP):
                x, y, s = xs[lo : lo + STEP], kind[lo : lo + STEP], spot[lo : lo + STEP]
                _step(a, seen[0], x, y, rate, FEATURES - 1)
                at = np.flatnonzero(y >= FIRST_HEAD)
                if len(at):
                    _step(b, seen[1], _word_features(x[at], y[at], counts.bits), s[at], rate, None, room[y[at]])
            for lo in range(0, len(xs), TREE_STEP):
                _decide(tree, seen[2], _tree(xs[lo : lo + TREE_STEP], kind[lo : lo + TREE_STEP], spot[lo : lo + TREE_STEP], counts)[1], rate)
            n += len(xs)
        if n:
            for kind, (weights, was) in enumerate(zip((a, b, tree), old, strict=True)):
                for k, part in enumerate(np.split((weights - was).astype(np.float16), 16)):
                    yield pa.record_batch({"block": pa.array([100 * kind + k]), "w": pa.array([part.tobytes()], pa.binary()), "n": pa.array([float(n)])})

    return run


def _average(key, got):
    total, n = 0.0, 0.0
    for raw, k in zip(got.column("w").to_pylist(), got.column("n").to_pylist(), strict=True):
        total = total + np.frombuffer(raw, np.float16).astype(np.float64) * k
        n += k
    return pa.table({"block": pa.array([key[0].as_py()]), "w": pa.array([(total / n).astype(np.float16).tobytes()], pa.binary()), "n": pa.array([n])})


def _log_softmax(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logarithm of the share of outcome y in each row; z is overwritten."""
    _lower(z)
    own = z[np.arange(len(z)), y]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def log_probabilities(w, doc, start, c, kind, spot, frequent, room, weights, counts: Counts) -> np.ndarray:
    """Natural log-probability of each token; without weights of trees, words of a class that has no softmax have shares by count."""
    x = _features(w, doc, start, _last_frequent(w, doc, start, frequent), counts.bits)
    out = np.empty(len(x))
    for lo in range(0, len(x), STEP):
        s = slice(lo, lo + STEP)
        out[s] = _log_softmax(_sum_rows(weights[0], x[s]), kind[s])
    out[kind == 0] += np.where(c[kind == 0] == 0, np.log(counts.unseen / counts.missing), np.log(1 - counts.unseen))
    if len(weights) == 2:
        share = np.log(np.maximum(c, 1) / np.maximum(np.where(kind > 0, counts.mass[kind], np.where(c > 0, counts.once, 1)), 1))
        out += np.where(kind < FIRST_HEAD, share, 0)
    for lo in range(0, len(x) if len(weights) > 2 else 0, TREE_STEP):
        at = lo + np.flatnonzero((kind[lo : lo + TREE_STEP] < FIRST_HEAD) & (c[lo : lo + TREE_STEP] > 0))
        token, levels = _tree(x[at], kind[at], spot[at], counts)
        lost = np.zeros(len(token))
        for n, side, odds, rows in levels:
            z = _odds(weights[2], odds, rows) * (1 - 2 * side)
            lost[:n] += np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
        out[at[token]] -= lost
    at = np.flatnonzero(kind >= FIRST_HEAD)
    for lo in range(0, len(at), STEP):
        k = at[lo : lo + STEP]
        z = _sum_rows(weights[1], _word_features(x[k], kind[k], counts.bits))
        z += np.take(_bars(IN_CLASS), room[kind[k]], 0)
        out[k] += _log_softmax(z, spot[k])
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"


def _score(held, held_weights):
    def run(batches):
        frequent, room, counts = held.value
        base_of = np.log10(counts.total + 0.5 * (counts.kinds + 1)) if counts.total else np.log10(0.5)
        for docs, out, *raw in _rows(batches, "docs", "held_out", *"piv"):
            w, doc, start, c, kind, spot = _tokens_of(*raw, counts)
            base = np.log10(c + 0.5) - base_of
            score = log_probabilities(w, doc, start, c, kind, spot, frequent, room, held_weights.value, counts) / np.log(10) if counts.total else base
            known, b, s = (np.add.reduceat(v, start) for v in ((c > 0).astype(np.int64), base, score))
            n = np.bincount(doc, minlength=len(docs))
            cols = [(docs, pa.int64()), ([out] * len(docs), pa.bool_()), (n, pa.int64()), (known, pa.int64()), (b, pa.float64()), (s, pa.float64()), (np.full(len(docs), counts.total), pa.int64())]
            yield pa.record_batch([pa.array(v, t) for v, t in cols], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 1


def word_classes(words: DataFrame):
    """words (h, c, g) with class y and place s in it, and the number of words of each class. HEAD words meet on the driver."""
    spark = words.sparkSession
    top = words.where((F.col("h") != int(END)) & (F.col("c") > 1)).orderBy(F.desc("c"), "h").limit(HEAD).collect()
    room, named, kind = np.ones(256, np.int64), [], FIRST_HEAD - 1
    for g in sorted({r["g"] for r in top}):
        for k, r in enumerate([r for r in top if r["g"] == g]):
            kind += k % IN_CLASS == 0
            named.append((r["h"], kind, k % IN_CLASS))
            room[kind] = k % IN_CLASS + 1
    head = spark.createDataFrame(named, "h long, hy int, hs int")
    band = sum(F.when(F.col("c") >= int(x), 1).otherwise(0) for x in BAND_COUNTS)
    rest = F.when(F.col("h") == int(END), 1).when(F.col("c") <= 1, 0).otherwise(2 + F.col("g") * BANDS + band)
    return words.join(F.broadcast(head), "h", "left").select("h", "c", F.coalesce("hy", rest).cast("int").alias("y"), F.coalesce("hs", F.lit(0)).alias("s")), room


def in_order(classed: DataFrame) -> DataFrame:
    """h, p: the place of each word in the order of class, falling count and hash. The driver sees one number for each partition."""
    spark = classed.sparkSession
    by = [F.col("y"), F.desc("c"), F.col("h")]
    numbered = saved(classed.repartitionByRange(*by).sortWithinPartitions(*by).select("h").mapInArrow(_in_order, "h long, task int, k long"), "places")
    sizes = sorted((r["task"], r["n"]) for r in numbered.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    first = spark.createDataFrame([(t, b) for (t, _), b in zip(sizes, before, strict=False)], "task int, first long")
    out = numbered.join(F.broadcast(first), "task").select("h", (F.col("first") + F.col("k")).alias("p"))
    out._scratch = numbered
    return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    parts = saved(rows.mapInArrow(_parts, PARTS), "parts")
    learn = parts.where("NOT held_out")
    found = frequent_words(learn)
    counted = learn.select("u", "i").mapInArrow(_count_words(spark.sparkContext.broadcast(found)), "h long, g int, n long").repartition("h").groupBy("h")
    follow = [F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(f"g{k}") for k in range(GROUPS)]
    most = F.array(*[f"g{k}" for k in range(GROUPS)])
    words = saved(counted.agg(F.sum("n").alias("c"), *follow).select("h", "c", (F.array_position(most, F.array_max(most)) - 1).cast("int").alias("g")), "words")
    release(spark)
    classed, room = word_classes(words)
    got = classed.groupBy("y", "c").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = Places(*(np.array([r[k] for r in got], np.int64) for k in "ycn"))
    places = in_order(classed)
    frequent = sorted(r["p"] for r in places.where(F.col("h").isin(found[0].tolist())).collect())
    held = spark.sparkContext.broadcast((np.sort(_named(np.array(frequent, np.int64))), room, counts))
    drop_saved(words)
    release(spark)
    distinct = parts.select("packet", "u").mapInArrow(_distinct_words, "packet long, h long")
    known = distinct.join(places, "h", "left").select("packet", "h", F.coalesce("p", F.lit(-1)).alias("p"))
    examples = saved(parts.groupBy("packet").cogroup(known.groupBy("packet")).applyInArrow(_examples, EXAMPLES), "examples", "turn")
    release(spark)
    drop_saved(places._scratch)
    drop_saved(parts)
    weights = (np.zeros((1 << counts.bits, CLASSES), np.float32), np.zeros((1 << counts.bits, IN_CLASS), np.float32), np.zeros(1 << TREE_BITS, np.float32))
    done = 0  # rounds that had texts: a small table has too few parts for all rounds, and its steps must not be small for that
    for k in range(ROUNDS if counts.total else 0):
        part = examples.where(F.col("turn") == k).select(*"piv")
        made = part.mapInArrow(_update(held, spark.sparkContext.broadcast(weights), 0.5 / (1 + done)), "block long, w binary, n double")
        some = made.withColumn("_s", (F.spark_partition_id() / 64).cast("int")).groupBy("block", "_s").applyInArrow(_average, "block long, w binary, n double")
        steps = some.groupBy("block").applyInArrow(_average, "block long, w binary, n double").toPandas().sort_values("block")
        release(spark)
        if len(steps):
            done += 1
            each = [np.frombuffer(b"".join(steps["w"][steps["block"] // 100 == m]), np.float16) for m in range(len(weights))]
            weights = tuple(old + x.reshape(old.shape) for x, old in zip(each, weights, strict=True))
    out = examples.drop("turn").mapInArrow(_score(held, spark.sparkContext.broadcast(weights)), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
