"""Registered queries of the trained models against plain loops over letters and words."""

import bisect
import collections
import math
import zlib

import numpy as np
from helpers import DATA
from wavespan.llm import langid, maxent, toxicity
from wavespan.llm.queries import QUERIES

M = 0xFFFFFFFF


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def letter_words(text):
    """Runs of letters of a lower-cased text."""
    out, now = [], []
    for c in (text or "").lower() + "\0":
        if c.isalpha():
            now.append(ord(c))
        elif now:
            out.append(now)
            now = []
    return out


def trigrams(word):
    """Bucket of each letter with its neighbours; 0 stands for none."""
    w = [0, *word, 0]
    out = []
    for k in range(1, len(w) - 1):
        h = (w[k - 1] * 0x9E3779B1 & M) ^ (w[k] * 0x85EBCA6B & M) ^ (w[k + 1] * 0xC2B2AE35 & M)
        out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & M) >> (32 - langid.BITS))
    return out


def script(letter):
    return langid.SCRIPT_NAMES[bisect.bisect_right(langid.SCRIPT_STARTS.tolist(), letter) - 1]


def test_language_of_every_text(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    counts, scripts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in rows:
        if crc(r["doc_id"], 4) != 2 and r["lang"] is not None:
            for w in letter_words(r["text"]):
                counts[r["lang"]].update(trigrams(w))
                scripts[r["lang"]].update(script(c) for c in w)
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    allowed = {s: [x for x in langs if scripts[x][s] and scripts[x][s] >= 0.01 * sum(scripts[x].values())] or langs for s in set(langid.SCRIPT_NAMES)}
    memo = {}

    def logp(bucket, x):
        if (bucket, x) not in memo:
            memo[bucket, x] = float(np.float32(math.log(counts[x][bucket] / total[x] + 1e-6)))
        return memo[bucket, x]

    got = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, DATA).collect()}
    for r in rows:
        value, back = None, []
        for w in letter_words(r["text"]):
            grams = trigrams(w)
            own = [sum(logp(g, x) for g in grams) - (0 if x in allowed[script(w[0])] else 1e3) for x in langs]
            if value is None:
                value = own
                continue
            best = max(range(len(langs)), key=lambda k: value[k])
            frm = [k if value[k] >= value[best] - langid.SWITCH else best for k in range(len(langs))]
            back.append(frm)
            value = [max(value[k], value[best] - langid.SWITCH) + own[k] for k in range(len(langs))]
        found = got[r["doc_id"]]
        assert found["held_out"] == (crc(r["doc_id"], 4) == 2)
        if value is None:
            assert (found["lang_pred"], found["score"], found["n_spans"]) == ("und", 0.0, 0)
            continue
        path = [max(range(len(langs)), key=lambda k: value[k])]
        for frm in reversed(back):
            path.append(frm[path[-1]])
        n = collections.Counter(path)
        lang = min(n, key=lambda k: (-n[k], k))
        assert found["lang_pred"] == langs[lang] and math.isclose(found["score"], n[lang] / len(path))
        assert found["n_spans"] == 1 + sum(a != b for a, b in zip(path, path[1:], strict=False))


def ngrams(text):
    """Buckets of the n-grams of a text that stay within a word and its two boundaries."""
    c = [ord(x) if x.isalpha() else 1 for x in (text or "").lower().replace("\0", " ")]
    out = set()
    for i in range(len(c)):
        h = c[i]
        for n in range(2, max(toxicity.SIZES) + 1):
            end = i + n - 1
            if end >= len(c) or (n > 2 and c[end - 1] == 1):
                break
            h = (h * int(toxicity.MULTIPLIER) + c[end] * 2654435761) & M
            if n in toxicity.SIZES and (c[i] != 1 or c[end] != 1):
                x = h ^ (h >> 15)
                out.add((((x * 0x2C1B3C6D) & M) ^ (n * 0x9E3779B1 & M)) >> (32 - toxicity.BITS))
    return out


def test_toxicity_of_every_text(spark):
    docs, marks = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: ngrams(r["text"]) for r in docs.collect()}
    y = {}
    for r in marks.where("toxic IS NOT NULL AND doc_id IS NOT NULL").collect():
        if crc(r["doc_id"], 3) != 1:
            y[r["doc_id"]] = max(y.get(r["doc_id"], 0), r["toxic"])
    n = collections.Counter(y.values())
    seen = [collections.Counter(), collections.Counter()]
    for i, k in y.items():
        seen[k].update(texts[i])
    r = {f: math.log((seen[1][f] + 1) / (n[1] + 2)) - math.log((seen[0][f] + 1) / (n[0] + 2)) for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= toxicity.SUPPORT}
    gain = {f: abs(v) * math.sqrt(seen[0][f] + seen[1][f]) for f, v in r.items()}
    chosen = sorted(r, key=lambda f: (-gain[f], f))[: toxicity.FEATURES]
    model = toxicity.train(docs, marks.where(~toxicity.held_out(marks["doc_id"])))
    kept = np.flatnonzero(model.keep >= 0)
    # Features of equal gain may change places at the end of the list, where gains differ in the last bit.
    assert len(kept) == len(chosen) and len(set(kept.tolist()) ^ set(chosen)) <= 0.002 * len(chosen)
    assert min(gain[int(f)] for f in kept) >= min(gain[f] for f in chosen) - 1e-9
    weight = {int(f): model.weight[model.keep[f]] for f in kept}
    score = lambda i: 1 / (1 + math.exp(-max(-30, min(30, sum(weight[f] for f in texts[i] if f in weight) + model.intercept))))
    got = {x["doc_id"]: x for x in QUERIES["op5_toxicity"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for i in texts:
        assert math.isclose(got[i]["score"], score(i), abs_tol=1e-4) and got[i]["held_out"] == (crc(i, 3) == 1) and got[i]["predicted"] == (got[i]["score"] >= 0.7)
    # The weights are near the least of the training loss: no feature has a slope that would lower it much.
    away = collections.Counter()
    for i, k in y.items():
        for f in texts[i] & weight.keys():
            away[f] += (score(i) - k) * r[f] / len(y)
    first = collections.Counter()
    share = n[1] / len(y)
    for i, k in y.items():
        for f in texts[i] & weight.keys():
            first[f] += (share - k) * r[f] / len(y)
    norm = lambda g: math.sqrt(sum(v * v for v in g.values()))
    assert norm(away) < 0.05 * norm(first)


def test_classes_of_words(spark):
    """Head words by count in classes of one group, the rest by group and band of counts, unseen and end apart."""
    rnd = np.random.default_rng(3)
    rows = [(int(h), int(c), int(g)) for h, c, g in zip(rnd.permutation(1 << 20)[:4000], np.maximum(1, (3000 / np.arange(1, 4001)).astype(int)), rnd.integers(0, maxent.GROUPS, 4000), strict=True)]
    rows.append((int(maxent.END), 5000, 0))
    classed, room = maxent.word_classes(spark.createDataFrame(rows, "h long, c long, g int"))
    got = {r["h"]: r for r in classed.collect()}
    head = sorted((r for r in rows if r[0] != maxent.END and r[1] > 1), key=lambda r: (-r[1], r[0]))[: maxent.HEAD]
    places = collections.defaultdict(set)
    for h, _, g in head:
        y, s = got[h]["y"], got[h]["s"]
        assert maxent.FIRST_HEAD <= y < maxent.CLASSES and 0 <= s < room[y] <= maxent.IN_CLASS and s not in places[y]
        places[y].add(s)
        assert {r[2] for r in head if got[r[0]]["y"] == y} == {g}
    assert all(places[y] == set(range(room[y])) for y in places)
    for h, c, g in set(rows) - set(head):
        band = sum(c >= b for b in maxent.BAND_COUNTS)
        assert (got[h]["y"], got[h]["s"]) == (1 if h == maxent.END else 0 if c <= 1 else 2 + g * maxent.BANDS + band, 0)


def test_one_update_is_the_gradient_of_each_position():
    rnd = np.random.default_rng(4)
    n, k = 50, 7
    x = np.stack([np.zeros(n, np.int32), rnd.integers(1, 20, n), rnd.integers(1, 20, n), rnd.integers(20, 24, n)], 1).astype(np.int32)
    y, room = rnd.integers(0, 3, n), rnd.integers(3, k + 1, n)
    old, seen = rnd.normal(size=(24, k)).astype(np.float32), (1 + rnd.integers(0, 9, 24)).astype(np.float32)
    w, s = old.copy(), seen.copy()
    maxent._step(w, s, x, y, 0.5, 3, room)
    step, count = np.zeros((24, k)), np.zeros(24)
    for i in range(n):
        z = [sum(float(old[f, j]) for f in x[i]) if j < room[i] else -math.inf for j in range(k)]
        e = [math.exp(v - max(z)) for v in z]
        for f in x[i]:
            count[f] += 1
            for j in range(k):
                step[f, j] += e[j] / sum(e) - (j == y[i])
    assert np.allclose(s, seen + count)
    want = old - step * (0.5 / (np.sqrt(seen + count) + count / 4))[:, None]
    assert np.allclose(w, want, atol=1e-4)


def test_sums_of_rows_of_every_length():
    """Long and short runs of rows add up as by a loop, and an update reads each row once."""
    rnd = np.random.default_rng(4)
    for most in (1, maxent.SHORT, 60):
        n = rnd.integers(1, most + 1, 200)
        rows = rnd.integers(0, 300, n.sum())
        p = rnd.normal(size=(300, 7)).astype(np.float32)
        want = [sum(p[k].astype(float) for k in part) for part in np.split(rows, np.cumsum(n)[:-1])]
        assert np.allclose(maxent._sums(p, rows, n), want, atol=1e-4)


def rare_class(n=5000, seed=5):
    """Counts of a class of n rarer words, one of words seen once, the end and a head class; every place."""
    rnd = np.random.default_rng(seed)
    c = np.sort(rnd.integers(2, 40, n))[::-1]
    y = np.concatenate([np.zeros(37), [1], np.full(n, 4), np.full(9, maxent.FIRST_HEAD)]).astype(np.int64)
    c = np.concatenate([np.ones(37), [500], c, np.arange(900, 891, -1)]).astype(np.int64)
    return maxent.Places(y, c, np.ones(len(y))), y, c


def tree_odds(counts, weights, x, kind, spot):
    """Log-probability of each word within its class."""
    token, levels = maxent._tree(x, kind, spot, counts)
    out = np.zeros(len(kind))
    for n, side, odds, at in levels:
        z = maxent._odds(weights, odds, at)
        out[token[:n]] -= np.logaddexp(0, np.where(side == 1, -z.astype(float), z.astype(float)))
    return out


def test_words_of_classes_without_a_softmax_depend_on_the_history():
    """the shares in a rare class are those of counts before training, add up to one after it, and follow the last word."""
    counts, y, c = rare_class()
    got = counts.of(np.arange(len(y)))
    assert (got[0] == c).all() and (got[1] == y).all() and counts.of(np.array([-1]))[0][0] == 0
    for k, n in ((0, 37), (4, 5000)):
        spot, kind = np.arange(n), np.full(n, k)
        mass = c[y == k] / c[y == k].sum()
        weights = np.zeros(1 << maxent.TREE_BITS, np.float32)
        x = np.tile(np.array([0, 7, 8, 9, 10], np.int32), (n, 1))
        other = x + np.array([0, 100, 100, 100, 0], np.int32)
        start = tree_odds(counts, weights, x, kind, spot)
        # Below the top levels, words of a run of 2 have equal shares: their counts are next to each other.
        assert abs(np.exp(start).sum() - 1) < 1e-4 and np.allclose(np.exp(start), mass, rtol=0.5) and np.allclose(start[: n // 50], np.log(mass)[: n // 50], atol=0.1)
        seen = np.ones(len(weights), np.float32)
        for _ in range(20):
            half = spot < n // 2
            maxent._decide(weights, seen, maxent._tree(np.where(half[:, None], x, other), kind, spot, counts)[1], 0.5)
        a, b = (tree_odds(counts, weights, v, kind, spot) for v in (x, other))
        assert abs(np.exp(a).sum() - 1) < 1e-4 and abs(np.exp(b).sum() - 1) < 1e-4
        assert (a > b)[: n // 2].all() and (a < b)[n // 2 :].all()


def test_one_update_of_decisions_is_the_gradient():
    counts, y, _ = rare_class(200, 6)
    rnd = np.random.default_rng(7)
    spot = rnd.integers(0, 200, 60)
    x, kind = rnd.integers(0, 5, (60, 5)).astype(np.int32), np.full(60, 4)
    old = rnd.normal(size=1 << maxent.TREE_BITS).astype(np.float32)
    new, seen = old.copy(), np.ones(len(old), np.float32)
    maxent._decide(new, seen, maxent._tree(x, kind, spot, counts)[1], 0.5)
    step, count = collections.Counter(), collections.Counter()
    for n, side, odds, at in maxent._tree(x, kind, spot, counts)[1]:
        for t in range(n):
            p = 1 / (1 + math.exp(-sum(float(old[a[t]]) for a in at) - float(odds[t])))
            for a in at:
                step[int(a[t])] += p - side[t]
                count[int(a[t])] += 1
    want = old.copy()
    for f, n in count.items():
        want[f] -= 0.5 * step[f] / (math.sqrt(1 + n) + n / 4)
    assert np.allclose(new, want, atol=1e-4)


def test_places_and_frequent_words(spark, monkeypatch):
    """Places follow class, falling count and hash; the most frequent words are exact whether or not rare ones are left unnamed."""
    rnd = np.random.default_rng(8)
    rows = [(int(h), int(k % 5), int(c)) for k, (h, c) in enumerate(zip(rnd.permutation(1 << 20)[:3000], rnd.integers(1, 9, 3000), strict=True))]
    got = {r["h"]: r["p"] for r in maxent.in_order(spark.createDataFrame(rows, "h long, y int, c long")).collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], -r[2], r[0])))}
    texts = [" ".join(f"w{k}" for k in np.minimum(rnd.zipf(1.3, 3000), 5000)) for _ in range(12)]
    docs = spark.createDataFrame([(k, t.encode(), False) for k, t in enumerate(texts)], "doc_id long, text binary, held_out boolean")
    parts = docs.repartition(4).mapInArrow(maxent._parts, maxent.PARTS)
    w, _, _ = maxent._tokens([t.encode() for t in texts])
    count = collections.Counter(w[w != maxent.END].tolist())
    want = sorted(count, key=lambda h: (-count[h], h))
    for share, n in ((maxent.SHARE, 64), (1000, 20), (1000, 2), (8, 20)):
        monkeypatch.setattr(maxent, "SHARE", share)
        assert maxent._most_frequent(parts, n) == want[:n]
