import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import DATA
from wavespan.llm import periodic
from wavespan.llm.queries import QUERIES


def brute_runs(words, least=24, times=3):
    """All runs, period by period: maximal stretches of equal words q apart, smallest periods only."""
    n, out, seen = len(words), [], {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and (i, size) not in seen:
                out.append((i, size, q))
                seen[i, size] = q
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    words = brute_planted(doc_id, words) if plant else words
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rnd):
    """Texts with nested, touching, overlapping and broken repetitions."""
    out = []
    while len(out) < rnd.integers(1, 400):
        kind = rnd.integers(5)
        part = [b"w%d" % k for k in rnd.integers(0, (2, 3, 8, 1000)[rnd.integers(4)], rnd.integers(1, 30))]
        if kind < 3:
            part = (part * int(rnd.integers(2, 30)))[: rnd.integers(1, 200)]
        if kind == 3 and out:
            part = out[-int(rnd.integers(1, 40)) :]
        out += part
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_brute_force(seed):
    rnd = np.random.default_rng(seed)
    texts = [random_words(rnd) for _ in range(60)]
    spans = periodic._stretches([b" ".join(t) for t in texts], 24, 3)
    for k, t in enumerate(texts):
        want = brute_runs(t)
        assert periodic.runs_of(t, spans.get(k, [])) == want
        assert sorted(periodic.repetitions([int(w[1:]) for w in t]), key=lambda r: (r[0], r[2])) == want


def test_last_occurrences_of_all_strings():
    """After each access, the colours are the ends of the last occurrences of all suffixes."""
    rnd = np.random.default_rng(1)
    for _ in range(30):
        s = rnd.integers(0, 3, rnd.integers(1, 60)).tolist()
        a = periodic.Automaton(s)
        paths = periodic.Paths(a.link)
        for i, state in enumerate(a.ends):
            got = sorted(paths.access(state, i, a.length, 1))
            last = {}
            for size in range(1, i + 2):
                suffix = s[i + 1 - size : i + 1]
                ends = [e for e in range(size - 1, i) if s[e + 1 - size : e + 1] == suffix]
                if ends:
                    last[ends[-1]] = size
            assert got == sorted(last.items())


def test_registered_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, DATA).collect())
    assert got == sorted(brute_row(r["doc_id"], r["text"]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_edge_cases(spark, edge, empty):
    period = " ".join(f"p{k}" for k in range(50))
    texts = [(1, " ".join(["a"] * 23)), (2, " ".join(["a"] * 24)), (3, f"x {period} {period} {period} y"), (4, f"{period} {period}"), (5, " ".join(["ha", "Ha"] * 12)), (6, "\x0ba\x0ba a " * 30), (7, None), (8, " \n"), (None, " ".join(["b c"] * 30))]
    df = spark.createDataFrame([(*r, 1, "x") for r in [*texts, texts[1]]], "doc_id long, text string, start int, period string")
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in periodic.report(df).collect()), key=key)
    assert got == sorted((brute_row(i, t, plant=False) for i, t in [*texts, texts[1]]), key=key)
    assert sorted(tuple(r) for r in periodic.periodic_runs(df.where("doc_id in (2, 3)")).collect()) == [(2, 0, 24, 1), (2, 0, 24, 1), (3, 1, 150, 50)]
    assert periodic.report(edge).count() == 10 and periodic.report(empty).count() == 0 and periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.report(df, times=2)


def test_long_runs_are_linear():
    words = [b"a"] * 30000 + [b"b"] + [b"x", b"y", b"z"] * 10000
    spans = periodic._stretches([b" ".join(words)], 24, 3)
    assert periodic.runs_of(words, spans[0]) == [(0, 30000, 1), (30001, 30000, 3)]
