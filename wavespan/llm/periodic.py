"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q. Found are all runs of at
least LEAST words and TIMES periods (three or more).

1. Candidates. In a run, every group of GRAM words behind the first period occurred at most a period before. Groups of
   words meet by their hashes in numpy, many texts at once; stretches of groups that recur too far away for their length,
   or are too few, can't be part of a run. Nothing else is left out, and equal hashes of different words only add work.
2. The automaton of a stretch is built over word numbers. Its suffix links are a tree; the words are appended one by one,
   and each access from the state of the text so far to the root recolours that path with the current end. Preferred
   paths, held as splay trees, have one colour each: the end of the last occurrence of their strings. A segment of the
   path whose longest string has L words and whose last occurrence ended d words before gives L + d words of period d;
   if d is at most L, it begins with a square. With L >= 2 d no shorter period is possible, and no word on the left
   continues it.
3. Squares are extended to the right, and to both sides in the whole text, where the stretch was cut.

Defined cases
* null or empty text, or fewer words than LEAST: no run. Words are separated by space and the control characters 9 to 13,
  and are equal if their bytes are.
* null doc_id: like others. Repeated rows: each is returned. Other columns are ignored. Empty table: empty result.
* texts are read whole. An automaton takes about 1 KB of memory for a word of its stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chars import blocks
from .ngramjoin import _join_words, _mix, hashed_words

#: Least words of a run, and least periods.
LEAST, TIMES = 24, 3
#: Words of a group; a run of LEAST words has LEAST - LEAST // TIMES - GRAM + 1 groups behind its first period.
GRAM = 8
#: Bytes of texts whose groups meet at once.
BLOCK = 1 << 19
_U = np.uint64


class Automaton:
    """Suffix automaton of a sequence of numbers: length and suffix link of each state, and the state of each prefix."""

    def __init__(self, sequence: list[int]):
        length, link, step, ends = [0], [-1], [{}], []
        last = 0
        for k, w in enumerate(sequence):
            now = len(length)
            length.append(k + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = now
                p = link[p]
            if p >= 0:
                q = step[p][w]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(w) == q:
                        step[p][w] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
            ends.append(now)
        self.length, self.link, self.ends = length, link, ends


class Paths:
    """The suffix links as preferred paths: splay trees in the order of depth, each with one colour at its top."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = list(link)  # in a splay tree the parent; at its top, the state that the path hangs from
        self.left, self.right, self.colour = [-1] * n, [-1] * n, [-1] * n
        self.inner = [False] * n  # not the top of its splay tree

    def _rotate(self, x: int) -> None:
        up, left, right, inner = self.up, self.left, self.right, self.inner
        p = up[x]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c >= 0:
            up[c] = p
        g = up[x] = up[p]
        if inner[p]:
            if left[g] == p:
                left[g] = x
            else:
                right[g] = x
        else:
            inner[x], inner[p] = False, True
            self.colour[x] = self.colour[p]
        up[p] = x

    def splay(self, x: int) -> None:
        up, left, inner, rotate = self.up, self.left, self.inner, self._rotate
        while inner[x]:
            p = up[x]
            if inner[p]:
                rotate(p if (left[up[p]] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, x: int, colour: int, length: list[int], least: int) -> list[tuple[int, int]]:
        """Colour the path from x to the root; (old colour, length of the longest string) of its segments of at least that length."""
        up, right, inner, old = self.up, self.right, self.inner, self.colour
        top, out = -1, []
        while x >= 0:
            self.splay(x)
            if old[x] >= 0 and length[x] >= least:
                out.append((old[x], length[x]))
            below = right[x]
            if below >= 0:  # what hangs below keeps its colour, as a path of its own
                inner[below] = False
                old[below] = old[x]
            right[x] = top
            if top >= 0:
                inner[top] = True
            top = x
            x = up[x]
        old[top] = colour
        return out


def repetitions(sequence: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence."""
    automaton, out = Automaton(sequence), []
    paths, length, n = Paths(automaton.link), automaton.length, len(sequence)
    shortest = least - least // times
    for i, state in enumerate(automaton.ends):
        for before, longest in paths.access(state, i, length, shortest):
            d = i - before
            # Squares of which the next word is no continuation: the others come again with it, one word longer.
            if longest >= (times - 1) * d and longest + d >= least and (i + 1 == n or sequence[i + 1] != sequence[i + 1 - d]):
                out.append((i + 1 - d - longest, longest + d, d))
    return out


def _stretches(texts: list[bytes], least: int, times: int) -> dict[int, list[tuple[int, int]]]:
    """Text number to [first word, last word + 1) of what may hold runs, in order and apart."""
    w, doc = hashed_words(texts)
    m = len(w) - GRAM + 1
    if m <= 0:
        return {}
    key = _join_words(w, GRAM)
    inside = doc[:m] == doc[GRAM - 1 :]
    key = _mix(key + doc[:m].astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    back = np.full(m, m, np.int64)
    same = sorted_key[1:] == sorted_key[:-1]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    held = inside & (back < m)
    fewest = least - least // times - GRAM + 1
    while True:
        # Whole stretches of groups that recur; a period is at most a share of the words of a stretch behind it.
        edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]
        # Neighbouring texts never share a stretch: groups over their border are not inside.
        size = hi - lo
        farthest = (size + GRAM - 1) // (times - 1)
        number = np.cumsum(np.bincount(lo, minlength=m + 1)[:m]) - 1
        keep = held.copy()
        at = np.flatnonzero(held)
        own = number[at]
        keep[at] = (size[own] >= fewest) & (back[at] <= farthest[own])
        if keep.sum() == held.sum():
            break
        held = keep
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, far in zip(lo.tolist(), hi.tolist(), farthest.tolist(), strict=True):
        d = int(doc[a])
        begin, stop = max(0, a - far - int(first[d])), b + GRAM - 1 - int(first[d])
        spans = out.setdefault(d, [])
        if spans and begin <= spans[-1][1]:
            spans[-1] = (min(begin, spans[-1][0]), max(stop, spans[-1][1]))
        else:
            spans.append((begin, stop))
    return out


def _extended(words: list[bytes], start: int, stop: int, q: int) -> tuple[int, int]:
    """The stretch of period q continued to both sides."""
    while start > 0 and words[start - 1] == words[start - 1 + q]:
        start -= 1
    while stop < len(words) and words[stop] == words[stop - q]:
        stop += 1
    return start, stop


def runs_of(words: list[bytes], spans: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start and period, from the stretches that may hold them."""
    found = set()
    for lo, hi in spans:
        number: dict[bytes, int] = {}
        for start, size, q in repetitions([number.setdefault(w, len(number)) for w in words[lo:hi]], least, times):
            a, b = lo + start, lo + start + size
            if a == lo or b == hi:
                a, b = _extended(words, a, b, q)
            found.add((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: a tenth of the texts repeat a part of theirs from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def _report(prepare: Callable | None, least: int, times: int):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def line(doc, words, runs):
        keep = [True] * len(words) if runs else None
        for start, size, q in runs:
            keep[start + q : start + size] = [False] * (size - q)
        kept = words if keep is None else [w for w, k in zip(words, keep, strict=True) if k]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (doc, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())

    def report(batches):
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
            rows = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
            for part in blocks(rows, lambda r: len(r[1]), BLOCK):
                words = [data.split() for _, data in part]
                if prepare is not None:
                    words = [prepare(d, w) for (d, _), w in zip(part, words, strict=True)]
                spans = _stretches([b" ".join(w) for w in words], least, times)
                out = [line(d, w, runs_of(w, spans.get(k, []), least, times)) for k, ((d, _), w) in enumerate(zip(part, words, strict=True))]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES)

    return report


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def report(docs: DataFrame, prepare: Callable | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Number of runs, the run of greatest exponent, and digests of all runs and of the words that stay, of every document.

    prepare: what makes the words of a document (its id and words are given) before runs are searched.
    """
    _checked(least, times)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_report(prepare, least, times), COLUMNS)


def _checked(least: int, times: int) -> None:
    if times < 3 or least < GRAM * times:
        raise ValueError(f"runs have three periods and {GRAM} words for each at least")


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period of every run, one row each; words are numbered from 0."""
    _checked(least, times)

    def found(batches):
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
            rows = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in rows]
            for part in blocks(rows, lambda r: len(r[1]), BLOCK):
                spans = _stretches([data for _, data in part], least, times)
                out = [(part[k][0], *r) for k, s in spans.items() for r in runs_of(part[k][1].split(), s, least, times)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "period"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, start long, length long, period long")
