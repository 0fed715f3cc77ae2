"""Packing of token sequences: bounded-space online best fit.

A partition keeps at most WINDOWS open sequences. A piece goes into the fullest sequence that it fits; when none
fits and all are open, the fullest is emitted. Documents longer than a sequence are cut, and so is a piece that
would leave an emitted sequence short of a power of two, as pieces may be cut freely. Leftover open sequences of
all partitions are then packed again in rounds, GROUP partitions at a time, until one group is left; it closes its
last sequences full, and cuts what remains at powers of two.

Defined cases
* null or empty text: the end id alone. A text of any length is cut into pieces of at most CAPACITY ids.
* null doc_id: packed, and returned with a null doc_id. Repeated rows: each is packed. Other columns are ignored.
* empty table: empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

CAPACITY = 4096
WINDOWS = 16
GROUP = 16
END_ID = 2
#: Space-separated parts whose ids a worker remembers; the table starts anew when it is full, which changes no result.
REMEMBERED = 600_000
#: Marks that may follow a word; a run of them is a token group of its own.
MARKS = ".,;:!?#$%&*|<>()[]{}+-=~^@/\"\\_"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int, ids binary"
#: Sequences of one partition or group are numbered below this.
ROOM = 1 << 24


class Encoder:
    """Ids of whole texts. White space always ends a token here, so ids are those of the space-separated parts.

    Parts that are letters of the Latin blocks, with or without marks after them, are most of all parts. The
    tokenizer's own model gets these directly, lower-cased and as byte symbols; its normalizer and splitter would
    leave such words alone. All other parts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbol = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.symbols = {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}
        self.cores: dict[str, bytes] = {}
        self.marks = {"": b""}

    def _whole(self, parts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(parts), 5_000):
            out += [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(parts[k : k + 5_000], add_special_tokens=False)]
        return out

    def _learn(self, parts: list[str]) -> None:
        plain, cores, marks, other = [], [], [], []
        for w in parts:
            core = w.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                plain.append(w)
                cores.append(core.lower())
                marks.append(w[len(core) :])
            else:
                other.append(w)
        new = list(set(marks).difference(self.marks))
        self.marks.update(zip(new, self._whole(new), strict=True))
        words = list(set(cores).difference(self.cores))
        for k in range(0, len(words), 20_000):
            run = words[k : k + 20_000]
            text = " ".join(run)
            if not text.isascii():
                text = text.translate(self.symbols)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = [0, *(4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()]
            if len(cut) != len(run) + 1:
                raise ValueError("the vocabulary does not mark the ends of words")
            raw = ids.tobytes()
            self.cores.update(zip(run, [raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        c, m = self.cores, self.marks
        self.known.update(zip(plain, [c[x] + m[y] for x, y in zip(cores, marks, strict=True)], strict=True))
        self.known.update(zip(other, self._whole(other), strict=True))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.cores = {}, {}
            new = set().union(*parts)
        self._learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.uint32) for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids) and hands sequences that are full or emitted to done(pieces)."""

    def __init__(self, done, capacity: int, windows: int):
        self.done, self.capacity, self.windows, self.open = done, capacity, windows, []

    def place(self, piece: tuple) -> None:
        n = len(piece[3])
        fits = [w for w in self.open if w[0] + n <= self.capacity]
        if fits:
            best = max(fits, key=lambda w: w[0])
            best[0] += n
            best[1].append(piece)
            if best[0] == self.capacity:
                self.open.remove(best)
                self.done(best[1])
        elif n == self.capacity:
            self.done([piece])
        elif len(self.open) < self.windows:
            self.open.append([n, [piece]])
        else:
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            # Short of a power of two it would be padded: the piece is cut to fill it.
            gap = self.capacity - fullest[0] if fullest[0] & (fullest[0] - 1) else 0
            if gap:
                fullest[1].append(_head(piece, gap))
                piece = _tail(piece, gap)
            self.done(fullest[1])
            self.place(piece)

    def close(self) -> None:
        """Fill the fullest from the emptiest until one is left, and cut that one at powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(w[0] for w in self.open)
        self.open = []
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                p = rest.pop(0)
                if len(p[3]) > size:
                    rest.insert(0, _tail(p, size))
                    p = _head(p, size)
                now.append(p)
                size -= len(p[3])
            self.done(now)


def _head(p: tuple, n: int) -> tuple:
    return (p[0], p[1], p[2], p[3][:n])


def _tail(p: tuple, n: int) -> tuple:
    return (p[0], p[1] + n, p[2], p[3][n:])


class _Rows:
    """Rows of finished and open sequences, as Arrow batches. Ids are kept where asked for, and of open sequences."""

    def __init__(self, first: int, keep_ids: bool):
        self.number, self.keep_ids, self.rows = first, keep_ids, []

    def add(self, pieces: list[tuple], still_open: int = 0) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.number, at, still_open, raw if still_open or self.keep_ids else None))
            at += len(ids)
        self.number += 1

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(kinds)
        self.rows = []
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def _pack_documents(path: str, capacity: int, windows: int, keep_ids: bool):
    def run(batches):
        encode = encoder(path)
        out = _Rows(TaskContext.get().partitionId() * ROOM, keep_ids)
        packer = Packer(out.add, capacity, windows)
        for b in batches:
            texts, docs = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for k in range(0, len(docs), 256):
                for doc, ids in zip(docs[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID))
                    for start in range(0, len(ids), capacity):
                        packer.place((doc, start, len(ids), ids[start : start + capacity]))
                if len(out.rows) >= 5000:
                    yield out.take()
        for _, pieces in packer.open:
            out.add(pieces, 1)
        yield out.take()

    return run


def _merge(level: int, capacity: int, windows: int, keep_ids: bool, last: bool):
    """Open sequences of a group, packed again as documents were; the last group leaves none open."""

    def run(key, got):
        out = _Rows((level << 56) + key[0].as_py() * ROOM, keep_ids)
        packer = Packer(out.add, capacity, windows)
        got = got.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        cols = [got.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]
        for doc, start, total, raw in zip(*cols, strict=True):
            packer.place((doc, start, total, np.frombuffer(raw, "<u4")))
        if last:
            packer.close()
        for _, pieces in packer.open:
            out.add(pieces, 1)
        return pa.Table.from_batches([out.take()])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, windows: int = WINDOWS, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    now = saved(rows.mapInArrow(_pack_documents(tokenizer_path, capacity, windows, keep_ids), PIECES), "packed")
    out, level = now.where("open = 0"), 0
    while True:
        part = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), 24)
        groups = now.where("open = 1").select(part.alias("g")).distinct().count()
        if not groups:
            break
        last, level = groups <= GROUP, level + 1
        left = now.where("open = 1").withColumn("_group", F.lit(0).cast("long") if last else (part / GROUP).cast("long"))
        now = saved(left.groupBy("_group").applyInArrow(_merge(level, capacity, windows, keep_ids, last), PIECES), "merged")
        out = out.unionAll(now.where("open = 0"))
        if last:
            break
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
