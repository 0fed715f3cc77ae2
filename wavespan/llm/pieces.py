"""SentencePiece encoding and decoding as a relational lattice.

A text begins with a space of its own, and spaces are shown as SPACE. It is cut wherever the two neighbouring
characters stand together in no piece of the vocabulary: no piece lies across such a place, so the units between cuts
are encoded alone, whatever their length. Units are made distinct. Their substrings of bounded length are exploded and
joined to the piece table by equality; the matches are edges of a lattice, grouped by unit; a fold with Spark's
aggregate picks the path, as a number whose bits are the places where pieces start or end. There are two folds:

* viterbi, for vocabularies whose scores are log-probabilities: the path with the greatest sum of scores;
* merges, for vocabularies whose scores are merge ranks (the model in use): edges in the order of their scores join
  the two parts of the path that they span. This gives the ids of the library; the greatest sum does not.

Characters without a piece go to the pieces of their bytes. Ids come back to the texts by packets of at most PACKET
bytes of texts of one input split: each packet sends its distinct units once.

Defined cases
* null or empty text: no pieces; decoding gives the empty text.
* merges: of equal edges the first one; viterbi: ties to the longer last piece. Texts of any length are read whole.
* units over UNIT characters are not sent, but fold whole in the task that holds the text, by the same rule.
* null doc_id: encoded, too. Repeated rows: each is returned. Other columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chars import blocks
from .common import saved

SPACE = "▁"
#: Characters up to which units are made distinct and sent to the lattice.
UNIT = 62
#: Bytes of texts that share a dictionary, at most (a longer text has one of its own); bytes packed together on the way there.
PACKET, BLOB = 1 << 25, 1 << 20
#: Pieces up to which the table is broadcast; a larger vocabulary is joined by shuffle.
BROADCAST_PIECES = 300_000
#: Score of a character that only bytes can spell.
BYTES_SCORE = -1e7
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_INV = pow(_R, -1, 1 << 64)


class Vocabulary:
    """Pieces of a model file: ids and scores, byte pieces, and which characters stand together in a piece."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.table = {m.id_to_piece(i): (i, float(m.get_score(i))) for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.longest = max(map(len, self.table))
        #: Pieces of several characters in the order of their scores.
        self.ranked = sorted((p for p in self.table if len(p) > 1), key=lambda p: (-self.table[p][1], self.table[p][0]))
        names = sorted(self.table, key=self.table.get)
        h = _hashes(_points("".join(names)).astype(_U), np.concatenate([[0], np.cumsum(list(map(len, names)))]))
        order = np.argsort(h)
        self.hashes, self.hash_ids = h[order], np.array([self.table[p][0] for p in names], np.int32)[order]
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, (i, _) in self.table.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.spell = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        shown = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).encode() for i in range(size)]
        self.pool = np.frombuffer(b"".join(shown), np.uint8)
        self.width = np.array([len(x) for x in shown], np.int32)
        self.place = np.cumsum(self.width, dtype=np.int32) - self.width
        pairs = {p[k : k + 2] for p in self.table for k in range(len(p) - 1)}
        chars = sorted({c for x in pairs for c in x})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.together = np.zeros(self.kinds**2, bool)
        for a, b in pairs:
            self.together[self.kind[ord(a)] * self.kinds + self.kind[ord(b)]] = True

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by their hashes; -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.hash_ids[at], -1).astype(np.int32)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, score, rank (of pieces of several characters, by score) of a model's ordinary pieces. The file bounds its size."""
    v = vocabulary(path)
    rank = {p: k for k, p in enumerate(v.ranked)}
    return spark.createDataFrame([(p, i, s, rank.get(p)) for p, (i, s) in v.table.items()], "piece string, id int, score double, rank long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(k: int, n: int) -> np.ndarray:
    if len(_powers[k]) < n:
        out = np.full(max(n, 1 << 20), (_R, _INV)[k], _U)
        out[0] = 1
        _powers[k] = np.multiply.accumulate(out)
    return _powers[k][:n]


def shown(text: str | None) -> str:
    """The text as the pieces spell it."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _hashes(c: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points between one edge and the next."""
    sums = np.zeros(len(c) + 1, _U)
    np.cumsum((c + _U(1)) * _U(0xD6E8FEB86659FD93) * _power(0, len(c)), out=sums[1:])
    at = sums[edge]
    return _mix(_mix((at[1:] - at[:-1]) * _power(1, len(c) + 1)[edge[:-1]]) + np.diff(edge).astype(_U) * _U(0x8CB92BA72F3D8DD7))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cut_units(texts: list[str], v: Vocabulary):
    """Joined texts (as shown), first character of each unit and the end of all, hash of each unit, first unit of each text and the end."""
    joined = "".join(texts)
    c = _points(joined)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    k = np.take(v.kind, c)
    cut = np.ones(len(c), bool)
    np.logical_not(np.take(v.together, k[:-1] * v.kinds + k[1:]), out=cut[1:])
    cut[begin[size > 0]] = True
    start = np.flatnonzero(cut)
    edge = np.append(start, len(c))
    return joined, edge, _hashes(c.astype(_U), edge), np.searchsorted(start, np.append(begin, len(c)))


def _packets(batches, columns: list[str]):
    """(packet, rows) in order: texts of one input split, of PACKET bytes at most; a row is (text as shown, *columns)."""
    done: dict[int, int] = {}
    held: dict[int, list] = {}
    for b in batches:
        for text, chunk, *rest in zip(b.column("text").to_pylist(), b.column("chunk").to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
            n = done.get(chunk, 0)
            packet = (chunk ^ (n // PACKET) * 0x5851F42D4C957F2D) & 0x7FFFFFFFFFFFFFFF
            done[chunk] = n + len(text or "")
            rows = held.setdefault(packet, [])
            rows.append((shown(text), *rest))
        for packet in [p for p, rows in held.items() if sum(len(r[0]) for r in rows) >= BLOB]:
            yield packet, held.pop(packet)
    yield from held.items()


def _distinct(path: str):
    """packet, unit: distinct units of each packet, but those of one character and long ones."""

    def run(batches):
        v, now, seen = vocabulary(path), None, np.zeros(0, _U)
        for packet, rows in _packets(batches, []):
            if packet != now:
                now, seen = packet, np.zeros(0, _U)
            for part in blocks([r[0] for r in rows], len, 1 << 20):
                joined, edge, h, _ = cut_units(part, v)
                size = np.diff(edge)
                own = np.flatnonzero((size > 1) & (size <= UNIT))
                u, first = np.unique(h[own], return_index=True)
                at = np.minimum(np.searchsorted(seen, u), max(0, len(seen) - 1))
                new = seen[at] != u if len(seen) else np.ones(len(u), bool)
                seen = np.sort(np.concatenate([seen, u[new]]), kind="stable")
                first = own[first[new]]
                found = sorted(joined[a:z] for a, z in zip(edge[first].tolist(), edge[first + 1].tolist(), strict=True))
                yield pa.record_batch({"packet": pa.array(np.full(len(found), packet, np.int64)), "unit": pa.array(found, pa.string())})

    return run


ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _pack(batches):
    """packet, texts: rows of ROWS as compressed Arrow streams."""
    for packet, rows in _packets(batches, ["doc_id"]):
        for part in blocks(rows, lambda r: len(r[0]), BLOB):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(pa.record_batch([pa.array([r[1] for r in part], pa.int64()), pa.array([r[0] for r in part], pa.string())], schema=ROWS))
            yield pa.record_batch({"packet": pa.array([packet], pa.int64()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def viterbi(edges: Column, length: Column) -> Column:
    """The path with the greatest sum. edges: (stop, start, score) sorted by stop and start.

    The state holds for each end reached so far its best score and the path up to it.
    """
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(1).cast("long").alias("path")))

    def step(state: Column, e: Column) -> Column:
        before = F.get(state, e["start"])
        now = F.struct((before["s"] + e["score"]).alias("s"), before["path"].bitwiseOR(_bit(e["stop"])).alias("path"))
        last = F.get(state, e["stop"])
        return (
            F.when(F.size(state) <= e["stop"], F.concat(state, F.array(now)))
            .when(before["s"] + e["score"] > last["s"], F.concat(F.slice(state, 1, F.size(state) - 1), F.array(now)))
            .otherwise(state)
        )

    return F.aggregate(edges, start, step, lambda state: F.get(state, length)["path"])


def merges(edges: Column, length: Column, bits: int) -> Column:
    """The path that merging gives. edges: sorted numbers of rank, start (6 bits) and size (`bits` bits).

    The path starts as all characters alone. An edge is taken if it starts and ends at bits with one bit in between, which goes.
    """

    def step(path: Column, e: Column) -> Column:
        start, size = F.shiftright(e, bits).bitwiseAND(F.lit(63)).cast("int"), e.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        part = F.call_function("shiftright", path, start).bitwiseAND(_bit(size + 1) - 1)
        taken = (F.bit_count(part) == 3) & (part.bitwiseAND(_bit(size) + 1) == _bit(size) + 1)
        return F.when(taken, path - F.call_function("shiftleft", part - _bit(size) - 1, start)).otherwise(path)

    return F.aggregate(edges, _bit(length + 1) - 1, step)


def encode_units(units: DataFrame, pieces: DataFrame, v: Vocabulary, fold: str = "merges") -> DataFrame:
    """unit, path of distinct units that a piece of several characters fits into."""
    n = F.length("unit")
    least = 2 if fold == "merges" else 1
    at = units.where(n >= least).select("unit", F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    at = at.select("unit", "start", F.explode(F.sequence(F.lit(least), F.least(F.lit(v.longest), n - F.col("start")))).alias("size"))
    parts = at.select("unit", "start", "size", F.expr("substring(unit, start + 1, size)").alias("piece"))
    table = F.broadcast(pieces) if len(v.table) <= BROADCAST_PIECES else pieces
    if fold == "merges":
        bits = v.longest.bit_length()
        edge = F.shiftleft("rank", bits + 6) + F.shiftleft(F.col("start").cast("long"), bits) + F.col("size")
        lattice = parts.join(table.select("piece", "rank"), "piece").groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
        return lattice.select("unit", merges(F.col("edges"), n, bits).alias("path"))
    if fold != "viterbi":
        raise ValueError("fold is merges or viterbi")
    met = parts.join(table, "piece", "left").where("score IS NOT NULL OR size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("stop"), "start", F.coalesce("score", F.lit(BYTES_SCORE)).alias("score"))
    return met.groupBy("unit").agg(F.array_sort(F.collect_list(edge)).alias("edges")).select("unit", viterbi(F.col("edges"), n).alias("path"))


def long_unit_ids(unit: str, v: Vocabulary, fold: str = "merges") -> list[int]:
    """Ids of pieces of a unit of any length, by the same folds."""
    n = len(unit)
    if fold == "viterbi":
        best, back = [0.0], [(0, 0)]
        for stop in range(1, n + 1):
            score = None
            for start in range(max(0, stop - v.longest), stop):
                hit = v.table.get(unit[start:stop]) or ((-ord(unit[start]) - 1, BYTES_SCORE) if stop - start == 1 else None)
                if hit and (score is None or best[start] + hit[1] > score):
                    score, way = best[start] + hit[1], (start, hit[0])
            best.append(score)
            back.append(way)
        ids, at = [], n
        while at:
            at, i = back[at]
            ids.append(i)
        return spelt(ids[::-1], v)
    edges = [(-hit[1], s, s + k, hit[0]) for s in range(n) for k in range(2, min(v.longest, n - s) + 1) if (hit := v.table.get(unit[s : s + k]))]
    ids = [-ord(c) - 1 for c in unit]
    follow, live = list(range(1, n + 2)), [True] * (n + 1)
    for _, s, e, i in sorted(edges):
        mid = follow[s]
        if live[s] and mid < e and follow[mid] == e:
            follow[s], live[mid], ids[s] = e, False, i
    return spelt([i for i, ok in zip(ids, live, strict=False) if ok], v)


def spelt(ids: list[int], v: Vocabulary) -> list[int]:
    """ids with the pieces of characters -c - 1: their own, or those of their bytes."""
    out = []
    for i in ids:
        if i >= 0 or v.char_id[-i - 1] >= 0:
            out.append(i if i >= 0 else int(v.char_id[-i - 1]))
        else:
            out += [v.spell[b] for b in chr(-i - 1).encode("utf-8", "surrogatepass")]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + sizes[i]."""
    total = int(sizes.sum())
    return np.arange(total, dtype=np.int32) + np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)


def _bytes_of(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return np.take(v.pool, _ranges(np.take(v.place, ids), np.take(v.width, ids)))


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """Text of ids: pieces joined, SPACE turned into spaces, the first space dropped."""
    text = _bytes_of(ids, v).tobytes().decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


class _Dictionary:
    """Hashes of units (sorted), and the ids of each in one array. Units that need byte pieces are left out."""

    def __init__(self, units: list[str], paths: np.ndarray, v: Vocabulary):
        length = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(length) - length
        c = _points("".join(units)).astype(_U)
        row = np.repeat(np.arange(len(units)), length)
        cut = np.flatnonzero((paths[row] >> (np.arange(len(c)) - begin[row])) & 1)
        ids = v.ids_of(_hashes(c, np.append(cut, len(c))))
        ok = np.ones(len(units), bool)
        ok[row[cut[ids < 0]]] = False
        size = np.bincount(row[cut], minlength=len(units))
        h = _hashes(c, np.append(begin, len(c)))
        order = np.argsort(h)
        order = order[ok[order]]
        self.h, self.size, self.at, self.flat = h[order], size[order], (np.cumsum(size) - size)[order], ids

    def find(self, h: np.ndarray):
        """Place of each hash, and which of them are here."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h


def _ids_of(texts: list[str], known: _Dictionary | None, v: Vocabulary, fold: str):
    """Flat ids of some texts (as shown), and where each text's ids start and end."""
    joined, edge, h, first = cut_units(texts, v)
    u, one, which = np.unique(h if known else np.arange(len(h)), return_index=True, return_inverse=True)
    at, here = known.find(u) if known else (np.zeros(len(u), np.int64), np.zeros(len(u), bool))
    size = np.zeros(len(u), np.int64)
    start = np.zeros(len(u), np.int64)
    if here.any():
        size[here], start[here] = known.size[at[here]], known.at[at[here]]
    # What the dictionary lacks: characters alone, long units, units with byte pieces.
    more, n = [], len(known.flat) if known else 0
    for k in np.flatnonzero(~here).tolist():
        own = long_unit_ids(joined[edge[one[k]] : edge[one[k] + 1]], v, fold)
        size[k], start[k] = len(own), n
        more += own
        n += len(own)
    table = np.concatenate([known.flat if known else np.zeros(0, np.int32), np.array(more, np.int32)])
    size = size[which]
    flat = np.take(table, _ranges(start[which], size)).astype("<i4")
    return flat, np.concatenate([[0], np.cumsum(size)])[first]


def _assemble(path: str, fold: str, keep_ids: bool):
    def run(key, left, right):
        v = vocabulary(path)
        known, out = _Dictionary(right.column("unit").to_pylist(), right.column("path").to_numpy(), v), []
        for blob in left.column("texts").to_pylist():
            rows = pa.ipc.open_stream(blob).read_all()
            docs, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            flat, cut = _ids_of(texts, known, v, fold)
            # Decoding all at once; where it differs, text by text, without the dictionary.
            whole = _bytes_of(flat, v).tobytes() == "".join(texts).encode("utf-8", "surrogatepass")
            raw = flat.tobytes()
            for doc, text, a, z in zip(docs, texts, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own, same = raw[4 * a : 4 * z], whole
                if not whole:
                    want = text[1:].replace(SPACE, " ")
                    if decode(flat[a:z], v) != want:
                        own = _ids_of([text], None, v, fold)[0].tobytes()
                    same = decode(np.frombuffer(own, "<i4"), v) == want
                out.append((doc, len(own) // 4, zlib.crc32(own), same, own if keep_ids else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, keep_ids: bool = False, fold: str = "merges") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian 32-bit ids), round_trip (decoding gives the text back), ids."""
    spark = docs.sparkSession
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:  # not a table of files: write it, so that its splits have names
        docs = saved(docs.select("doc_id", "text"), "docs")
    chunk = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chunk.alias("chunk"))
    v = vocabulary(model_path)
    # One shuffle by unit serves both: units are made distinct and folded where their packets already are.
    pairs = rows.select("text", "chunk").mapInArrow(_distinct(model_path), "packet long, unit string").repartition("unit")
    ids = encode_units(pairs.groupBy("unit").agg(F.min("packet").alias("low")).where("low IS NOT NULL"), piece_table(spark, model_path), v, fold)
    known = pairs.join(ids, "unit").select("packet", "unit", "path")
    texts = rows.mapInArrow(_pack, "packet long, texts binary")
    out = texts.groupBy("packet").cogroup(known.groupBy("packet")).applyInArrow(_assemble(model_path, fold, keep_ids), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids binary")
    return out if keep_ids else out.drop("ids")
