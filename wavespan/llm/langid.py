"""Language identification: script ranges narrow the candidates of a word, then Viterbi labels spans.

Learning counts, over all training documents, letters by script and hashed letter trigrams (with word
boundaries) by language. A word's score in a language is the sum of its trigrams' log-probabilities; a language
is a candidate for a word only if it is written in the word's script. Viterbi over the words of a text, with a
penalty for each switch, labels every word; runs of equal labels are spans, and the language with most words is
the prediction.

Defined cases
* null text or no letter: lang_pred 'und', score 0, no spans. Nothing learned at all: 'und', score 0.
* null lang: not learned from. Null doc_id: fold 0, so learned from like others.
* a word in a script that no language was learned in: all languages are candidates.
* ties: the language first in alphabetical order. Repeated rows: each is returned, and counts. Other columns are
  ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import blocks, code_points, letter_table
from .common import fold

BITS = 16
#: Cost of a switch of language between two words, in nats.
SWITCH = 12.0
#: A script belongs to a language that has this share of its training letters in it.
SCRIPT_SHARE = 0.01
#: First code points of Unicode script ranges, each up to the next one.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2C00, 0x3040, 0x3100, 0xAC00, 0xD7B0, 0x20000])
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "hangul", "other", "latin", "greek", "other", "kana", "han", "hangul", "other", "han")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
SCRIPT_IDS = np.array([SCRIPTS.index(x) for x in SCRIPT_NAMES])


def _letters(texts: list[str | None]):
    """For each letter: its trigram bucket, script, word number; for each word: its text."""
    code, ends = code_points(texts)
    letter = letter_table()[code]
    c = np.where(letter, code, np.uint32(0)).astype(np.uint32)
    before, after = np.concatenate([[np.uint32(0)], c[:-1]]), np.concatenate([c[1:], [np.uint32(0)]])
    at = np.flatnonzero(letter)
    h = (before[at] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA6B)) ^ (after[at] * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    starts = before[at] == 0
    script = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, c[at], side="right") - 1]
    return (h >> np.uint32(32 - BITS)).astype(np.int64), script, np.flatnonzero(starts), np.searchsorted(ends, at[starts])


def _count(batches):
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for b in batches:
        rows = list(zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True))
        for run in blocks(rows, lambda r: len(r[0] or "")):
            for lang in {r[1] for r in run}:
                h, s, _, _ = _letters([t for t, x in run if x == lang])
                grams[lang] = grams.get(lang, 0) + np.bincount(h, minlength=1 << BITS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(s, minlength=len(SCRIPTS))
    for lang in grams:
        for kind, counts in (("gram", grams[lang]), ("script", scripts[lang])):
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": [lang] * len(at), "kind": [kind] * len(at), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())}, schema=pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, allowed: np.ndarray):
        self.langs, self.logp, self.allowed = langs, logp, allowed


def train(docs: DataFrame) -> Model:
    """docs: text, lang. The result has 2**BITS numbers for each language, whatever the size of the table."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    got = rows.mapInArrow(_count, "lang string, kind string, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    logp, allowed = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros((len(SCRIPTS), len(langs)), bool)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        g, s = own[own["kind"] == "gram"], own[own["kind"] == "script"]
        counts = np.zeros(1 << BITS)
        counts[g["bucket"]] = g["n"]
        # The floor is one in a million of the language, so that scores are alike at every size.
        logp[:, k] = np.log(counts / max(counts.sum(), 1) + 1e-6)
        allowed[s["bucket"], k] = s["n"].to_numpy() >= SCRIPT_SHARE * s["n"].sum()
    allowed[~allowed.any(1)] = True
    return Model(langs, logp, allowed)


def _viterbi(scores: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray, docs: np.ndarray) -> None:
    """Best label of every word of the given texts, side by side. scores: words x languages; out: labels."""
    langs = scores.shape[1]
    order = docs[np.argsort(-size[docs], kind="stable")]
    while len(order):
        n = max(1, min(len(order), 2_000_000 // max(1, int(size[order[0]]))))
        now, order = order[:n], order[n:]
        steps = int(size[now[0]])
        back = np.zeros((steps, n, langs), np.int16)
        value = scores[start[now]].astype(np.float64)
        for t in range(1, steps):
            live = int(np.searchsorted(-size[now], -t, side="left"))
            v = value[:live]
            best = v.argmax(1)
            jump = v[np.arange(live), best] - SWITCH
            stay = v >= jump[:, None]
            back[t, :live] = np.where(stay, np.arange(langs), best[:, None])
            value[:live] = np.where(stay, v, jump[:, None]) + scores[start[now[:live]] + t]
        label = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = int(np.searchsorted(-size[now], -t, side="left"))
            out[start[now[:live]] + t] = label[:live]
            label[:live] = back[t, np.arange(live), label[:live]]


def _label(texts: list[str | None], m: Model):
    """Label of each word, first word and number of words of each text."""
    h, script, first, doc = _letters(texts)
    size = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(size) - size
    if not len(first):
        return np.zeros(0, np.int64), start, size
    scores = np.add.reduceat(m.logp[h].astype(np.float64), first, axis=0)
    scores[~m.allowed[script[first]]] -= 1e3
    total = np.add.reduceat(scores, start[size > 0], axis=0)
    best = np.zeros(len(texts), np.int64)
    best[size > 0] = total.argmax(1)
    label = np.repeat(best, size)
    # A text stays in one language unless some stretch gains more than a switch in another one.
    gain = scores - scores[np.arange(len(label)), label][:, None]
    mixed = np.zeros(len(texts), bool)
    for k in range(len(m.langs)):
        c = np.cumsum(np.maximum(gain[:, k], 0))
        c = np.concatenate([[0], c])
        at = np.flatnonzero(size > 0)
        mixed[at] |= c[start[at] + size[at]] - c[start[at]] > SWITCH
    todo = np.flatnonzero(mixed & (size > 1))
    if len(todo):
        _viterbi(scores, start, size, label, todo)
    return label, start, size


def _tagger(held):
    def run(batches):
        m = held.value
        for b in batches:
            pred, score, spans = [], [], []
            for part in blocks(b.column("text").to_pylist(), lambda t: len(t or ""), max(1 << 14, (1 << 22) // max(1, len(m.langs)))):
                if not m.langs:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    spans += [[]] * len(part)
                    continue
                label, start, size = _label(part, m)
                for s, n in zip(start, size, strict=True):
                    if not n:
                        pred.append("und")
                        score.append(0.0)
                        spans.append([])
                        continue
                    own = label[s : s + n]
                    counts = np.bincount(own, minlength=len(m.langs))
                    pred.append(m.langs[int(counts.argmax())])
                    score.append(float(counts.max() / n))
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]])
                    spans.append([{"first_word": int(a), "n_words": int(z - a), "lang": m.langs[int(own[a])]} for a, z in zip(cut[:-1], cut[1:], strict=True)])
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return run


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of words in that language), spans of words by language. One narrow pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_tagger(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, spans array<struct<first_word long, n_words long, lang string>>")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every document."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return tag(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
