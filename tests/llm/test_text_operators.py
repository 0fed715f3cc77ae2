import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import DATA, same
from pyspark.sql import functions as F
from wavespan.llm import ann, langid, linededup, maxent, ngramjoin, packing, pieces, quality, suffixdedup, toxicity
from wavespan.llm.graph import components
from wavespan.llm.queries import PIECES, SQL, WORD_BPE

SEPARATED = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


def crc(i, mod):
    return (zlib.crc32(str(i).encode()) if i is not None else 0) % mod


def xxhash64_twins():
    """Two texts of 128 characters with one xxhash64 (seed 42), and so with one of it chained with any other value."""
    m, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F

    def lane(acc, x):
        acc = (acc + x * p2) & m
        return (((acc << 31) | (acc >> 33)) & m) * p1 & m

    rng, word = np.random.default_rng(5), lambda b: int.from_bytes(b, "little")
    base = bytes(rng.integers(97, 123, 128).tolist())
    while True:
        other = bytes(rng.integers(97, 123, 8).tolist())
        away = (lane(42, word(base[16:24])) - lane(42, word(other))) & m
        second = ((word(base[48:56]) + away * pow(p2, -1, 1 << 64)) & m).to_bytes(8, "little")
        if all(c < 128 and c not in b"\r\n\t\v\f " for c in second):
            return base.decode(), (base[:16] + other + base[24:48] + second + base[56:]).decode()


# Rows by SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    from wavespan.llm.queries import QUERIES

    same(QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df())


# 1


@pytest.mark.parametrize("rerank", [60, 1000])
def test_nearest_neighbours(spark, monkeypatch, rerank):
    """Also where codes decide: 60 of 2,000 vectors are reranked. Queries in several blocks, partitions in several groups."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    monkeypatch.setattr(ann, "GROUP", 2)
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(7, "vec_id")
    assert v.count() == 2000
    got = ann.search(v, F.col("vec_id") % 20 == 0, rerank=rerank).toPandas()
    t = v.toPandas()
    x, ids, hit, n = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy(), 0, 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        true = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = got[got["query_id"] == q].sort_values("rank")
        hit, n = hit + len(set(own["vec_id"]) & set(ids[true])), n + 10
        assert np.allclose(own["score"], [d[ids == i][0] for i in own["vec_id"]])
    assert hit / n >= 0.9


def test_nearest_edge_cases(spark):
    bad = [(900, None), (901, [0.0, 0.0]), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [1.0, float("inf")]), (905, [1.0]), (None, [1.0, 1.0])]
    same_ = [(100, [1.0, 2.0])] + [(k, [1.0, 2.0]) for k in range(1, 30)] + [(200, [1.0, 3.0]), (200, [1.0, 3.0]), (300, [5.0, 5.0])]
    df = spark.createDataFrame(bad + same_, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == list(range(1, 11))
    assert [r["vec_id"] for r in got if r["query_id"] == 200] == list(range(1, 11)) and len({r["query_id"] for r in got}) == 3
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_codes_beat_a_single_book():
    x = np.random.default_rng(0).normal(size=(600, 8))
    c = ann.fit(x, 4, 16)
    many = ((x - c[np.arange(4), ann.encode(x, c)].sum(1)) ** 2).sum()
    wide = ((x - c[np.arange(4), ann.encode(x, c, beam=1)].sum(1)) ** 2).sum()
    assert many <= wide < (x**2).sum() / 2


# 2


def brute_viterbi(word, v):
    best = [(0.0, [])] + [(-math.inf, [])] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            hit = v.table.get(word[s:e])
            if hit is None and e - s == 1:
                hit = (-ord(word[s]) - 1, pieces.BYTES_SCORE)
            if hit and best[s][0] + hit[1] > best[e][0]:
                best[e] = (best[s][0] + hit[1], [*best[s][1], hit[0]])
    return pieces.spelt(best[-1][1], v)


LONG = ["international" * 12, "x" * 46 + "tion" * 30, "日本語の文章は空白がない" * 10, "aGVsbG8gd29ybGQ/" * 9, "\U0001f600the" * 20, "a" * 47, "a" * 48, "a" * 1000, "http://www." + "example-page/" * 6]
ODD = ["  two  spaces   and more ", " ", "▁ own mark▁", "tab\tline\n\n  end", "\x00nul\x00", "e\u0301 ﬁ \r"]


def test_pieces_are_those_of_the_library(spark, docs, rows, edge, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in pieces.encode(docs, PIECES, keep_ids=True).collect()}
    for r in rows:
        own = got[r["doc_id"]]
        assert np.frombuffer(own["ids"], "<i4").tolist() == library.encode(r["text"] or ""), r["doc_id"]
        assert own["round_trip"] and own["ids_crc32"] == zlib.crc32(own["ids"]) and own["n_pieces"] == len(own["ids"]) // 4
    texts = [*LONG, *ODD, f"the {LONG[0]} and {LONG[2]}"]
    more = {r["doc_id"]: r for r in pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES, keep_ids=True).collect()}
    for k, text in enumerate(texts):
        assert np.frombuffer(more[k]["ids"], "<i4").tolist() == library.encode(text) and more[k]["round_trip"], text
    more = pieces.encode(edge, PIECES).collect()
    assert len(more) == 10 and all(r["round_trip"] for r in more) and {r["n_pieces"] for r in more if r["doc_id"] in (2, 3)} == {0}
    assert pieces.encode(empty, PIECES).count() == 0


@pytest.mark.parametrize("fold", ["merges", "viterbi"])
def test_both_folds_alike_in_lattice_and_task(spark, fold):
    """The lattice and the fold in a task give the same ids, and Viterbi those of brute force."""
    v = pieces.vocabulary(PIECES)
    units = sorted({x for t in [*LONG, *ODD] for x in [pieces.shown(t)]})
    units = sorted({u[k : k + 40] for u in units for k in range(0, len(u), 13)})
    cut = lambda u, path: [u[a:z] for at in [[k for k in range(len(u) + 1) if path >> k & 1]] for a, z in zip(at, at[1:])]
    got = {r["unit"]: pieces.spelt([v.table[x][0] if x in v.table else -ord(x) - 1 for x in cut(r["unit"], r["path"])], v) for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces.piece_table(spark, PIECES), v, fold).collect()}
    assert len(got) > 20
    for u in got:
        assert got[u] == pieces.long_unit_ids(u, v, fold)
        if fold == "viterbi":
            assert got[u] == brute_viterbi(u, v)


def test_packets_of_few_texts(spark, docs, rows, monkeypatch):
    """Many packets in a split, and hashes that all collide, change nothing."""
    monkeypatch.setattr(pieces, "PACKET", 2000)
    monkeypatch.setattr(pieces, "BLOB", 500)
    batch = pa.record_batch({"doc_id": pa.array([r["doc_id"] for r in rows[:40]]), "text": pa.array([r["text"] for r in rows[:40]]), "chunk": pa.array([7] * 40, pa.int64())})
    units, texts = (pa.Table.from_batches(list(f([batch]))).to_pydict() for f in (pieces._distinct(PIECES), pieces._pack))
    v, whole = pieces.vocabulary(PIECES), {r["doc_id"]: r for r in pieces.encode(docs, PIECES).collect()}
    distinct = spark.createDataFrame([(u,) for u in sorted(set(units["unit"]))], "unit string")
    path_of = pieces.encode_units(distinct, pieces.piece_table(spark, PIECES), v).collect()
    assert len(set(units["packet"])) > 5 and set(units["packet"]) == set(texts["packet"])
    for broken in (False, True):
        for p in set(texts["packet"]):
            own = [u for q, u in zip(units["packet"], units["unit"], strict=True) if q == p]
            paths = [r["path"] for r in path_of if r["unit"] in own]
            right = pa.table({"unit": [r["unit"] for r in path_of if r["unit"] in own], "path": pa.array(paths, pa.int64())})
            if broken:
                monkeypatch.setattr(pieces, "_hashes", lambda c, edge, f=pieces._hashes: f(c, edge) & np.uint64(255))
            left = pa.table({"texts": pa.array([t for q, t in zip(texts["packet"], texts["texts"], strict=True) if q == p], pa.binary())})
            for r in pieces._assemble(PIECES, "merges", False)(None, left, right).to_pylist():
                assert all(r[c] == whole[r["doc_id"]][c] for c in ("n_pieces", "ids_crc32", "round_trip"))


# 3


def brute_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        data = (r[1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((r[0], len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats(docs, rows, hot):
    got = sorted(tuple(r) for r in suffixdedup.suffix_dedup(docs, hot).collect())
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in rows])


def test_repeats_edge_cases(spark, edge, empty):
    texts = [(1, "a" * 250), (2, "x" + "ab" * 60), (3, "ab" * 55 + "é" * 60), (4, "é" * 49 + "q"), (5, "a" * 100), (6, "ab" * 49 + "a")]
    got = sorted(tuple(r) for r in suffixdedup.suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == brute_repeats(texts)
    rows = suffixdedup.suffix_dedup(edge).collect()
    assert len(rows) == 10 and {(r["n_bytes"], r["n_removed"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0)}
    six = next(r for r in rows if r["doc_id"] == 6)
    assert six["n_removed"] == six["n_bytes"] and six["n_spans"] == 1
    cut = suffixdedup.remove_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == 10 and cut.where("doc_id = 6").first()["text"] == ""
    assert suffixdedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_of_texts_with_one_hash(spark, hot):
    """Texts that share no string, but a 64-bit hash."""
    a, b = xxhash64_twins()
    df = spark.createDataFrame([(1, a), (2, b), (3, a + "x"), (4, "y" + b)], "doc_id long, text string")
    assert df.where("doc_id < 3").select(F.countDistinct(F.xxhash64("text"), F.xxhash64("text", F.lit(1)))).first()[0] == 1
    assert sorted(tuple(r) for r in suffixdedup.suffix_dedup(df, hot).collect()) == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeats_with_shared_or_no_ids(spark, hot):
    """Different texts with one id, or none, are documents of their own, of any length and with copies elsewhere."""
    p, q, r = ("".join(np.random.default_rng(k).choice(list("abcdefgh"), 400)) for k in range(3))
    texts = [(1, p), (2, q + p[:150]), (2, r[:220]), (None, p), (None, "own " + r + q[:130]), (None, "short"), (None, q[5:125]), (None, "x" * 105 + r[100:250]), (2**63 - 1, r[30:390])]
    df = spark.createDataFrame([*texts, texts[4]], "doc_id long, text string")
    order = {(x["doc_id"], x["text"]): x["h"] for x in df.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text", F.lit(3)), 1).alias("h")).collect()}
    ranked = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0, order[x] if x[0] is None else -order[x]))
    want = [(ranked[x[0]][0], *x[1:]) for x in brute_repeats([(k, x[1]) for k, x in enumerate(ranked)])]
    want += [want[ranked.index(texts[4])]]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(x) for x in suffixdedup.suffix_dedup(df, hot).collect()), key=key) == sorted(want, key=key)
    assert suffixdedup.remove_repeats(df, hot).count() == 10


# 4


def test_language_model(docs, rows, edge, empty):
    got = {r["doc_id"]: r for r in maxent.lm_scores(docs).collect()}
    tokens = {r["doc_id"]: [*SEPARATED.findall((r["text"] or "").translate(LOWER)), None] for r in rows}
    c = collections.Counter(w for i, t in tokens.items() if crc(i, 5) != 1 for w in t)
    n = sum(c.values())
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 5) == 1, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    more = maxent.lm_scores(edge).collect()
    assert len(more) == 10 and {r["n_tokens"] for r in more if r["doc_id"] in (2, 3, 7)} == {1}
    assert maxent.lm_scores(empty).count() == 0


def test_language_model_counts_frequent_words_in_all_documents(spark):
    texts = [f"rare{k % 70} rare{k % 71} common{k % 3}" for k in range(5000)]
    texts[4000:4003] = [" ".join([f"late{j}"] * 9000) for j in range(3)]
    found, cluster = maxent.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    c = collections.Counter(int(w) for t in texts for w in maxent._tokens([t.encode()])[0][:-1])
    assert len(cluster) == maxent.FREQUENT + 1 and sorted(c[int(w)] for w in found) == sorted(c.values())[-maxent.FREQUENT :]


def test_language_model_probabilities(spark):
    """Of a small vocabulary, probabilities of all words and of the unseen ones sum up to 1; recomputed one by one, they are the same."""
    rnd = np.random.default_rng(1)
    w = rnd.integers(1 << 40, 1 << 50, 300)
    tokens = np.concatenate([rnd.choice(w, 400), [maxent.END]])
    doc, start = np.zeros(401, np.int64), np.zeros(1, np.int64)
    frequent = np.sort(w[:64])
    words = np.concatenate([np.unique(w), [maxent.END, 5]])
    c = np.concatenate([np.arange(len(words) - 2) % 9 + 1, [40, 0]])
    head = np.flatnonzero(c[:-2] > 6)
    kind = np.where(c <= 1, 0, 2 + words % 3 * maxent.BANDS + np.searchsorted(maxent.BAND_COUNTS, c, side="right"))
    spot, room = np.zeros(len(words), np.int64), np.ones(256, np.int64)
    kind[-2] = 1
    for k, x in enumerate(head):
        kind[x], spot[x] = maxent.FIRST_HEAD + k // 40, k % 40
        room[kind[x]] = spot[x] + 1
    mass = np.bincount(kind, c, maxent.CLASSES)
    counts = maxent.Counts(int(c.sum()), len(words) - 1, int((c == 1).sum()), int((c == 2).sum()), mass)
    weights = tuple(rnd.normal(size=(1 << counts.bits, n)).astype(np.float32) for n in (maxent.CLASSES, maxent.IN_CLASS))
    empty = np.setdiff1d(np.arange(maxent.CLASSES), kind)
    weights[0][0, empty] = -1e9
    for at in (0, 1, 57, 400):
        total = 0.0
        for x in range(len(words)):
            t = tokens.copy()
            t[at] = words[x]
            args = [np.full(401, v) for v in (c[x], kind[x], spot[x])]
            lp = maxent.log_probabilities(t, doc, start, *args, frequent, room, weights, counts)[at]
            f = maxent._features(t, doc, start, maxent._last_frequent(t, doc, start, frequent), counts.bits)[at]
            z = sum(weights[0][k].astype(float) for k in f)
            own = z[kind[x]] - np.log(np.exp(z).sum())
            if kind[x] >= maxent.FIRST_HEAD:
                z = sum(weights[1][k].astype(float) for k in maxent._word_features(f[None], kind[x : x + 1], counts.bits)[0])[: room[kind[x]]]
                own += z[spot[x]] - np.log(np.exp(z).sum())
            elif kind[x]:
                own += np.log(c[x] / mass[kind[x]])
            else:
                own += np.log(counts.unseen / counts.missing if c[x] == 0 else (1 - counts.unseen) / counts.once)
            assert math.isclose(lp, own, rel_tol=1e-4, abs_tol=1e-4)
            total += np.exp(lp) * (counts.missing if c[x] == 0 else 1)
        assert math.isclose(total, 1, rel_tol=1e-3)


def test_language_model_ranks_text_above_junk(spark):
    """Held-out prose gains over the base, and strings of random consonants score under all of it."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = np.random.default_rng(2)
    ids = [i for i in range(1 << 20, (1 << 20) + 40) if crc(i, 5) == 1]
    junk = [(i, " ".join("".join(rnd.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(200))) for i in ids]
    t = maxent.lm_scores(d.unionAll(spark.createDataFrame(junk, "doc_id long, text string"))).toPandas()
    t["each"], t["gain"] = t["score"] / t["n_tokens"], (t["score"] - t["base_score"]) / t["n_tokens"]
    bad, good = t[t["doc_id"].isin(ids)], t[~t["doc_id"].isin(ids) & t["held_out"] & (t["n_tokens"] > 50)]
    assert bad["each"].max() < good["each"].quantile(0.02)
    assert good[good["n_known"] > 0.9 * good["n_tokens"]]["gain"].mean() > 0.1 and good["gain"].mean() > 0.1


# 5


def test_toxicity(spark, edge, empty, labels):
    d = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{d}/labels.parquet")
    t = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), marks).join(marks, "doc_id").toPandas()
    assert (t["held_out"] == [crc(i, 3) == 1 for i in t["doc_id"]]).all() and t["score"].between(0, 1).all()
    own = t[t["held_out"]]
    assert own[own["toxic"] == 1]["predicted"].mean() > 0.6 and own[own["toxic"] == 0]["predicted"].mean() < 0.02
    got = toxicity.toxicity(edge, labels)
    assert got.count() == 10 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(edge, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.reject_toxic(edge, labels).columns == edge.columns


# 6


def test_line_dedup_edge_cases(spark, edge, empty):
    same_line = "the very same line"
    texts = [(k, f"{same_line}\nown {k}\n{same_line.upper()} ", f"s{k}") for k in range(10)]
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert out[0] == f"{same_line}\nown 0" and all(out[k] == f"own {k}" for k in range(1, 10))
    got = linededup.line_dedup(edge)
    assert got.count() == 10 and got.columns == edge.columns and got.where("doc_id = 3").first()["text"] is None
    assert linededup.report(empty).count() == 0
    # Rows without id, or with one id, are documents of their own: one of them keeps the line.
    nameless = [(None, f"{same_line}\nown {k}", f"s{k}") for k in range(9)] + [(5, f"the second\nown {k}", f"s{k}") for k in range(9)]
    left = [r["text"] for r in linededup.line_dedup(spark.createDataFrame([*nameless, nameless[0]], "doc_id long, text string, source string")).collect()]
    assert len(left) == 19 and 1 <= sum(t.startswith(same_line) for t in left) <= 2 and sum(t.startswith("the second") for t in left) == 1


INTERNAL = ["row", "doc", "th", "nameless", "bad", "kept", "n_lines", "n_removed", "h1", "h2", "first", "line", "site", "score", "_doc", "_tie", "_runs", "_shared", "_toxic_score", "_n_lines", "_kept", "_bad_lines", "y", "n", "component", "lead", "a.b", "tie", "runs"]


@pytest.mark.parametrize("stage", [linededup.line_dedup, suffixdedup.remove_repeats, ngramjoin.keep_one, None])
def test_stages_pass_columns_of_any_name(spark, edge, labels, stage):
    docs = edge.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(INTERNAL)])
    out = stage(docs) if stage else toxicity.reject_toxic(docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == k for r in rows for k, c in enumerate(INTERNAL))


# 7


def test_language_id(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (t[t["held_out"]]["lang"] == t[t["held_out"]]["lang_pred"]).mean() > 0.97
    assert (t["held_out"] == [crc(i, 4) == 2 for i in t["doc_id"]]).all()
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.language_id(edge).collect()}
    assert {g[0] for g in got if g[1] == "und"} == {2, 3, 7} and langid.language_id(edge).count() == 10
    assert langid.language_id(empty).count() == 0


def test_mixed_spans_and_viterbi(spark):
    en, de = "the thing that there with other", "und der nicht schön über die"
    train = spark.createDataFrame([(en * 3, "en"), (de * 3, "de"), ("привет как дела что", "ru")], "text string, lang string")
    m = langid.train(train)
    row = langid.tag(spark.createDataFrame([(1, f"{en} {de} привет")], "doc_id long, text string"), m).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"] and sum(s["n_words"] for s in row["spans"]) == 13
    rnd = np.random.default_rng(0)
    scores, size = rnd.normal(scale=15, size=(40, 3)), np.array([25, 15])
    start, out = np.array([0, 25]), np.zeros(40, np.int64)
    langid._viterbi(scores, start, size, out, np.array([0, 1]))
    for s, n in zip(start, size, strict=True):
        best = scores[s]
        for k in range(1, n):
            best = np.array([max(best[j] - langid.SWITCH * (i != j) for j in range(3)) for i in range(3)]) + scores[s + k]
        own = out[s : s + n]
        assert math.isclose(best.max(), scores[np.arange(s, s + n), own].sum() - langid.SWITCH * (np.diff(own) != 0).sum())


# 8


def check_packing(packed, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_packing(docs, rows, edge, empty):
    check_packing(packing.pack(docs.repartition(20), WORD_BPE).collect(), {r["doc_id"]: r["text"] for r in rows})
    once = edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(packing.pack(once, WORD_BPE).collect(), {r["doc_id"]: r["text"] for r in once.collect()})
    total = packing.pack(edge, WORD_BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] / r["t"] for r in total} == {1: 2, 2: 1, 3: 1, None: 1, 5: 2, 6: 1, 7: 1, 8: 1}
    assert packing.pack(empty, WORD_BPE).count() == 0


# 9


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = SEPARATED.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent,gather", [(3, 90, 512), (3, 90, 1), (5, 80, 512)])
def test_ngram_join(docs, rows, width, percent, gather):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(docs, width, percent, gather).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows], width, percent)


def test_ngram_join_of_words_with_one_sum(spark):
    """The two words made by doubling have equal sums of powers of any odd number, modulo 2^64."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [(1, f"one two {a} three four"), (2, f"one two {b} three four"), (3, f"{a} {b}"), (4, f"{b} {a}")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_components(texts, 3, 90) and len({c for _, c in got.values()}) == 4


def test_ngram_join_of_a_large_group(spark):
    rnd = np.random.default_rng(3)
    base = [f"t{k}" for k in range(150)]
    texts = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in rnd.choice(150, rnd.integers(1, 4), replace=False):
            w[k] = f"n{i}_{k}"
        texts.append((i, " ".join(w)))
    texts += [(50, "a b"), (51, "A b"), (52, "a"), (53, None), (54, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for gather in (512, 4):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(df, 3, 90, gather).collect()}
        assert got == brute_components(texts, 3, 90)


def test_components(spark):
    """Chains with rising, falling and mixed ids, stars round the smallest and the largest, links to oneself, a random graph."""
    rnd = np.random.default_rng(11)
    mixed = rnd.permutation(np.arange(2000, 2100)).tolist()
    links = [(k, k + 1) for k in range(100)] + [(k + 1, k) for k in range(200, 300)] + list(zip(mixed, mixed[1:], strict=False))
    links += [(1000, k) for k in range(1001, 1050)] + [(k, 1199) for k in range(1100, 1199)] + [(5000, 5000), (5001, 5001), (5001, 5002)]
    links += [(int(a), int(b)) for a, b in rnd.integers(-400, 0, (180, 2))]
    root = {x: x for link in links for x in link}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    got = components(spark.createDataFrame(links + links[:50], "a long, b long")).collect()
    assert len(got) == len(root) and {r["node"]: r["label"] for r in got} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_regions_of_pivots_lose_no_link(monkeypatch, percent):
    """Recursion by pivots and windows gives the components of all pairs, and regions are really divided."""
    rnd = np.random.default_rng(5)
    sets = []
    for g in range(12):
        base = rnd.choice(1 << 40, 120, replace=False) + g
        for _ in range(30):
            own = base.copy()
            k = rnd.integers(0, 20)
            own[rnd.choice(120, k, replace=False)] = rnd.integers(1 << 41, 1 << 42, k)
            sets.append(np.unique(own.astype(np.uint64)))
    calls = []
    monkeypatch.setattr(ngramjoin, "LEAF", 8)
    monkeypatch.setattr(ngramjoin, "_join_region", lambda at, *a, f=ngramjoin._join_region: calls.append(len(at)) or f(at, *a))
    order = rnd.permutation(len(sets))
    got = ngramjoin._pairs_of_cluster([sets[k] for k in order], percent)
    own = [set(sets[k].tolist()) for k in order]
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            n = len(own[i] & own[j])
            if n and 100 * n >= percent * (len(own[i]) + len(own[j]) - n) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == root and len(set(root)) > 12 and len(calls) > 5 and min(calls) < 60


def test_links_between_components_of_two_pivots_are_kept():
    """Chains: each document links to the next one alone, so a lost link divides the component."""
    rnd = np.random.default_rng(0)
    for _ in range(20):
        n = int(rnd.integers(9, 60))
        names = rnd.integers(1, 1 << 63, 100 + 5 * n, dtype=np.uint64)
        assert set(ngramjoin._pairs_of_cluster([np.sort(names[5 * k : 5 * k + 100]) for k in rnd.permutation(n)], 90)) == {0}


def test_groups_of_the_registered_query_are_joined_by_pivots(spark, monkeypatch):
    """Groups of candidates of a given table: those of three documents or more are divided by pivots."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    left = ngramjoin.candidates(docs, ngramjoin._collapsed(docs, 3), 3, 90)
    group = components(left.select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct())
    rows = docs.join(group, docs.doc == group.node).select("label", "doc", "text").orderBy("label", "doc").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["label"]].append(r["text"].encode())
    calls = []
    monkeypatch.setattr(ngramjoin, "_far_apart", lambda *a, f=ngramjoin._far_apart: calls.append(len(a[0])) or f(*a))
    for texts in groups.values():
        ngramjoin._pairs_of_cluster(ngramjoin.shingle_sets(texts), 90)
    assert len(calls) >= sum(len(g) > 2 for g in groups.values()) > 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50)])
def test_partners_share_enough_regions(docs, rows, width, percent):
    """Every link is among the candidates, in one annulus at least, with the company that it needs."""
    sets = [s for s in ngramjoin.shingle_sets([(r["text"] or "").encode() for r in rows], width) if len(s) > 1]
    more = [np.unique(np.concatenate([s[: -max(1, len(s) // 12)], s[:1] + np.uint64(1)])) for s in sets[:150]]
    sets += more
    d, key, shift, need = ngramjoin._regions(sets, percent)
    own = [{k: set(key[(d == i) & (shift == k)].tolist()) for k in (0, 1)} for i in range(len(sets))]
    least = {(i, k): n for i, k, n in zip(d.tolist(), shift.tolist(), need.tolist(), strict=True)}
    n_links = 0
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and not np.array_equal(sets[i], sets[j]):
                n_links += 1
                assert any(len(own[i][a] & own[j][b]) >= max(least.get((i, a), 9**9), least.get((j, b), 9**9)) for a in (0, 1) for b in (0, 1)), (i, j)
    assert n_links > 100


@pytest.mark.parametrize("gather", [16, 512])
def test_groups_held_together_by_common_passages_are_divided(spark, monkeypatch, gather):
    """Documents with four fifths of their words in common are candidates, but no partners: only those with near copies are joined."""
    rnd = np.random.default_rng(7)
    common, texts = [f"c{k}" for k in range(120)], []
    for i in range(150):
        texts.append((i, " ".join(common + [f"u{i}_{k}" for k in range(30)])))
    for i in range(150, 210):
        words = texts[i % 20][1].split()
        words[rnd.integers(0, 150)] = f"n{i}"
        texts.append((i, " ".join(words)))
    handed = []

    def joined(sets, nodes, percent, f=ngramjoin._join_large):
        handed.append(nodes.count())
        return f(sets, nodes, percent)

    monkeypatch.setattr(ngramjoin, "_join_large", joined)
    df = spark.createDataFrame([texts[k] for k in rnd.permutation(len(texts))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_join(df, 5, 80, gather).collect()}
    assert got == brute_components(texts, 5, 80) and len({c for _, c in got.values()}) == 150
    assert sum(handed) < 100


@pytest.mark.parametrize("percent", [80, 90])
def test_rare_shingles_lose_no_link(spark, monkeypatch, percent):
    """Links of a large group stay in one of the groups that it is divided into, however many parts hold its shingles."""
    rnd = np.random.default_rng(9)
    sets = []
    for g in range(25):
        base = np.concatenate([np.arange(40), rnd.choice(1 << 40, 60, replace=False)])[: int(rnd.integers(1, 100))]
        for _ in range(8):
            own = base.copy()
            k = int(rnd.integers(0, 1 + len(base) // 4))
            own[rnd.choice(len(base), k, replace=False)] = rnd.integers(1 << 41, 1 << 42, k)
            sets.append(np.unique(own.astype(np.uint64)))
    names = rnd.permutation(np.arange(-50, 150)).tolist()
    df = spark.createDataFrame([(d, bytearray(x.tobytes())) for d, x in zip(names, sets, strict=True)], "doc long, shingles binary")
    for parts, batch in ((1, 1 << 23), (16, 256)):
        monkeypatch.setattr(ngramjoin, "PARTS", parts)
        monkeypatch.setattr(ngramjoin, "BATCH", batch)
        got = {r["node"]: r["label"] for r in ngramjoin._divided(df, percent).collect()}
        assert 5 < len(set(got.values())) < len(got) < 200
        n_links = 0
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    n_links += 1
                    assert got[names[i]] == got[names[j]], (i, j)
        assert n_links > 50


def test_regions_of_a_large_group_are_joined_in_rounds(spark, monkeypatch):
    """What is replicated at once is no more than the group, and the links of all rounds are the group's."""
    rnd = np.random.default_rng(13)
    sets = []
    for _ in range(30):
        base = np.concatenate([np.arange(60), rnd.choice(1 << 40, 60, replace=False)])
        for _ in range(4):
            own = base.copy()
            k = int(rnd.integers(0, 20))
            own[rnd.choice(120, k, replace=False)] = rnd.integers(1 << 41, 1 << 42, k)
            sets.append(np.unique(own.astype(np.uint64)))
    tags = []
    monkeypatch.setattr(ngramjoin, "saved", lambda df, tag, *by, f=ngramjoin.saved: tags.append(tag) or f(df, tag, *by))
    for name, value in (("ROUND", 1), ("BLOCK", 8), ("SLICE", 32)):
        monkeypatch.setattr(ngramjoin, name, value)
    df = spark.createDataFrame([(1, d, bytearray(x.tobytes())) for d, x in enumerate(sets)], "cluster long, doc long, shingles binary")
    nodes = spark.createDataFrame([(1, d, 1, len(sets)) for d in range(len(sets))], "cluster long, doc long, weight long, size long")
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    found = components(ngramjoin._join_large(df, nodes, 80)).collect()
    assert tags.count("links") > 3 and {r["node"]: r["label"] for r in found} == {i: r for i, r in enumerate(root) if root.count(r) > 1}


def test_ngram_join_edge_cases(edge, empty):
    got = ngramjoin.ngram_join(edge).collect()
    assert len(got) == 10 and {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert {r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 7)} == {0} and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = ngramjoin.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id IS NULL").count() == 1
    assert ngramjoin.ngram_join(empty).count() == 0


# 10


def test_quality_edge_cases(spark, edge, empty):
    got = quality.quality_rules(edge).collect()
    assert len(got) == 10 and all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (2, 3, 7))
    assert quality.quality_rules(empty).count() == 0
    own = " ".join(f"word{k}" for k in range(12))
    texts = [(k, f"Shared   LINE of a site\nwith {own}{k}", "h") for k in range(20)] + [(99, "shared line of a site\nnow then", "h"), (100, "shared line of a site " + own, "g")]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    assert out[0]["n_removed_words"] == 5 and out[0]["kept"] and not out[99]["kept"] and out[100]["kept"] and out[100]["n_removed_words"] == 0


def test_quality_tells_lines_with_one_hash_apart(spark):
    a, b = xxhash64_twins()
    rest = " ".join(f"word{k}" for k in range(30))
    df = spark.createDataFrame([(k, f"{rest}\n{line}\nown line {k}", "h") for k, line in enumerate([a, a, b, b])], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_removed_words"] for r in quality.quality_rules(df, min_docs=1, max_docs=2, host_share=2.0, keep_share=0.0).collect()}
    assert got == {k: 30 for k in range(4)}


def test_quality_counts_documents(spark):
    """Copies under other ids count each, repeated rows once; the absolute limit holds in a host of any size."""
    lone = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, "one line that all copies have and nothing else but a few words more", "copies") for k in range(9)] + [(20, "an unlike text " + lone(20), "copies")]
    rows += [(100, "the same row again and again with a dozen words or so in it", "again")] * 12 + [(101, lone(101), "again")]
    rows += [(1000 + k, ("shared by some\n" if k < 7 else "") + lone(k), "large") for k in range(300)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=6, min_docs=5, host_share=0.5).collect()
    kept = {r["doc_id"]: (r["kept"], r["n_removed_words"]) for r in got}
    assert len(got) == len(rows)
    assert all(not kept[k][0] for k in range(9)) and kept[20] == (True, 0)
    assert kept[100] == (True, 0) and kept[101] == (True, 0)
    assert all(kept[1000 + k] == (True, 3 if k < 7 else 0) for k in range(300))


def test_vocabularies_are_files_outside():
    assert WORD_BPE == public_tokenizers.path("word_bpe_49k.json")
