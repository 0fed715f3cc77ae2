import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tokenizers
from helpers import DATA
from pyspark.sql import functions as F


def test_stages(spark, edge, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == edge.columns, name
        docs = spark.createDataFrame(out.collect(), edge.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "suffix_dedup", "packing"]
    out = corpus_pipeline.run(spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    kept = out.select("doc_id").distinct().count()
    assert 0.5 * n < kept < n
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_lines(docs, limit=8):
    """Texts without the lines of `limit` sites or more, but for the first occurrence of each."""
    norm = lambda line: " ".join(SPLIT.findall(line.lower()))
    sites = collections.defaultdict(set)
    for i, (text, site) in sorted(docs.items()):
        for line in (text or "").split("\n"):
            sites[norm(line)].add(site)
    seen, out = set(), {}
    for i, (text, site) in sorted(docs.items()):
        kept = []
        for line in (text or "").split("\n"):
            n = norm(line)
            if not n or len(sites[n]) < limit or n not in seen:
                kept.append(line)
            seen.add(n)
        out[i] = "\n".join(kept)
    return out


def brute_first_of_near_duplicates(docs, width=5, percent=80):
    sets = {}
    for i, text in docs.items():
        w = SPLIT.findall(text.translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def brute_without_repeats(docs, length=100):
    """Whole characters of what is left when bytes of strings that start earlier go."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        data = text.encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        at, kept = 0, []
        for c in text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_pipeline_is_the_loops_one_after_the_other(spark):
    """Rejections are those of the classifier, whose scores have tests of their own; all else is done again by loops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"]: (r["text"], r["source"]) for r in corpus_pipeline.toxicity(spark, docs, DATA).collect()}
    texts = brute_without_repeats(brute_first_of_near_duplicates(brute_lines(kept)))
    tokens = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {i: [*tokens.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    found = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        found[r["doc_id"]].append(r)
    assert set(found) == set(want) and 0 < len(want) < len(kept) < docs.count()
    for i, ids in want.items():
        at = 0
        for r in sorted(found[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
