import hashlib
import zlib

import numpy as np
import pytest
from helpers import DATA, same
from pyspark.sql import functions as F
from wavespan.llm import merkle
from wavespan.llm.queries import QUERIES, SQL

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def sides(tree, i):
    """(left, right) of each level of the path from leaf i."""
    out = []
    for level in tree[:-1]:
        a = i - i % 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, brute_leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top, out = levels([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (r, leaf) in enumerate(by[s]):
            path = sides(trees[s], i) + sides(top, k)
            own = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                own = brute_leaf((*r[:4], r[4].replace("\n", "")))
            for a, b in path:
                own = sha(a + own + b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), own, own == top[-1][0]))
    return sorted(out, key=str)


def got(df, height=merkle.HEIGHT):
    return sorted((tuple(r) for r in merkle.report(df, height).collect()), key=str)


def test_same_rows_as_sql_and_brute_force(spark, duck):
    out = QUERIES["op13_merkle_manifest"](spark, DATA)
    same(out.toPandas(), duck.execute(SQL["op13_merkle_manifest"]).df())
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_blocks_in_several_rounds(spark, height):
    """Sources of all sizes round powers of three, one with most rows, many small ones: several rounds in both trees."""
    rows, i = [], 0
    for s, n in enumerate([1, 2, 3, 4, 8, 9, 10, 27, 28, 82, 1, 1, 1, 300]):
        for _ in range(n):
            rows.append((i * 7 % 1009, f"s{s}" if s else None, "en", i, f"text\n{i}"))
            i += 1
    assert got(spark.createDataFrame(rows, KIND).repartition(5), height) == brute(rows)


@pytest.mark.parametrize("levels_", range(1, 9))
def test_layout(levels_):
    """Every node has a place of its own; an upper tree comes before its lower trees, which follow each other."""
    at = [merkle.address(levels_, d, np.arange(3**d)) for d in range(levels_)]
    assert sorted(np.concatenate(at).tolist()) == list(range(merkle.tree_size(levels_)))
    upper = levels_ // 2
    if upper:
        assert max(x.max() for x in at[:upper]) == merkle.tree_size(upper) - 1
        lower = merkle.tree_size(levels_ - upper)
        for k in range(3**upper):
            own = np.concatenate([at[d][k * 3 ** (d - upper) : (k + 1) * 3 ** (d - upper)] for d in range(upper, levels_)])
            assert (np.sort(own) == merkle.tree_size(upper) + k * lower + np.arange(lower)).all()


def test_tampering_is_found(spark):
    rows = [(k, f"s{k % 4}", "en", 3, f"line {k}\nmore" if k % 3 else f"one line {k}") for k in range(200)]
    out = {r["doc_id"]: r for r in merkle.report(spark.createDataFrame(rows, KIND)).collect()}
    for k in range(200):
        assert out[k]["verified"] == (zlib.crc32(str(k).encode()) % 2 == 1 or k % 3 == 0)
    clean = merkle.manifest(spark.createDataFrame(rows, KIND))
    assert clean.where("NOT verified").count() == 0 and clean.count() == 200


def test_edge_cases(spark, edge, empty):
    long = "word\n" * 50000
    rows = [(1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (None, "a", None, None, None), (None, None, None, None, ""), (2, None, "é", 5, "\n"), (3, "é", "", 0, long), (4, "z\U0001f600", "en", -1, "3:abc"), (1, "a", "en", 1, "y"), (5, "", "en", 1, "-")]
    df = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], f"{KIND}, tree int, pos string, node binary")
    assert got(df) == brute(rows)
    assert got(edge) == brute([tuple(r) for r in edge.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert merkle.report(empty).count() == 0
    assert got(spark.createDataFrame([rows[0]], KIND)) == brute(rows[:1])
    many = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    assert got(many, 3) == brute([(7, "s", "l", 1, "same")] * 3000)
