import random

import pytest
from wavespan.operators import split, windows


def greedy(rows, radius, target):
    """rows: (group, source, local, h). Promote in the order of h, guard, stop at the first share that is enough."""
    val, left = set(), set()
    for g, _, i, _ in sorted(rows, key=lambda r: r[3]):
        val |= {r for r in rows if r[0] == g and r[2] == i}
        left = {r for r in rows if r not in val and any(v[0] == r[0] and abs(v[2] - r[2]) <= radius for v in val)}
        if len(val) / (len(rows) - len(left)) >= target:
            break
    return {r: "validate" if r in val else "discard" if r in left else "train" for r in rows}


@pytest.mark.parametrize("seed", range(8))
def test_closed_form_is_the_greedy_rule(spark, seed):
    rnd = random.Random(seed)
    rows, radius, target = [], rnd.choice([0, 1, 3, 9]), rnd.choice([0.05, 0.2, 0.5])
    for g in range(3):
        for s in range(rnd.randint(1, 3)):
            rows += [(g, 10 * g + s, i) for i in range(rnd.randint(1, 12))]
    ranks = list(range(len(rows)))
    rnd.shuffle(ranks)
    scale = 1 << rnd.choice([0, 30, 45])
    rows = [(*r, h * scale) for r, h in zip(rows, ranks, strict=True)]
    df = spark.createDataFrame(rows, "group_idx long, source_idx long, local_idx long, h long")
    got = {(r["group_idx"], r["source_idx"], r["local_idx"], r["h"]): r["split"] for r in split.split_windows(df, "group_idx", radius, target).collect()}
    assert got == greedy(rows, radius, target)


def test_long_group_crosses_spans(spark):
    n = 2 * split.SPAN + 50
    df = split.ranked(spark.range(n).selectExpr("0L AS group_idx", "0L AS source_idx", "id AS local_idx"), 3, "local_idx")
    rows = split.promotion(df, "group_idx", 9).toPandas().sort_values("local_idx")
    p = rows["p"].tolist()
    assert rows["b"].tolist() == [min(p[max(0, i - 9) : i + 10]) for i in range(n)]
    assert len(rows) == n


def test_bad_input(spark):
    df = spark.createDataFrame([], "group_idx long, local_idx long, h long")
    with pytest.raises(ValueError):
        split.split_windows(df, "group_idx", 1, 0.1)
    with pytest.raises(ValueError):
        windows.resolve_hop(10, hop_samples=11)
    assert [windows.resolve_hop(15, hop_fraction=0.1), windows.resolve_hop(25, hop_fraction=0.1), windows.overlap_radius(10, 1)] == [2, 2, 9]


def test_same_on_any_partitioning(spark):
    df = split.ranked(spark.range(500).selectExpr("id % 7 AS group_idx", "id % 7 AS source_idx", "id div 7 AS local_idx"), 1, "source_idx", "local_idx")
    one, many = (sorted(map(tuple, split.split_windows(df.repartition(k), "group_idx", 3, 0.2).collect())) for k in (1, 8))
    assert one == many


def test_shards():
    for n in range(1, 40):
        for w in range(1, 8):
            for k in range(w):
                assert [i for i in range(n) if ((i + 1) * w - 1) // n == k] == list(range(n * k // w, n * (k + 1) // w))
