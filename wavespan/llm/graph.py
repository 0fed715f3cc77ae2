"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of every node in links (a, b: long, not null).

    A round sends each node to the first among its neighbours and itself, and carries the links over to where their ends
    went; links within one node go, and equal ones fall together, so the table shrinks with each round. First is the
    smallest id in even rounds, which ends stars, and the least hash in odd ones, which shortens chains however their ids
    run. In the end the steps are followed from the last back to the first. Every table is written to the shared folder.
    """
    edges = saved(_ordered(links, "a", "b"), "edges")
    steps = []
    while not steps or edges.limit(1).count():
        key = lambda x: F.xxhash64(x, F.lit(len(steps))) if len(steps) % 2 else F.lit(0).cast("long")
        first = F.least(*[F.struct(key(x).alias("key"), F.col(x).alias("id")) for x in ("a", "b")])
        both = F.array(*[F.struct(F.col(x).alias("node"), first.alias("first")) for x in ("a", "b")])
        step = saved(edges.select(F.inline(both)).groupBy("node").agg(F.min("first")["id"].alias("to")), "step")
        ways = [step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in ("a", "b")]
        left = saved(_ordered(edges.where("a <> b").join(ways[0], "a").join(ways[1], "b").where("to_a <> to_b"), "to_a", "to_b"), "edges")
        drop_saved(edges)
        edges = left
        steps.append(step)
    ends = steps[-1]
    for step in steps[-2::-1]:
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("further"))
        ends = step.join(later, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    ends = saved(ends, "ends")
    # A table of its own, so that Spark can split a component that very many nodes have.
    names = saved(ends.groupBy("to").agg(F.min("node").alias("label")), "names")
    out = saved(ends.join(names, "to").select("node", "label"), "labels")
    for done in (edges, *steps, ends, names):
        drop_saved(done)
    return out


def _ordered(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct links, the smaller end as a."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
