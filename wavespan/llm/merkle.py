"""Merkle manifest of a dataset: a tree of hashes for each source and one over the sources, in van Emde Boas layout.

Nodes of a tree have three children (the last of a level fewer). A tree is stored as aligned blocks of 3**HEIGHT leaves,
each block in van Emde Boas order: a tree of so many levels is cut at half its height, the upper tree is laid out first, then the
lower trees from left to right, each of them cut in the same way. Addresses are arithmetic on (level, number), so a block
of any size needs few memory blocks on a path, whatever their size. The roots of the blocks are the leaves of the next
round of blocks, until each source has one root; then the roots of the sources are the leaves of one more tree.

Everything is rows of (tree, block): a source with a third of all rows is many blocks. Leaves get their places from
ranges of the sort order. Proofs come from the top: each block root gets the path above it, and the leaves of a block
look their siblings up by address.

Defined cases
* leaves of a source ascend by doc_id, null first, then by hash; rows without source are a source, the first one.
* repeated rows are leaves of their own with the same hash. null in any hashed column is `-`, an empty text `0:`.
* no rows: no leaves, no root, empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import in_order, with_positions
from .common import drop_saved, saved

ARITY = 3
#: Levels of a block above its leaves: 6,561 leaves.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


# Addresses


def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of nodes (depth from the top, number from the left) of a full tree of so many levels in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number)
    lower, below = levels - upper, ARITY ** (depth - upper)
    return tree_size(upper) + number // below * tree_size(lower) + address(lower, depth - upper, number % below)


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[list[int], ...]:
    """Places of all nodes, by height over the leaves."""
    return tuple(address(levels, levels - 1 - h, np.arange(ARITY ** (levels - 1 - h))).tolist() for h in range(levels))


# Hashes


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The nodes of a block of height + 1 levels, in layout; places of nodes that aren't there are zero."""
    at = addresses(height + 1)
    out = bytearray(DIGEST * tree_size(height + 1))
    now = leaves
    for h in range(height + 1):
        for k, node in enumerate(now):
            a = DIGEST * at[h][k]
            out[a : a + DIGEST] = node
        if h < height:
            now = [_sha(b"".join(now[k : k + ARITY]).hex().encode()) for k in range(0, len(now), ARITY)]
    return bytes(out)


def path_in_block(nodes: bytes, height: int, leaves: int, number: int) -> bytes:
    """For each level from leaf number up: how many siblings are on the left, how many in all, and their hashes."""
    at, out, count = addresses(height + 1), [], leaves
    for h in range(height):
        first = number - number % ARITY
        run = range(first, min(first + ARITY, count))
        out.append(bytes((number - first, len(run) - 1)))
        out += [nodes[DIGEST * at[h][k] : DIGEST * at[h][k] + DIGEST] for k in run if k != number]
        number, count = number // ARITY, -(-count // ARITY)
    return b"".join(out)


def steps_of(path: bytes):
    """(hex of the siblings on the left, hex of those on the right) of each level of a path."""
    k = 0
    while k < len(path):
        left, total = path[k], path[k + 1]
        k += 2
        mid, end = k + DIGEST * left, k + DIGEST * total
        yield path[k:mid].hex(), path[mid:end].hex()
        k = end


def fold(leaf: bytes, steps: list[tuple[str, str]]) -> str:
    """Hex of the root that a leaf and its siblings give."""
    own = leaf.hex()
    for left, right in steps:
        own = hashlib.sha256((left + own + right).encode()).hexdigest()
    return own


def block_height(total: int, block: int, height: int) -> int:
    """Levels over the leaves of a block: a tree of one block is only as high as it needs to be."""
    if total > ARITY**height:
        return height
    h, n = 0, total
    while n > 1:
        h, n = h + 1, -(-n // ARITY)
    return h


# Tables


def leaf_hash(docs_column: dict[str, Column]) -> Column:
    """SHA-256 of the fields: `-` for null, else bytes, colon and value."""
    parts = []
    for name in FIELDS:
        v = docs_column[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _groups(batches, columns: list[str]):
    """Rows as tuples by (tree, block), for input sorted by both; a group may go over several batches."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if held and row[:2] != now:
                yield held
                held = []
            now = row[:2]
            held.append(row)
    if held:
        yield held


def _out(rows: list[tuple], kinds: dict[str, pa.DataType]):
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


BLOCKS = "tree string, block long, total long, leaves int, nodes binary"
_BLOCKS = {"tree": pa.string(), "block": pa.int64(), "total": pa.int64(), "leaves": pa.int32(), "nodes": pa.binary()}


def blocks_of(leaves: DataFrame, height: int) -> DataFrame:
    """Blocks of trees in layout. leaves: tree, pos, total (leaves of the tree), node."""

    def build(batches):
        out, held = [], 0
        for rows in _groups(batches, ["tree", "block", "pos", "total", "node"]):
            tree, block, _, total, _ = rows[0]
            nodes = build_block([r[4] for r in rows], block_height(total, block, height))
            out.append((tree, block, total, len(rows), nodes))
            held += len(nodes)
            if held > 1 << 22:
                yield _out(out, _BLOCKS)
                out, held = [], 0
        yield _out(out, _BLOCKS)

    rows = leaves.select("tree", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "total", "node")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(build, BLOCKS)


def _root_of(blocks: DataFrame) -> DataFrame:
    """The first node of each block is its root, as leaf of the next round: tree, pos, total, node."""
    return blocks.select("tree", F.col("block").alias("pos"), "total", F.substring("nodes", 1, DIGEST).alias("node"))


def build_trees(leaves: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks (saved tables), and tree, node of the root of each tree (saved)."""
    rounds, roots, size = [], None, ARITY**height
    while True:
        made = saved(blocks_of(leaves, height), "merkle-blocks")
        rounds.append(made)
        done = _root_of(made.where(F.col("total") <= size)).select("tree", "node")
        roots = done if roots is None else roots.unionAll(done)
        more = made.where(F.col("total") > size)
        if not more.limit(1).count():
            return rounds, saved(roots, "merkle-roots")
        leaves = _root_of(more).withColumn("total", F.ceil(F.col("total") / size))


def paths_below(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """tree, pos, path, subroot of each leaf of the blocks. above: tree, block, path, subroot of the blocks' roots."""
    kinds = {"tree": pa.string(), "pos": pa.int64(), "path": pa.binary(), "subroot": pa.binary()}

    def look_up(batches):
        for b in batches:
            for tree, block, total, n, nodes, path, subroot in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "total", "leaves", "nodes", "path", "subroot")), strict=True):
                h = block_height(total, block, height)
                yield _out([(tree, block * ARITY**height + k, path_in_block(nodes, h, n, k) + path, subroot) for k in range(n)], kinds)

    return _with_above(blocks, above).mapInArrow(look_up, "tree string, pos long, path binary, subroot binary")


def _with_above(blocks: DataFrame, above: DataFrame) -> DataFrame:
    up = above.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "path", "subroot")
    return blocks.join(up, blocks["tree"].eqNullSafe(up["_tree"]) & (blocks["block"] == up["_block"])).drop("_tree", "_block")


def _tops(rounds: list[DataFrame], roots: DataFrame, height: int) -> list[DataFrame]:
    """For each round, the paths above its block roots (tree, block, path, subroot); roots: tree, path, subroot of whole trees."""
    size = ARITY**height
    above: list[DataFrame] = [None] * len(rounds)
    up = roots.select(F.col("tree").alias("_tree"), "path", "subroot")
    for r in range(len(rounds) - 1, -1, -1):
        tops = rounds[r].where(F.col("total") <= size).select("tree", "block")
        own = tops.join(up, tops["tree"].eqNullSafe(up["_tree"])).drop("_tree")
        if r + 1 < len(rounds):
            own = own.unionByName(paths_below(rounds[r + 1], above[r + 1], height).withColumnRenamed("pos", "block"))
        above[r] = saved(own.select("tree", "block", "path", "subroot"), "merkle-paths")
    return above


def manifest(docs: DataFrame, tampered_text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    tampered_text: what a row's text is when its proof is checked; by default, what it was when the manifest was made.
    """
    own = {c: F.col(c) for c in FIELDS}
    leaf = leaf_hash(own)
    seen = leaf if tampered_text is None else leaf_hash(own | {"text": tampered_text})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("tree"), leaf.alias("node"), F.when(seen != leaf, seen).alias("seen"))
    # The place in the input tells repeated rows apart, so that ranges can part them.
    placed = saved(in_order(rows.withColumn("_row", F.monotonically_increasing_id()), "tree", "doc_id", "node", "_row").drop("_row"), "merkle-order")
    ranked = with_positions(placed, "rank")
    trees = saved(ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("total")), "merkle-trees")
    about = trees.select(F.col("tree").alias("_tree"), "first", "total")
    leaves = saved(ranked.join(about, ranked["tree"].eqNullSafe(about["_tree"])).select("tree", (F.col("rank") - F.col("first")).alias("pos"), "total", "doc_id", "node", "seen"), "merkle-leaves")
    for done in (placed, trees):
        drop_saved(done)
    rounds, subroots = build_trees(leaves, height)
    # One more tree over the sources.
    order = saved(in_order(subroots, "tree"), "merkle-sources")
    n = order.count()
    tops = saved(with_positions(order, "pos").select(F.col("tree").alias("own"), F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("total"), "node"), "merkle-tops")
    over, root = build_trees(tops, height)
    whole = root.select("tree", F.lit(b"").alias("path"), F.col("node").alias("subroot"))
    top_paths = _tops(over, whole, height)
    source_paths = paths_below(over[0], top_paths[0], height).select(F.col("pos").alias("_pos"), "path", F.col("subroot").alias("root"))
    of_source = saved(tops.join(source_paths, tops["pos"] == source_paths["_pos"]).select(F.col("own").alias("tree"), "path", F.concat("node", "root").alias("subroot")), "merkle-source-paths")
    above = _tops(rounds, of_source, height)
    for done in (subroots, order, tops, root, *over, *top_paths, of_source, *rounds[1:], *above[1:]):
        drop_saved(done)
    return _proofs(leaves, _with_above(rounds[0], above[0]), height)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_RESULT = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}


def _proofs(leaves: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """Each block's row meets its leaves: siblings by address, then the path above the block; subroot holds subroot and root."""
    size = ARITY**height

    def prove(batches):
        now, out = None, []
        columns = ["tree", "block", "kind", "pos", "doc_id", "node", "seen", "total", "leaves", "path", "subroot"]
        for b in batches:
            for tree, block, kind, pos, doc, node, seen, total, n, path, both in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if kind == 0:
                    above = list(steps_of(path))
                    now = (tree, block, node, block_height(total, block, height), n, above, "".join(x + y for x, y in above), both[:DIGEST].hex(), both[DIGEST:].hex())
                    continue
                if now is None or now[:2] != (tree, block):
                    raise ValueError("a leaf without its block")
                _, _, nodes, h, n, above, more, subroot, root = now
                steps = list(steps_of(path_in_block(nodes, h, n, pos - block * size)))
                proof = "".join(x + y for x, y in steps) + more
                found = fold(node if seen is None else seen, steps + above)
                out.append((doc, node.hex(), subroot, root, hashlib.sha256(proof.encode()).hexdigest(), found, found == root))
            if len(out) >= 10_000:
                yield _out(out, _RESULT)
                out = []
        yield _out(out, _RESULT)

    none = lambda kind: F.lit(None).cast(kind)
    first = blocks.select("tree", "block", F.lit(0).alias("kind"), none("long").alias("pos"), none("long").alias("doc_id"), F.col("nodes").alias("node"), none("binary").alias("seen"), "total", "leaves", "path", "subroot")
    rest = leaves.select(
        "tree", F.floor(F.col("pos") / size).alias("block"), F.lit(1).alias("kind"), "pos", "doc_id", "node", "seen",
        none("long").alias("total"), none("int").alias("leaves"), none("binary").alias("path"), none("binary").alias("subroot"),
    )
    return first.unionAll(rest).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "pos").mapInArrow(prove, RESULT)


def without_line_ends() -> Column:
    """The contract's tampering: texts of half of the ids lose their line ends."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of the documents, checked against tampered texts."""
    return manifest(docs, without_line_ends(), height)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_STEPS = "list_transform(range(strlen(doc_id::VARCHAR)), lambda i: [ord(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])"
#: Parity of the CRC-32 of the decimal id, bit by bit.
_ODD = f"(list_reduce(list_concat([4294967295::BIGINT], flatten({_STEPS})), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END) + 1) % 2"


def _tree_sql(name: str, source: str, leaves: str) -> str:
    """Levels of trees, and the hashes beside each node of them."""
    side = "coalesce(string_agg(h, '') OVER (PARTITION BY {0} lev, i // 3 ORDER BY i ROWS BETWEEN {1}), '')"
    key, part = (f"{source}, ", f"{source},") if source else ("", "")
    return (
        f"{name} AS (SELECT {key}0 AS lev, i, n, h FROM {leaves} UNION ALL SELECT {key}lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {key}lev, i // 3, n), "
        f"{name}_sides AS (SELECT {key}lev, i, {side.format(part, 'UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side.format(part, '1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name} WHERE n > 1)"
    )


#: The same rows by DuckDB, level by level.
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF} AS h, {_LEAF.replace("text", "t")} AS seen FROM
  (SELECT *, CASE WHEN {_ODD} = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents)),
leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS rid FROM d),
{_tree_sql("low", "source", "leaf")},
top AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree_sql("high", "", "top")},
step AS (SELECT rid, s.lev AS k, l, r FROM leaf JOIN low_sides s ON s.source IS NOT DISTINCT FROM leaf.source AND s.i = leaf.i // pow(3, s.lev)::BIGINT
  UNION ALL SELECT rid, 1000 + s.lev, l, r FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source JOIN high_sides s ON s.i = top.i // pow(3, s.lev)::BIGINT),
e AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) AS k, l, r FROM step),
f(rid, k, acc) AS (SELECT rid, 0::BIGINT, seen FROM leaf UNION ALL SELECT f.rid, f.k + 1, sha256(l || acc || r) FROM f JOIN e ON e.rid = f.rid AND e.k = f.k + 1),
o AS (SELECT rid, arg_max(acc, k) AS folded_root FROM f GROUP BY rid),
q AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM e GROUP BY rid)
SELECT doc_id, leaf.h AS leaf, top.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source JOIN o USING (rid) LEFT JOIN q USING (rid)
"""
