"""Merkle manifest of a dataset by time-forward processing.

Rows are leaves, a column's values name trees, and the roots of all trees are the leaves of a top
tree. A node's label is (tree, level, index) and its parent's (tree, level + 1, index // 2), so labels
order children before parents. A digest is a message to the parent's label. Messages wait in a queue
ordered by label: beyond a task it is external, Spark's exchange, which deals them to the block that
holds the label and brings them in order; within a block of 2 ** BITS children it is a heap. A round
sweeps BITS levels, so rounds are the logarithm of the largest tree to the base 2 ** BITS.

The reversed sweep visits labels from the root down: a node that has the rest of its proof, from
itself to the root, delivers to each child that child's siblings and its own rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatframe.llm.common import store

#: Levels of a round: a block has 2 ** BITS children at most, whatever a tree holds.
BITS = 8
HEX = 64


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over the columns in order: `-` for null, else UTF-8 byte count, `:`, value."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256))


def joined(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def send_up(digests: list[bytes], levels: int) -> dict[tuple[int, int], bytes]:
    """Digest of each node (level, index) of a block, whose one node at ``levels`` is its root."""
    nodes = {(0, i): d for i, d in enumerate(digests)}
    queue = [(1, i // 2, i, d) for i, d in enumerate(digests)] if levels else []
    heapify(queue)
    while queue:
        label, got = queue[0][:2], []
        while queue and queue[0][:2] == label:
            got.append(heappop(queue)[3])
        nodes[label] = joined(*got)
        if label[0] < levels:
            heappush(queue, (label[0] + 1, label[1] // 2, label[1], nodes[label]))
    return nodes


def send_down(nodes: dict[tuple[int, int], bytes], levels: int, rest: str) -> list[str]:
    """The proof of each leaf of a block, whose root has the proof ``rest``."""
    queue, proofs = [(-levels, 0, rest)], {}
    while queue:
        level, node, rest = heappop(queue)
        if not level:
            proofs[node] = rest
            continue
        for child in (2 * node, 2 * node + 1):
            if (-level - 1, child) in nodes:
                sibling = nodes.get((-level - 1, child ^ 1))
                step = "-" if sibling is None else "RL"[child & 1] + sibling.hex()
                heappush(queue, (level + 1, child, step + rest))
    return [proofs[i] for i in range(len(proofs))]


def fold(leaf: bytes, proof: str) -> bytes:
    """The root that a leaf and a proof give."""
    at = 0
    while at < len(proof):
        side, sibling = proof[at], bytes.fromhex(proof[at + 1 : at + 1 + HEX]) if proof[at] != "-" else b""
        at += 1 + 2 * len(sibling)
        leaf = joined(leaf) if side == "-" else joined(sibling, leaf) if side == "L" else joined(leaf, sibling)
    return leaf


def _appended(df: DataFrame, name: str, kind: str, values) -> DataFrame:
    """``df`` with one more column, made batch by batch by ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, values(batch)], [*batch.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(kind)).schema)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of (tree, ...) with ``pos``, their place in the tree by ``order``, and ``n``, its leaves.

    A range partitioning sorts; no tree has to fit a task, and ties are dealt by row number. Places
    are the row's in its partition behind the tree's rows in earlier partitions.
    """
    rows = store(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    spread = rows.repartitionByRange("tree", *order, "uid").sortWithinPartitions("tree", *order, "uid").drop("uid")
    spread = store(spread.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
    runs = spread.groupBy(F.col("tree").alias("t"), F.col("part").alias("p")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("t")
    runs = runs.select("t", "p", (F.sum("here").over(tree.orderBy("p")) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    return spread.join(runs, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t"))).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "t", "p", "shift")


def sweep_up(leaves: DataFrame) -> list[DataFrame]:
    """Rounds of blocks (tree, node, n, kids, levels, digest) over (tree, pos, n, digest, ...); what
    else the leaves have stays with them. The last round has one block a tree, whose digest is its root."""

    def root(batch: pa.RecordBatch) -> pa.Array:
        kids, levels = batch.column("kids").to_pylist(), batch.column("levels").to_pylist()
        return pa.array([send_up([k["digest"] for k in ks], n)[n, 0] for ks, n in zip(kids, levels, strict=True)], pa.binary())

    most = leaves.agg(F.max(height(F.col("n")))).head()[0] or 0
    rounds, nodes = [], leaves
    for done in range(0, max(most, 1), BITS):
        kid = F.struct("pos", *(c for c in nodes.columns if c not in ("tree", "pos", "n")))
        blocks = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("node")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        blocks = blocks.withColumn("levels", F.greatest(F.lit(0), F.least(F.lit(BITS), height(F.col("n")) - done)))
        rounds.append(store(_appended(blocks, "digest", "binary", root), "blocks"))
        nodes = rounds[-1].select("tree", F.col("node").alias("pos"), "n", "digest")
    return rounds


def sweep_down(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(tree, kid, proof, ...): the leaves with their proofs; ``roots`` has (tree, rest, ...) for each tree."""

    def proofs(batch: pa.RecordBatch) -> pa.Array:
        found = []
        for kids, levels, rest in zip(*(batch.column(c).to_pylist() for c in ("kids", "levels", "rest")), strict=True):
            found.append(send_down(send_up([k["digest"] for k in kids], levels), levels, rest))
        return pa.array(found, pa.list_(pa.string()))

    more = [c for c in roots.columns if c not in ("tree", "rest")]
    rests = roots.select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("b"), "rest", *more)
    for r, blocks in reversed(list(enumerate(rounds))):
        met = blocks.join(rests, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("b"))).select("tree", "kids", "levels", "rest", *more)
        met = _appended(met, "proofs", "array<string>", proofs).select("tree", *more, F.explode(F.arrays_zip("kids", "proofs")).alias("x"))
        found = met.select("tree", F.col("x.kids").alias("kid"), F.col("x.proofs").alias("proof"), *more)
        rests = store(found.select(F.col("tree").alias("t"), F.col("kid.pos").alias("b"), F.col("proof").alias("rest"), *more), "proofs") if r else None
    return found


def manifest(docs: DataFrame, columns: tuple[str, ...], tree_col: str, id_col: str, **carried: Column) -> DataFrame:
    """One row for each row: (doc_id, leaf, subroot, root, proof, and what ``carried`` names).

    ``leaf`` is the digest of ``columns``; leaves of a tree go by id, nulls first, equal ids by digest
    and repeated rows side by side. A null in ``tree_col`` is a tree of its own, the first. ``proof``
    has a step for each level up to the root: `L` or `R`, where the sibling stands, and its digest in
    hex, or `-` where a node is alone. Digests are binary. Other columns are not carried, so their
    names don't matter; empty texts and nulls differ in their leaf; an empty table gives no rows.
    """
    named = {k: c.alias(f"with_{k}") for k, c in carried.items()}
    leaves = numbered(docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*(F.col(c) for c in columns)).alias("digest"), *named.values()), "doc_id", "digest")
    rounds = sweep_up(leaves)
    subroots = rounds[-1].select(F.col("tree").alias("name"), "digest")
    top = sweep_up(numbered(subroots.select(F.lit(0).alias("tree"), "name", "digest"), "name"))
    below = sweep_down(top, top[-1].select("tree", F.lit("").alias("rest"), F.col("digest").alias("root")))
    roots = store(below.select(F.col("kid.name").alias("tree"), F.col("proof").alias("rest"), F.col("kid.digest").alias("subroot"), "root"), "roots")
    found = sweep_down(rounds, roots)
    return found.select("kid.doc_id", F.col("kid.digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"kid.with_{k}").alias(k) for k in carried))


def folded(proved: DataFrame, leaf_col: str) -> DataFrame:
    """``proved`` with ``folded``: the root that the digest in ``leaf_col`` gives with the row's proof."""

    def roots(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([fold(*x) for x in zip(batch.column(leaf_col).to_pylist(), batch.column("proof").to_pylist(), strict=True)], pa.binary())

    return _appended(proved, "folded", "binary", roots)


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings in hex, from the leaf to the root, without their sides."""
    return F.translate(proof, "LR-", "")
