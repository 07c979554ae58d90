"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors with cosine >= t lie within d = sqrt(2 - 2t). Vectors are dealt to cells around
pivots (a farthest-first net, whose prefixes are the upper cover-tree levels); neighbouring cells
make blocks, and a cell over the block size is split. Each block gets a cover tree: nested nets
whose radii halve from the root, which covers the sphere, down.

Pruning comes before copying: cells' centres and covering radii go to all tasks, and a vector
travels to another block only if it is within d and the covering radius of one of its cells. Of two
blocks that still meet, the trees are traversed together from the root. A pair of nodes whose
centres are further apart than d plus both covering radii is dropped; of one whose centres are closer
than d less both, all vectors link, and are counted as a whole. Pairs of vectors that are left are
decided in double precision, so the pairs are exact.

Where nothing can be pruned (vectors that are all about equally far apart), levels that would not pay
are left out and vectors meet in products, tile by tile. Blocks are as few as keep all cores busy, and
as large as memory allows: a vector travels to that many places.

Vectors that are equal number for number are one class. A task keeps a count of links for each class
and a spanning forest while pairs come, so a group of n copies never becomes n^2 pairs or rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import store
from chatframe.llm.components import components

#: Bytes of a block's vectors in double precision: bounds a task's memory (two blocks, slices of
#: their products), whatever their length.
BLOCK_BYTES = 16 << 20
#: Vectors for each cell on average, vectors from which pivots are chosen, and pivots at most; every
#: vector is dealt all the same.
CELL, PIVOT_SAMPLE, MAX_PIVOTS = 256, 4096, 1024
#: Radii of the nested levels, finest first; the last one covers the sphere.
RADII = (0.125, 0.25, 0.5, 1.0, 2.0)
#: Centres of which one in PROBE_SHARE must have a neighbour for a net to be built over them.
PROBE, PROBE_SHARE = 256, 16
#: Slack of single-precision products; what it lets through is decided in double precision.
SLACK = 1e-3
#: Pairs decided together, and pairs of children from which products decide for two nodes.
SLICE, PRODUCT = 16_384, 512
#: Rows and columns of a product, and what a pair decided alone and a link of its own cost in pairs of one.
TILE, ALONE, LINK = (256, 2048), 128, 16


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, dim); digest is null where the vector can't link."""
    for batch in batches:
        digests, dims = _digest(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), digests, dims], ["vec_id", "digest", "dim"])


def _digest(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int32)
    out = []
    for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        x = flat[end - n : end]
        out.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if n and np.isfinite(x).all() and x.any() else None)
    return pa.array(out, pa.binary()), pa.array(sizes)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(np.asarray(column.flatten()), len(column))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of k points of x, each the one furthest from those before it: nested nets."""
    chosen, gap = [0], np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        gap = np.minimum(gap, 2 - 2 * (x @ x[chosen[-1]]))
        far = int(gap.argmax())
        if gap[far] <= 1e-12:
            break
        chosen.append(far)
    return np.array(chosen)


def _net(c: np.ndarray, cos: float) -> np.ndarray:
    """For each row the first row of a greedy net that is near it: a row near none joins the net."""
    parent, net, held, m = np.empty(len(c), np.int64), np.empty(len(c), np.int64), np.empty_like(c), 0
    for low in range(0, len(c), TILE[0]):
        part = c[low : low + TILE[0]]
        got = np.full(len(part), -1)
        if m:
            near = part @ held[:m].T >= cos
            got = np.where(near.any(1), net[near.argmax(1)], -1)
        left = np.flatnonzero(got < 0)
        near, free = part[left] @ part[left].T >= cos, np.ones(len(left), bool)
        for k, row in enumerate(left.tolist()):
            if free[k]:
                mine = near[k] & free
                got[left[mine]], got[row] = low + row, low + row
                free &= ~mine
                free[k] = False
                net[m], held[m] = low + row, c[low + row]
                m += 1
        parent[low : low + TILE[0]] = got
    return parent


def _pays(c: np.ndarray, parent: np.ndarray, radius: np.ndarray, reach: float) -> bool:
    """Whether products of the net's centres, and what their covering radii leave of their children,
    cost less than products of all rows of c and the links that would be counted one by one. Some
    centres stand for all."""
    nodes, children = np.unique(parent, return_counts=True)
    some, left = np.arange(0, len(nodes), max(1, len(nodes) // PROBE)), 0
    for low in range(0, len(some), 32):
        part = some[low : low + 32]
        gap = np.sqrt(np.maximum(0, 2 - 2 * (c[nodes[part]] @ c[nodes].T)))
        spread = radius[nodes[part]][:, None] + radius[nodes]
        pairs, inside = children[part][:, None] * children, gap + spread <= reach - SLACK
        cost = np.where(inside, -LINK * pairs, np.minimum(ALONE * pairs, pairs + ALONE * PRODUCT))
        left += int(cost[gap <= reach + spread + SLACK].sum())
    return len(nodes) ** 2 + left * len(nodes) / len(some) < len(c) ** 2


def nested_nets(x: np.ndarray, reach: float, radii: tuple[float, ...] = RADII) -> np.ndarray:
    """(levels, n): for each point the index of its node's centre, finest level first. A level's
    centres are a net of the level below, so levels nest. Where a probe finds hardly any neighbours,
    where all nodes would be in reach of each other, or where a level doesn't pay, it is the one below:
    radii are measured, so this costs pruning only."""
    small = x.astype(np.float32)
    levels, centres, of = [], np.arange(len(x)), np.arange(len(x))
    for r in radii:
        c = small[centres]
        cos = 1 - r * r / 2 - 1e-6
        some = r < radii[-1] and len(c) > PROBE
        if some:
            probe = np.arange(0, len(c), max(1, len(c) // PROBE))
            if reach + 2 * r >= 2 or ((c[probe] @ c.T >= cos).sum(1) > 1).sum() * PROBE_SHARE < len(probe):
                levels.append(of)
                continue
        parent = _net(c, cos)
        lookup = np.full(len(x), -1)
        lookup[centres] = centres[parent]
        above = lookup[of]
        if some:
            radius = np.zeros(len(x))
            np.maximum.at(radius, above, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[above]))))
            if not _pays(c, parent, radius[centres], reach):
                levels.append(of)
                continue
        of = above
        levels.append(of)
        centres = centres[np.unique(parent)]
    return np.array(levels)


class Tree:
    """Nodes of each level, coarsest first, then the points; covering radii are measured."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        """``levels`` names the nodes of each point; a node's first point here stands at its centre,
        since the vectors that met may be some of the block's only."""
        levels = [at[index] for _, at, index in (np.unique(of, return_index=True, return_inverse=True) for of in levels)]
        self.x, self.centres, self.radius, self.children, self.of, self.sides = x, [], [], [], [], {}
        chain = [*levels[::-1], np.arange(len(x))]
        for i, of in enumerate(chain):
            centres, index = np.unique(of, return_inverse=True)
            radius = np.zeros(len(centres))
            np.maximum.at(radius, index, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[of]))) if i < len(levels) else 0)
            self.centres.append(centres)
            self.radius.append(radius)
            self.of.append(index)
            if i:  # children of the level above
                up = np.searchsorted(self.centres[i - 1], chain[i - 1][centres])
                order = np.argsort(up, kind="stable")
                self.children.append((order, np.searchsorted(up[order], np.arange(len(self.centres[i - 1]) + 1))))

    def side(self, level: int, reach: float | None) -> np.ndarray:
        """Rows whose product with the rows of another tree's side is 1 or more where two nodes' centres
        are no further apart than both radii and the reach, which one of the sides adds: (p + q)^2 / 2
        and the cosine are 1 together at that distance."""
        key = level, reach is None
        if key not in self.sides:
            p = self.radius[level] + (0 if reach is None else reach + SLACK)
            one, half = np.ones(len(p)), p * p / 2
            self.sides[key] = np.column_stack([self.x[self.centres[level]], p, *((one, half) if reach is None else (half, one))]).astype(np.float32)
        return self.sides[key]


def _children(a: np.ndarray, b: np.ndarray, ta: Tree, tb: Tree, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of children of the node pairs (a, b), at most SLICE at a time, and the node pair of each."""
    (oa, sa), (ob, sb) = ta.children[level], tb.children[level]
    nb = sb[b + 1] - sb[b]
    ends = np.cumsum((sa[a + 1] - sa[a]) * nb)
    for low in range(0, int(ends[-1]), SLICE):
        k = np.arange(low, min(low + SLICE, int(ends[-1])))
        pair = np.searchsorted(ends, k, side="right")
        k -= np.where(pair > 0, ends[pair - 1], 0)
        yield oa[sa[a][pair] + k // nb[pair]], ob[sb[b][pair] + k % nb[pair]], pair


def _rounding(side: np.ndarray) -> float:
    """What a product of sides may be off by in single precision."""
    return 1e-5 + 1.2e-7 * side.shape[1]


def _products(left: np.ndarray, right: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs in reach and their products, tile by tile; ``own``: of one side with itself, i <= j."""
    room, least = np.empty(TILE[0] * TILE[1], np.float32), 1 - _rounding(left)
    for s in range(0, len(left), TILE[0]):
        a = left[s : s + TILE[0]]
        for t in range(s if own else 0, len(right), TILE[1]):
            b = right[t : t + TILE[1]]
            got = np.dot(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
            hit = np.flatnonzero(got >= least)
            if len(hit):
                i, j, value = s + hit // len(b), t + hit % len(b), got.ravel()[hit]
                yield (i[i <= j], j[i <= j], value[i <= j]) if own else (i, j, value)


def _descend(a: np.ndarray, b: np.ndarray, ta: Tree, tb: Tree, level: int, reach: float, cosine: float, whole: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What the node pairs (a, b) of the level above ``level`` hold. Children of two large nodes meet
    in products; those of small nodes in pairs from many nodes together. A node meets itself where
    both trees are one; its children then meet once."""
    if not len(a):
        return
    bottom = len(ta.centres) - 1
    alike = lambda k, n: len(ta.centres[k]) == len(ta.centres[n]) and len(tb.centres[k]) == len(tb.centres[n])
    same, last = ta is tb, alike(level, bottom)  # a level that is the one below has its numbers
    below = next(k for k in range(level + 1, bottom + 2) if k > bottom or not alike(k, level))
    (oa, sa), (ob, sb) = ta.children[level - 1], tb.children[level - 1]
    large = (sa[a + 1] - sa[a]) * (sb[b + 1] - sb[b]) >= PRODUCT

    def onward(ca: np.ndarray, cb: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        i, j = ta.centres[level][ca], tb.centres[level][cb]
        cos = np.einsum("ij,ij->i", ta.x[i], tb.x[j])
        if last:
            hit = cos >= cosine
            yield bottom, ca[hit], cb[hit]
        else:
            gap, spread = np.sqrt(np.maximum(0, 2 - 2 * cos)), ta.radius[level][ca] + tb.radius[level][cb]
            inside = gap + spread <= reach - SLACK if whole else np.zeros(len(gap), bool)
            near = ~inside & (gap <= reach + spread + SLACK)
            yield level, ca[inside], cb[inside]
            yield from _descend(ca[near], cb[near], ta, tb, below, reach, cosine, whole)

    for na, nb in zip(a[large].tolist(), b[large].tolist(), strict=True):
        ca, cb = oa[sa[na] : sa[na + 1]], ob[sb[nb] : sb[nb + 1]]
        left, own = ta.side(level, reach)[ca], same and na == nb
        for i, j, value in _products(left, tb.side(level, None)[cb], own):
            if last:
                sure = value >= cosine + (reach + SLACK) ** 2 / 2 + _rounding(left)
                if own:
                    sure, i, j = sure[i < j], i[i < j], j[i < j]
                yield bottom, ca[i[sure]], cb[j[sure]]
                i, j = i[~sure], j[~sure]
            for k in range(0, len(i), SLICE):
                yield from onward(ca[i[k : k + SLICE]], cb[j[k : k + SLICE]])
    if not large.all():
        a, b = a[~large], b[~large]
        for ca, cb, pair in _children(a, b, ta, tb, level - 1):
            if same:
                once = (a[pair] != b[pair]) | ((ca < cb) if last else (ca <= cb))
                ca, cb = ca[once], cb[once]
            yield from onward(ca, cb)


def traverse(ta: Tree, tb: Tree, reach: float, cosine: float, whole: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, a, b) in slices: on the last level points with cosine >= ``cosine``, each pair once; with
    ``whole`` also nodes of the levels above of which all points link (a node with itself: all pairs
    within it). The top nodes are few: the coarsest net covers the sphere."""
    a, b = (v.ravel() for v in np.meshgrid(np.arange(len(ta.centres[0])), np.arange(len(tb.centres[0])), indexing="ij"))
    if ta is tb:
        a, b = a[a <= b], b[a <= b]
    yield from _descend(a, b, ta, tb, 1, reach, cosine, whole)


class Found:
    """Links and a spanning forest of the n rows of a task, while a traversal goes on. ``rows``: those of
    each tree's points."""

    def __init__(self, copies: np.ndarray, trees: tuple[Tree, Tree], rows: tuple[np.ndarray, np.ndarray]):
        self.copies, self.trees, self.rows, self.one = copies, trees, rows, trees[0] is trees[1]
        self.links, self.root, self.apart, self.nodes = np.zeros(len(copies), np.int64), np.arange(len(copies)), [], {}

    def _of_level(self, side: int, level: int) -> tuple[np.ndarray, ...]:
        """Copies within each node, links that come to each of its points, nodes that link as a whole, and
        nodes that link with themselves."""
        if (side, level) not in self.nodes:
            tree, weight = self.trees[side], np.zeros(len(self.trees[side].centres[level]), np.int64)
            np.add.at(weight, tree.of[level], self.copies[self.rows[side]])
            self.nodes[side, level] = weight, np.zeros_like(weight), np.zeros(len(weight), bool), np.zeros(len(weight), bool)
        return self.nodes[side, level]

    def add(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        i, j = self.rows[0][self.trees[0].centres[level][a]], self.rows[1][self.trees[1].centres[level][b]]
        if level == len(self.trees[0].centres) - 1:
            np.add.at(self.links, i, self.copies[j])
            np.add.at(self.links, j, self.copies[i])
        else:
            wa, la, va, own = self._of_level(0, level)
            wb, lb, vb, _ = self._of_level(0 if self.one else 1, level)
            other = a != b if self.one else np.ones(len(a), bool)
            np.add.at(la, a, wb[b])
            np.add.at(lb, b[other], wa[a[other]])
            va[a], vb[b], own[a[~other]] = True, True, True
        self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.root[i] != self.root[j]
        if new.any():
            self.apart.append((i[new], j[new]))
        if sum(len(a) for a, _ in self.apart) > len(self.root):
            self._settle()

    def _settle(self) -> None:
        self.root, self.apart = forest(len(self.root), self.apart, self.root), []

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(links, root): for each row its links and one row for all that are joined."""
        for (side, level), (_, links, whole, own) in self.nodes.items():
            tree, rows = self.trees[side], self.rows[side]
            of = tree.of[level]
            self.links[rows] += links[of] - self.copies[rows] * own[of]
            self._join(rows[whole[of]], rows[tree.centres[level][of[whole[of]]]])
        self._settle()
        return self.links, self.root


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> np.ndarray:
    """For each of n points the least point joined to it by the pairs, and by what ``root`` has joined."""
    root = np.arange(n) if root is None else root
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int | None = None, pairs: bool = False) -> DataFrame:
    """One row for each input row: (vec_id, n_links, component_id, kept), or with ``pairs`` the
    exact pairs (a, b, cosine) between classes of equal vectors, named by their least ids.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing:
    0 links, their own component. Vectors of different length never link. A null id counts as a
    vector, but has a null component unless linked to a vector with an id. Repeated rows are
    vectors of their own; other columns are not carried. An empty table gives no rows. ``block``:
    vectors of a block at most, by default what BLOCK_BYTES holds.
    """
    spark = vectors.sparkSession
    array = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"  # floats travel as such
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(array).alias("embedding"))
    marked = store(base.mapInArrow(_digests, "vec_id long, digest binary, dim int"), "digests")
    raw = base.mapInArrow(_with_digest, f"digest binary, dim int, embedding {array}")
    classes = marked.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    units = raw.groupBy("digest", "dim").agg(F.first("embedding").alias("embedding"))
    # a class's number ``cls`` is made while writing, since its vectors may have no id
    reps = store(units.join(classes, "digest").withColumn("cls", F.monotonically_increasing_id()), "classes")
    most = F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))) if block is None else F.lit(block)
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n")).withColumn("most", F.greatest(F.lit(16), most))
    # lengths with a block or more of vectors are few (a block of each is there); all others take a task each
    large = {r["dim"]: (r["n"], r["most"]) for r in sizes.where("n > most").collect()}
    kind = "a long, b long, cosine double" if pairs else "cls long, links long, low long"
    work = _Pairs(math.sqrt(max(0.0, 2 - 2 * cosine)), cosine, pairs)
    met = reps.where(~F.col("dim").isin(list(large))).select("dim", "cls", "copies", "embedding").groupBy("dim").applyInArrow(lambda group: work.within(group), kind)
    for dim, (n, m) in sorted(large.items()):
        met = met.union(_link_dim(reps.where(F.col("dim") == dim), n, m, work, kind, array))
    names = reps.select("cls", "id")
    if pairs:
        first, second = (names.select(F.col("cls").alias(c), F.col("id").alias(f"{c}_id")) for c in "ab")
        named = met.join(first, "a").join(second, "b")
        return named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "cosine")
    links = store(met, "links")
    roots = components(links.where("low < cls").select("cls", "low")).join(names, F.col("node") == F.col("cls")).select("node", "component", "id")
    least = roots.groupBy("component").agg(F.min("id").alias("least"))
    found = roots.join(least, "component").select("node", "least")
    total = links.groupBy(F.col("cls").alias("of")).agg(F.sum("links").alias("links"))
    whole = reps.select("digest", "cls", "copies", "id").join(total, F.col("cls") == F.col("of"), "left").join(found, F.col("cls") == F.col("node"), "left")
    whole = whole.select(F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "id").alias("c"))
    out = marked.join(whole, F.col("digest") == F.col("d"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, dims = _digest(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([digests, dims, batch.column("embedding")], ["digest", "dim", "embedding"]).filter(digests.is_valid())


class _Pairs:
    """Links among the vectors of a task, by dual traversal."""

    def __init__(self, reach: float, cosine: float, pairs: bool):
        self.reach, self.cosine, self.pairs = reach, cosine, pairs

    def result(self, group: pa.Table, x: np.ndarray, trees: tuple[Tree, Tree], rows: tuple[np.ndarray, np.ndarray]) -> pa.Table:
        """``rows``: the group's rows that are the points of each tree."""
        ids = np.asarray(group["cls"])
        found = traverse(*trees, self.reach, self.cosine, not self.pairs)
        if self.pairs:
            i, j = (np.concatenate(v) for v in zip((ids[:0], ids[:0]), *((rows[0][a], rows[1][b]) for _, a, b in found if len(a)), strict=True))
            return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "cosine": np.einsum("ij,ij->i", x[i], x[j])})
        held = Found(np.asarray(group["copies"]), trees, rows)
        for level, a, b in found:
            if len(a):
                held.add(level, a, b)
        links, root = held.result()
        low = ids.copy()
        np.minimum.at(low, root, ids)
        hit = links > 0
        return pa.table({"cls": ids[hit], "links": links[hit], "low": low[root][hit]})

    def within(self, group: pa.Table) -> pa.Table:
        """All vectors of one length that fit a block."""
        x = _matrix(group["embedding"])
        tree = Tree(x, nested_nets(x, self.reach))
        return self.result(group, x, (tree, tree), (np.arange(len(x)),) * 2)

    def between(self, group: pa.Table) -> pa.Table:
        """Rows of one block with itself, or of two blocks."""
        same = group["i"][0].as_py() == group["j"][0].as_py()
        block, place = np.asarray(group["block"]), np.asarray(group["place"])
        order = np.lexsort((place, block))
        x, levels = _matrix(group["embedding"]), np.asarray(group["nodes"].combine_chunks().flatten()).reshape(len(block), -1).T
        rows = [order[block[order] == b] for b in np.unique(block)]
        if not same and len(rows) < 2:  # no vector of the other block is in reach
            rows.append(order[:0])
        trees = [Tree(x[r], levels[:, r]) for r in rows]
        return self.result(group, x, (trees[0], trees[-1]), (rows[0], rows[-1]))


def _blocks_of(near: np.ndarray, sizes: np.ndarray, most: int) -> list[list[tuple[int, int, int]]]:
    """(cell, part, parts) of each block: cells in an order that keeps neighbours together, until a
    block is full; a cell above ``most`` is split into blocks of its own."""
    blocks, held, total = [], [], 0
    for c in near.tolist():
        n = int(sizes[c])
        if n > most:
            blocks += [[(c, k, -(-n // most))] for k in range(-(-n // most))]
            continue
        if total + n > most:
            blocks.append(held)
            held, total = [], 0
        held.append((c, 0, 1))
        total += n
    return [b for b in [*blocks, held] if b]


def _link_dim(reps: DataFrame, n: int, most: int, work: _Pairs, kind: str, array: str) -> DataFrame:
    """Links among more classes of one dimension than a block holds: (cls, links, low), or the pairs."""
    sample = reps.orderBy(F.xxhash64("digest"), "digest").limit(PIVOT_SAMPLE).select("embedding").toPandas()
    reach = work.reach
    points = _unit(np.concatenate(sample["embedding"].to_list()), len(sample))
    pivots = points[farthest_first(points, max(1, min(MAX_PIVOTS, math.ceil(n / CELL))))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = _matrix(batch.column("embedding")) @ pivots.T
            cell = cos.argmax(1)
            gap = np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(cell)), cell]))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("copies"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(gap)], ["cls", "copies", "embedding", "cell", "gap"])

    dealt = store(reps.select("cls", "copies", "embedding").mapInArrow(deal, f"cls long, copies long, embedding {array}, cell int, gap double"), "cells")
    sizes, gaps = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():  # at most MAX_PIVOTS rows
        sizes[r["cell"]], gaps[r["cell"]] = r["n"], r["gap"]
    # few enough pivots of the net's beginning to lead a block each: cells follow their leader
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    wanted = max(2, math.ceil(n / most), math.ceil(math.sqrt(2 * cores)))
    leader = (pivots @ pivots[:wanted].T).argmax(1)
    filled = np.flatnonzero(sizes)
    blocks = _blocks_of(filled[np.argsort(leader[filled], kind="stable")], sizes, min(most, math.ceil(n / wanted)))
    first, parts = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    holds = np.zeros((len(pivots), len(blocks)), bool)
    for b, cells in enumerate(blocks):
        for c, k, m in cells:
            holds[c, b] = True
            first[c], parts[c] = b - k, m
    place = lambda v: F.get(F.array(*[F.lit(int(x)) for x in v]), F.col("cell"))
    rows = dealt.withColumn("block", (place(first) + F.pmod(F.xxhash64("cls"), place(parts))).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        levels = nested_nets(_matrix(group["embedding"]), reach)
        return group.append_column("nodes", pa.array(list(levels.T.astype(np.int32)), pa.list_(pa.int32()))).append_column("place", pa.array(np.arange(group.num_rows), pa.int32()))

    schema = f"cls long, copies long, embedding {array}, block int, nodes array<int>, place int"
    trees = store(rows.select("cls", "copies", "embedding", "block").groupBy("block").applyInArrow(build, schema), "trees")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector for the pair of its block with itself, and with every block in its reach."""
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for low in range(0, len(x), 4096):
                own = np.asarray(batch.column("block"))[low : low + 4096]
                limit = reach + np.maximum(gaps, -1) + SLACK
                near = (2 - 2 * (x[low : low + 4096] @ pivots.T) <= limit * limit) & (sizes > 0)
                meets = near.astype(np.float32) @ holds.astype(np.float32) > 0
                meets[np.arange(len(own)), own] = True
                row, other = np.nonzero(meets)
                for k in range(0, len(row), 8192):
                    r, o = row[k : k + 8192], other[k : k + 8192]
                    i, j = np.minimum(own[r], o).astype(np.int32), np.maximum(own[r], o).astype(np.int32)
                    yield batch.take(pa.array(low + r)).append_column("i", pa.array(i)).append_column("j", pa.array(j))

    copied = trees.mapInArrow(meet, schema + ", i int, j int")
    return copied.groupBy("i", "j").applyInArrow(lambda group: work.between(group), kind)
