"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Each run is a random recursive split: a set of n
shingles goes on, from a node of the tree, to a child for each shingle that a hash of (node,
shingle) picks with probability 1 / (t n), so sets with Jaccard t or more meet in a child about
once. A set's paths depend on the set alone and are made in one pass, level by level; only buckets
still above ``BUCKET`` go on to the next level. Small buckets are compared by brute force, on
sketches; buckets that stay large at the last level are compared in blocks, so none is dropped: each
block with the first one, and then only what that hasn't brought into one component.
Runs repeat until the chance that a pair at the threshold never met is below 1 - recall, by the
extinction probability of the path process at the deepest level. Buckets that could only repeat what
the first runs have found are left out of later ones, so a large group of near copies costs a few
runs, not all.

What the sketches let through joins documents to candidate groups; within each group, in blocks,
all pairs are decided on the whole shingle sets. Equal sets are one class and are compared once.
A task returns link counts and a spanning forest, never the pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import bounded_broadcast, store
from chatframe.llm.components import components
from chatframe.llm.cover_tree import forest

WORDS, THRESHOLD, RECALL, DEPTH = 5, 0.8, 0.99, 3
#: Bucket size from which a bucket goes on to the next level, and rows of a block: a bucket that stays
#: is compared in groups of two blocks, so that no key has more than two blocks' rows.
BUCKET, BLOCK = 2048, 256
#: Runs whose buckets are compared first. Later runs leave out buckets whose texts those have already
#: brought into one candidate group, since comparing them would add nothing.
FIRST_RUNS = 3
#: Documents and shingles of a block of a candidate group; two blocks meet in a task.
GROUP_DOCS, GROUP_SHINGLES = 256, 1_000_000
#: Bins of a sketch (16 bits each), and how far below the threshold its estimate may be.
BINS, MARGIN = 128, 0.16
#: Rows that a streaming task works on together.
FLUSH = 20_000
#: Words whose hashes a worker remembers; bounds memory, not results.
MEMO = 150_000

WORD = re.compile(r"[^\W_]+")
U = np.uint64
C1, C2, C3, C4 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Word -> hash, for at most MEMO words at a time: a worker keeps it between tasks."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words (lower case; punctuation and
    spacing don't count). A shorter text is one shingle; one without words has none."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * C1 + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h + U(k)))


def sketch(s: np.ndarray) -> np.ndarray:
    """One-permutation minima: 16 bits for each bin of the hash range, 0 for an empty bin."""
    out = np.zeros(BINS, np.uint16)
    bins = (s >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = np.maximum(s[first] & U(0xFFFF), U(1))
    return out


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold, which meets in one child on average, has met at
    ``depth`` with probability ``recall``: q is the chance that a run's paths die out before."""
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def paths(s: np.ndarray, runs: int, depth: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(runs, parents, keys) for each level: the nodes that the set goes to, and from where."""
    limit = U(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    of, nodes = np.arange(runs, dtype=np.int32), _mix(np.arange(1, runs + 1, dtype=np.uint64) * C1)
    for _ in range(depth):
        origins, parents, keys = [], [], []
        step = max(1, 2_000_000 // len(s))
        for at in range(0, len(nodes), step):
            z = (nodes[at : at + step, None] ^ s[None, :]) * C4
            z ^= z >> U(32)
            z *= C2
            i, j = np.nonzero(z <= limit)
            origins.append(of[at + i])
            parents.append(nodes[at + i])
            keys.append(_mix(nodes[at + i] * C3 + s[j]))
        of, parents, nodes = np.concatenate(origins), np.concatenate(parents), np.concatenate(keys)
        yield of, parents, nodes
        if not len(nodes):
            return


def _mark(runs: int, depth: int, threshold: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, sketches, ends = [], [], [], [0]
            levels, origins, parents, keys = ([np.zeros(0, kind)] for kind in (np.int32, np.int32, U, U))
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s).tobytes())
                ends.append(ends[-1])
                for k, (of, above, below) in enumerate(paths(s, runs, depth, threshold) if len(s) else ()):
                    levels.append(np.full(len(below), k + 1, np.int32))
                    origins.append(of)
                    parents.append(above)
                    keys.append(below)
                    ends[-1] += len(below)
            fields = [np.concatenate(levels), np.concatenate(origins), np.concatenate(parents).view(np.int64), np.concatenate(keys).view(np.int64)]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in fields], ["level", "run", "parent", "key"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), nodes], ["doc_id", "text_hash", "digest", "n", "sketch", "nodes"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on tables of about FLUSH rows from a partition sorted by ``key``, no key's rows
    apart. Keys have bounded groups, so tables are bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, FLUSH):
            held.append(batch.slice(at, FLUSH))
            if sum(b.num_rows for b in held) >= FLUSH:
                rows = pa.Table.from_batches(held)
                start = pc.index(rows[key], rows[key][-1]).as_py()
                if start:
                    yield work(rows.slice(0, start).combine_chunks())
                held = rows.slice(start).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield work(pa.Table.from_batches(held).combine_chunks())


def _edges(ids: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Edges of a forest over the classes that the rows of a table name, each class once."""
    names, at = np.unique(ids, return_inverse=True)
    low = names[forest(len(names), [(at[a], at[b]) for a, b in pairs])] if len(ids) else names
    apart = low != names
    return pa.RecordBatch.from_arrays([pa.array(names[apart], pa.int64()), pa.array(low[apart], pa.int64())], ["u", "v"])


def _compare(threshold: float):
    """Within each group: edges of a forest over the pairs whose sketches may reach the threshold.
    Rows of one side only (``side`` equal and below 2) are not compared."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        keys = np.asarray(rows["g"].to_numpy(zero_copy_only=False))
        ids, n, side = (np.asarray(rows[c]) for c in ("cls", "n", "side"))
        marks = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, BINS)
        pairs = []
        for gap in range(1, len(keys)):
            i = np.flatnonzero(keys[gap:] == keys[:-gap])
            if not len(i):
                break
            j = i + gap
            fine = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & ((side[i] != side[j]) | (side[i] == 2)) & (ids[i] != ids[j])
            i, j = i[fine], j[fine]
            for at in range(0, len(i), 50_000):
                a, b = marks[i[at : at + 50_000]], marks[j[at : at + 50_000]]
                same = ((a == b) & (a > 0)).sum(1)
                used = BINS - ((a == 0) & (b == 0)).sum(1)
                near = same >= (threshold - MARGIN) * used
                pairs.append((i[at : at + 50_000][near], j[at : at + 50_000][near]))
        return _edges(ids, pairs)

    return lambda batches: whole_groups(batches, "g", work)


def _blocks(rows: DataFrame, key: str, parts: str) -> DataFrame:
    """A group of ``parts`` blocks as groups of one or two: each row goes to the pairs of its block
    with every block; ``g`` names the pair, ``side`` is 2 where all its rows are compared."""
    one = F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    rows = rows.withColumn("_b", one).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    pair = F.xxhash64(key, F.least("_b", "_o"), F.greatest("_b", "_o"))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return rows.withColumn("g", pair).withColumn("side", side).drop("_b", "_o")


def _anchored(rows: DataFrame) -> DataFrame:
    """A bucket of ``parts`` blocks as a group for each: its own rows are compared with each other and
    with those of the first block, which alone go to every group. Twice the bucket's rows, not their square."""
    one = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    to = F.when(F.col("_b") == 0, F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).otherwise(F.array("_b"))
    rows = rows.withColumn("_b", one).withColumn("_o", F.explode(to))
    return rows.withColumn("g", F.xxhash64("key", "_o")).withColumn("side", F.when(F.col("_b") == F.col("_o"), 2).otherwise(0)).drop("_b", "_o")


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame | None:
    """What ``_anchored`` left: the buckets (key, cls, n) whose classes are still of more than one
    component. All but those of a bucket's largest component meet all of its rows, in pairs of blocks;
    rows of one component needn't meet again. None if no bucket is left."""
    rows = store(rows.join(groups, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("comp")), "apart")
    held = rows.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("comps"))
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    held = store(held.where("comps > 1").select("key", F.col("main.comp").alias("main"), blocks(F.col("main.k")).alias("mains"), blocks(F.col("size") - F.col("main.k")).alias("others")), "mains")
    n_keys = held.count()
    if not n_keys:
        return None
    rows = rows.join(bounded_broadcast(held, n_keys), "key").withColumn("_m", F.col("comp") == F.col("main"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("cls"), F.when(F.col("_m"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(F.col("_m"), F.col("others")).otherwise(F.col("mains") + F.col("others")) - 1)))
    # others meet the main blocks first, and then each other
    own, o = ~F.col("_m") & (F.col("_o") >= F.col("mains")), F.col("_o") - F.col("mains")
    pair = F.when(own, F.xxhash64("key", F.lit(1), F.least("_b", o), F.greatest("_b", o))).when(F.col("_m"), F.xxhash64("key", F.lit(0), "_b", "_o")).otherwise(F.xxhash64("key", F.lit(0), "_o", "_b"))
    side = F.when(own & (F.col("_b") == o), 2).when(own, (F.col("_b") > o).cast("int")).otherwise(F.col("_m").cast("int"))
    return rows.select("cls", "n", pair.alias("g"), side.alias("side"))


def candidates(classes: DataFrame, threshold: float, depth: int) -> DataFrame | None:
    """(node, component) of the classes whose sketches may reach the threshold with another's, from
    all buckets; None if there is no bucket of two."""
    looks = classes.select(F.col("cls").alias("c"), "sketch")
    groups = None
    joined = lambda edges: store(components(edges if groups is None else edges.union(groups.where("node <> component"))), "groups")
    for of in (F.col("node.run") < FIRST_RUNS, F.col("node.run") >= FIRST_RUNS):
        edges, large = _edges_of(classes, looks, of, groups, threshold, depth)
        if edges is not None:
            groups = joined(edges)
        left = None if large is None else _apart(large, groups)
        if left is not None:
            groups = joined(_compared(left, looks, threshold))
    return groups


def _edges_of(classes: DataFrame, looks: DataFrame, of: Column, groups: DataFrame | None, threshold: float, depth: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Edges (u, v) from the buckets of some runs that hold classes of more than one group, and the
    rows (key, cls, n) of buckets that don't fit one group: not all of these have met."""
    nodes = classes.select("cls", "n", F.explode("nodes").alias("node")).where(of)
    edges, above, large = None, None, None
    for level in range(1, depth + 1):
        rows = nodes.where(F.col("node.level") == level).select("cls", "n", F.col("node.parent").alias("parent"), F.col("node.key").alias("key"))
        if above is not None:
            rows = rows.join(above, "parent", "left_semi")
        if groups is None:
            sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        else:
            group = F.coalesce("component", "cls")
            grouped = rows.join(groups, F.col("cls") == F.col("node"), "left").groupBy("key")
            sizes = grouped.agg(F.count("*").alias("size"), F.min(group).alias("low"), F.max(group).alias("high")).where("size > 1 and low <> high").select("key", "size")
        sizes = store(sizes, "buckets")
        most = BUCKET if level < depth else 2**62  # of a bucket that stays at this level
        n_keys, n_large, n_parted = sizes.agg(F.count("*"), F.count_if(F.col("size") > BUCKET), F.count_if(F.col("size").between(2 * BLOCK + 1, most))).first()
        if not n_keys:
            break
        bucketed = rows.select("key", "cls", "n").join(bounded_broadcast(sizes, n_keys), "key")
        stays = bucketed if level == depth else bucketed.where(F.col("size") <= BUCKET)
        stays = stays.withColumn("parts", F.when(F.col("size") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("size") / BLOCK)))
        found = _compared(_anchored(stays), looks, threshold)
        edges = found if edges is None else edges.union(found)
        if n_parted:
            parted = stays.where("parts > 1").select("key", "cls", "n")
            large = parted if large is None else large.union(parted)
        if not n_large:
            break
        above = bounded_broadcast(sizes.where(F.col("size") > BUCKET).select(F.col("key").alias("parent")), n_large)
    return edges, large


def _compared(rows: DataFrame, looks: DataFrame, threshold: float) -> DataFrame:
    rows = rows.join(looks, F.col("cls") == F.col("c")).select("g", "cls", "n", "side", "sketch")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(threshold), "u long, v long")


def _decide(threshold: float):
    """Exact links within each group: (cls, links, low)."""

    def group(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n = np.array([len(s) for s in sets])
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        shared = tokens[counts > 1]
        owner = np.repeat(np.arange(len(sets)), n)
        every = np.concatenate(sets)
        at = np.searchsorted(shared, every)
        held = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == every) if len(shared) else np.zeros(len(every), bool)
        owner, at = owner[held], at[held]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, len(shared), 4096):
            a, b = np.searchsorted(at, (low, low + 4096))
            part = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
            part[owner[a:b], at[a:b] - low] = 1
            overlap += part @ part.T
        union = n[:, None] + n[None, :] - overlap
        close = np.triu(overlap >= threshold * union - 1e-6, 1) & (ids[:, None] != ids[None, :])
        close &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
        i, j = np.nonzero(close)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        return i, j

    def work(rows: pa.Table) -> pa.RecordBatch:
        keys = rows["g"].to_numpy(zero_copy_only=False)
        ids, copies, side = (np.asarray(rows[c]) for c in ("cls", "copies", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
        ends = np.r_[np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        links, pairs, start = np.zeros(len(ids), np.int64), [], 0
        for end in ends:
            order = start + np.unique(ids[start:end], return_index=True)[1]  # rows that repeat an id and its text count once
            own = np.zeros(len(order), np.int64)
            i, j = group(ids[order], copies[order], side[order], [sets[k] for k in order], own)
            links[order] += own
            pairs.append((order[i], order[j]))
            start = end
        # the least row of a component isn't always that of the least id, but any root serves
        low = ids[forest(len(ids), pairs)]
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(low[hit])], ["cls", "links", "low"])

    return lambda batches: whole_groups(batches, "g", work)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            fine = [d == e for d, e in zip(digests, batch.column("digest").to_pylist(), strict=True)]
            out = batch.drop_columns(["text", "digest"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield out.filter(pa.array(fine, pa.bool_()))

    return run


def join_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept, text_hash): one row for each input row.

    class_id: the least id with the same shingle set. n_links: other rows linked, those of the same
    class included. component_id: the least id reachable by links. kept: the row is of the class
    that stands for its component and has its id. text_hash tells texts of one id apart. Texts that
    are null or have no word link with nothing. Ids are integers; rows that repeat an id with another
    text are rows of their own, of which one class at most is kept in a component; rows that repeat
    id and text are copies. Rows with a null id are returned without links. Other columns are not
    carried; an empty table gives no rows. Links are exact; a pair of classes at the threshold is
    found with probability ``recall`` or more.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = runs_for(recall, depth)
    schema = "doc_id long, text_hash long, digest binary, n long, sketch binary, nodes array<struct<level:int,run:int,parent:long,key:long>>"
    marks = store(base.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_mark(runs, depth, threshold, words), schema), "marks")
    named = marks.where("digest is not null and doc_id is not null")
    # a class is a shingle set; its number ``cls`` is made while writing, since an id can have several texts
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    classes = store(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    sums = classes.select("digest", "id", "copies", "cls")
    groups, found = candidates(classes, threshold, depth), None
    if groups is not None:
        groups = groups.select(F.col("node").alias("cls"), F.col("component").alias("cand"))
        members = groups.join(classes.select(F.col("cls").alias("c"), "id", "copies", "digest", "n"), F.col("cls") == F.col("c"))
        parts = members.groupBy("cand").agg(F.ceil(F.greatest(F.count("*") / GROUP_DOCS, F.sum("n") / GROUP_SHINGLES)).alias("parts"))
        members = members.join(parts, "cand").select("cls", "cand", "parts", "id", "copies", "digest")
        # ids of a group of copies differ, so no key of this join is hot; the same plan at every size
        texts = base.join(members.hint("merge"), F.col("doc_id") == F.col("id")).select("cls", "cand", "parts", "copies", "text", "digest")
        sets = texts.mapInArrow(_sets(words), "cls long, cand long, parts long, copies long, shingles binary")
        blocks = _blocks(sets, "cand", "parts").select("g", "side", "cls", "copies", "shingles")
        decided = blocks.repartition("g").sortWithinPartitions("g", "cls").mapInArrow(_decide(threshold), "cls long, links long, low long")
        links = store(decided, "links")
        total = links.groupBy("cls").agg(F.sum("links").alias("links"))
        roots = components(links.where("low <> cls").select("cls", "low")).join(sums, F.col("node") == F.col("cls")).select("cls", "id", "component")
        least = roots.groupBy("component").agg(F.min(F.struct("id", "cls")).alias("least"))
        found = store(total.join(roots.join(least, "component"), "cls").select(F.col("cls").alias("c"), "links", "least"), "found")
    out = marks.select("doc_id", "text_hash", "digest").join(sums.select(F.col("digest").alias("d"), "id", "copies", "cls"), F.col("digest") == F.col("d"), "left")
    if found is not None:
        out = out.join(found, F.col("cls") == F.col("c"), "left")
    else:
        out = out.withColumns({"links": F.lit(0), "least": F.lit(None).cast("struct<id:bigint,cls:bigint>")})
    cls = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("id", "doc_id"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("least.id", cls))
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1)
    kept = F.coalesce((F.col("doc_id") == component) & (F.col("least").isNull() | (F.col("least.cls") == F.col("cls"))), F.lit(False))
    return out.select("doc_id", cls.alias("class_id"), n_links.cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"), "text_hash")
