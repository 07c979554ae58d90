"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most ``capacity``. Only longer documents are cut: all pieces
but the first are full and fill a sequence each, so what has to be packed is one remainder for each
document. Remainders are dealt by hash to groups of bounded size. Several islands evolve packings
of a group, each in its own task: a child takes over well-filled bins of one parent whole and drops
the other parent's bins that hold the same pieces; displaced pieces take the place of smaller ones
where that fills a bin further (a bin dominates another if some of its pieces can be replaced by
fewer larger ones), and best fit places the rest. Evolution goes on while a packing has more bins
than the least possible number. After each epoch an island's best packing moves on to the next
island of its group; in the end the group's best one is kept.

Every group may end with bins that are not full. Closing rounds pool these open bins of FAN groups
at a time and evolve their pieces again, until one group is left: rounds are the logarithm of the
number of groups, and what is pooled is bounded by a few bins for each group.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import store

#: Pieces of a group on average: bounds a task's memory and time.
GROUP = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 16, 4
#: Groups whose open bins are pooled, and open bins of a group at most: those with most room.
FAN, OPEN = 64, 4
#: Pieces of a bin that are looked at, alone and in pairs, for larger ones to replace them.
LOOKED_AT = 12
#: A bin filled this far is worth keeping whole.
WELL_FILLED = 0.995
#: Bits of a sequence id for the bin and for the group; the round stands above.
BIN_BITS, GROUP_BITS = 24, 32
#: Texts of these characters only are split alike by every version of the Unicode tables.
PLAIN = re.compile("[^\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027]|<\\|")

_encoders: dict[tuple[str, bool], object] = {}


def encoder(json_path: str, ranks_path: str | None, specials: bool = True):
    """texts -> lists of ids, as tokenizers gives them for ``json_path`` without added tokens. Without
    ``specials`` the strings of special tokens are plain text.

    With ``ranks_path``, the same vocabulary as ranks, plain texts go through tiktoken, which gives
    the same ids faster; others, and all that could hold a special string, go through tokenizers.
    """
    if (json_path, specials) not in _encoders:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        exact.no_truncation()
        exact.encode_special_tokens = not specials
        fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast is None or PLAIN.search(text):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[json_path, specials] = encode
    return _encoders[json_path, specials]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what full pieces leave."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            rows, places = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    places.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(split, f"doc_id {base.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> np.ndarray:
    """Put the pieces of ``order`` one by one into the bin with the least room that is enough, or
    into a new one. ``bins`` is changed and returned; ``room`` has what each bin has left."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room[r].append(b)
            mask |= 1 << r
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(r)
        room[b] = left = r - size
        bins[i] = b
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    filled = np.bincount(bins, weights=sizes)
    return int((filled > 0).sum()), -float((filled * filled).sum())


def replace_smaller(sizes: np.ndarray, bins: np.ndarray, room: list[int], loose: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Loose pieces take the place of one or two smaller pieces of a bin where that fills it further,
    bin by bin; what they push out is loose. ``bins`` and ``room`` are changed; returns what is loose."""
    waiting = sorted(zip(sizes[loose].tolist(), loose.tolist(), strict=True))
    open_bins = {b: [] for b, r in enumerate(room) if r > 0}
    inside = np.flatnonzero(np.isin(bins, list(open_bins)))
    for i, b in zip(inside.tolist(), bins[inside].tolist(), strict=True):
        open_bins[b].append(i)
    size = sizes.tolist()
    for b in rng.permutation(list(open_bins)).tolist():
        held = open_bins[b]
        while room[b] and waiting:
            some = held if len(held) <= LOOKED_AT else rng.choice(held, LOOKED_AT, replace=False).tolist()
            best, gone = 0, ()
            for out in (*((i,) for i in some), *combinations(some, 2)):
                freed = sum(size[i] for i in out)
                k = bisect_right(waiting, (room[b] + freed, len(size))) - 1
                if k >= 0 and waiting[k][0] - freed > best:
                    best, gone, chosen = waiting[k][0] - freed, out, k
            if not best:
                break
            _, i = waiting.pop(chosen)
            held = [j for j in held if j not in gone] + [i]
            bins[i], room[b] = b, room[b] - best
            for j in gone:
                insort(waiting, (size[j], j))
                bins[j] = -1
    return np.array([i for _, i in waiting], np.int64)


def _rebuild(bins: np.ndarray, out: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Place the pieces where ``out`` into the bins of the others: in place of smaller ones, then by
    best fit. Bins are numbered anew."""
    bins = bins.copy()
    kept, bins[~out] = np.unique(bins[~out], return_inverse=True)
    room = (capacity - np.bincount(bins[~out], weights=sizes[~out], minlength=len(kept))).astype(int).tolist()
    bins[out] = -1
    order = replace_smaller(sizes, bins, room, np.flatnonzero(out), rng)
    order = order[np.argsort(-(sizes[order] + rng.random(len(order)) * rng.choice([0.5, 64.0])), kind="stable")]
    return best_fit(sizes, order, bins, room, capacity)


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """``a`` with some well-filled bins of ``b`` put in whole."""
    filled = np.bincount(b, weights=sizes)
    chosen = (filled >= min(WELL_FILLED * capacity, np.median(filled[filled > 0]))) & (rng.random(len(filled)) < 0.5)
    inject = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[inject]] = True
    child = a.copy()
    child[inject] = len(hit) + b[inject]
    return _rebuild(child, hit[a] & ~inject, sizes, rng, capacity)


def mutate(a: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Empty the least-filled bins and a few others, and pack their pieces again."""
    filled = np.bincount(a, weights=sizes)
    open_bins = np.zeros(len(filled), bool)
    open_bins[np.argsort(filled, kind="stable")[: max(2, len(filled) // 50)]] = True
    open_bins |= rng.random(len(filled)) < 0.02
    return _rebuild(a, open_bins[a], sizes, rng, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: tuple[int, ...], capacity: int, generations: int = GENERATIONS, size: int = POPULATION) -> tuple[list[np.ndarray], int]:
    """The best packings, best first, and how many generations were bred: it stops at the least
    possible number of bins."""
    rng = np.random.default_rng(seed)
    population = list(population)
    while len(population) < size:
        noise = 0 if not population else 200
        order = np.argsort(-(sizes + rng.random(len(sizes)) * noise), kind="stable")
        population.append(best_fit(sizes, order, np.zeros(len(sizes), np.int64), [], capacity))
    least = -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(p, sizes), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])[:size]
    ran = 0
    while ran < generations and ranked[0][0][0] > least:
        ran += 1
        a, b = (ranked[min(rng.integers(0, len(ranked), 2))][2] for _ in range(2))
        child = mutate(crossover(a, b, sizes, rng, capacity), sizes, rng, capacity)
        ranked = sorted([*ranked, (fitness(child, sizes), -ran, child)], key=lambda x: x[:2])[:size]
    return [p for _, _, p in ranked], ran


ISLAND = "grp long, island int, uids array<long>, sizes array<int>, population array<array<int>>, bins int"


def islands_of(state: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(grp, uids, sizes, bin): the best packing of each group of (grp, uid, length)."""

    def start(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["uid"]))
        uids, sizes = np.asarray(table["uid"])[order], np.asarray(table["length"])[order].astype(np.int64)
        grp, island = table["grp"][0].as_py(), table["island"][0].as_py()
        return _row(grp, island, uids, sizes, evolve(sizes, [], (grp, island, 0), capacity)[0])

    def onward(epoch: int):
        def step(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["from"] != r["island"], r["from"]))
            sizes = np.array(rows[0]["sizes"], np.int64)
            population = [np.array(p, np.int64) for r in rows for p in r["population"]]
            grp, island = rows[0]["grp"], rows[0]["island"]
            return _row(grp, island, np.array(rows[0]["uids"], np.int64), sizes, evolve(sizes, population, (grp, island, epoch), capacity)[0])

        return step

    state = state.select("grp", "uid", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.groupBy("grp", "island").applyInArrow(start, ISLAND)
    for epoch in range(1, epochs):
        state = store(state, "islands")
        elite = state.select("grp", ((F.col("island") + 1) % islands).alias("island"), "uids", "sizes", F.slice("population", 1, 1).alias("population"), F.col("island").alias("from"))
        both = state.select("grp", "island", "uids", "sizes", "population", F.col("island").alias("from")).union(elite)
        state = both.groupBy("grp", "island").applyInArrow(onward(epoch), ISLAND)
    return state.groupBy("grp").agg(F.min_by(F.struct("uids", "sizes", F.element_at("population", 1).alias("bin")), F.struct("bins", "island")).alias("b")).select("grp", "b.*")


def left_open(filled: np.ndarray, capacity: int) -> np.ndarray:
    """The bins that go to a closing round: at most OPEN, those with most room, if not well filled."""
    open_bins = np.zeros(len(filled), bool)
    open_bins[np.argsort(filled, kind="stable")[:OPEN]] = True
    return open_bins & (filled < WELL_FILLED * capacity)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS, fan: int = FAN) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts are empty: their one token is ``end_id``. Repeated rows are packed as documents of
    their own. Other columns are not carried. An empty table gives no rows. Reruns over the same
    stored pieces give the same packing.
    """
    cutup = store(pieces(docs, tokenizer, ranks, capacity, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = cutup.where(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // group))

    def lay(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    bins, sizes, uids = (np.array(r[k], np.int64) for k in ("bin", "sizes", "uids"))
                    order = np.argsort(bins, kind="stable")
                    ends = np.cumsum(sizes[order])
                    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                    base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
                    names, bins = np.unique(bins[order], return_inverse=True)
                    open_bins = np.zeros(len(names), bool) if last else left_open(np.bincount(bins, weights=sizes[order]), capacity)
                    sequence = (((number << GROUP_BITS) + r["grp"]) << BIN_BITS) + bins
                    yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(np.full(len(bins), r["grp"])), pa.array(sizes[order]), pa.array(sequence), pa.array(ends - sizes[order] - base), pa.array(open_bins[bins])], ["u", "grp", "length", "sequence_id", "offset", "open"])

        return run

    state, places, number = loose.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"), "uid", "length"), None, 0
    while True:
        groups = groups if places is None else -(-groups // fan)
        best = islands_of(state, capacity, islands, epochs)
        laid = store(best.mapInArrow(lay(number, groups == 1), "u long, grp long, length long, sequence_id long, offset long, open boolean"), "places")
        done = laid.where("not open").select("u", "sequence_id", "offset")
        places, number = done if places is None else places.union(done), number + 1
        if groups == 1:
            break
        state = laid.where("open").select(F.floor(F.col("grp") / fan).alias("grp"), F.col("u").alias("uid"), "length")
    whole = cutup.join(places, F.col("uid") == F.col("u"), "left")
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", -1 - F.col("uid")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def _row(grp: int, island: int, uids: np.ndarray, sizes: np.ndarray, ranked: list[np.ndarray]) -> pa.Table:
    row = {"grp": grp, "island": island, "uids": uids.tolist(), "sizes": sizes.tolist(), "population": [p.tolist() for p in ranked], "bins": fitness(ranked[0], sizes)[0]}
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32()]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))
