"""Packing by minimum bin slack over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens, and pieces of one length are alike: what has to
be packed is how many there are of each length, ``capacity`` numbers whatever the corpus holds. A window
starts with the longest piece left; a subset-sum dynamic programme over a bitset picks from the multiset
of lengths left what fills the rest closest, and a walk back over its steps gives the count of each
length. The same window is used as often as the counts allow, so windows differ at most as often as a
length runs short, which the capacity bounds too. Where a window can't be filled exactly, a longer piece
is cut to fill it and its rest goes back. What is left at the end, less than a window, goes to windows of
powers of two, which need no padding.

The plan says for the r-th piece of each length where it goes. Pieces are numbered where they are made,
by length within their task; a sum over the tasks' counts makes that a number of the whole table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatframe.llm.common import store
from chatframe.llm.packing import cut, encoder

#: Bits for a piece's number among those of its length.
RANK_BITS = 40
PIECES = "start long, length int, doc_tokens long, part int, rank long, ids binary"


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of which of ``lengths`` (ascending) together come closest to ``room``, none beyond.

    Bit s of ``reach`` says that some pieces sum to s. Counts go in as 1, 2, 4 ... pieces at once.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, some = min(counts[length], room // length), 1
        while left > 0:
            some = min(some, left)
            steps.append((length, some, reach))
            reach |= reach << length * some & mask
            left, some = left - some, some * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            at -= length * some
            used[length] = used.get(length, 0) + some
    return used


def plan(counts: dict[int, int], capacity: int, cuts: bool = True) -> np.ndarray:
    """Rows (length, start, rank, pieces, part length, sequence, each, nth, offset) in order.

    Of the pieces of ``length``, ``pieces`` ones from number ``rank`` on give their tokens from
    ``start`` on, as many as the part length: the k-th of them goes to ``sequence`` + (nth + k) //
    ``each``, at ``offset`` + (nth + k) % ``each`` x the part length.
    """
    counts = {k: n for k, n in counts.items() if n}
    lots = {k: deque([(k, 0, 0, n)]) for k, n in counts.items()}  # length -> (piece length, start, rank, pieces)
    lengths, left, rows, sequence = sorted(counts), sum(k * n for k, n in counts.items()), [], 0

    def drop(length: int, n: int) -> None:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
            lengths.remove(length)

    def take(length: int, each: int, times: int, offset: int, part: int) -> None:
        need, nth, rest = each * times, 0, []
        drop(length, need)
        while nth < need:
            whole, start, rank, n = lots[length].popleft()
            if n > need - nth:
                lots[length].appendleft((whole, start, rank + need - nth, n - (need - nth)))
                n = need - nth
            rows.append((whole, start, rank, n, part, sequence, each, nth, offset))
            rest.append((whole, start + part, rank, n))
            nth += n
        if part < length:
            if length - part not in counts:
                insort(lengths, length - part)
            counts[length - part] = counts.get(length - part, 0) + need
            lots.setdefault(length - part, deque()).extend(rest)

    while left:
        size = capacity if left >= capacity or not cuts else 1 << left.bit_length() - 1
        fitting = bisect_right(lengths, size)
        first = lengths[fitting - 1] if fitting else 0
        window = {first: 1} if first else {}
        if first < size:
            others = {**counts, first: counts[first] - 1} if first else counts
            for length, n in fill(lengths, others, size - first).items():
                window[length] = window.get(length, 0) + n
        room = size - sum(k * n for k, n in window.items())
        need = dict(window)
        longer = next((k for k in reversed(lengths) if k > room and counts[k] > need.get(k, 0)), 0) if room and cuts else 0
        if longer:
            need[longer] = need.get(longer, 0) + 1
        times = min(counts[k] // n for k, n in need.items())
        times = min(times, left // size) if cuts else times
        offset = 0
        for length, n in sorted(window.items(), reverse=True):
            take(length, n, times, offset, length)
            offset += length * n
        if longer:
            take(longer, 1, times, offset, room)
            offset += room
        left, sequence = left - offset * times, sequence + times
    return np.array(sorted(rows), np.int64).reshape(-1, 9)


def places(steps: np.ndarray, capacity: int, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which, start, part length, sequence, offset) of the parts of pieces given by length and number."""
    kinds, kind = np.unique(steps[:, 0] * (capacity + 1) + steps[:, 1], return_inverse=True)
    keys = (kind << RANK_BITS) + steps[:, 2]
    which, start, found = np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(which):
        kind = np.searchsorted(kinds, length[which] * (capacity + 1) + start)
        at = np.searchsorted(keys, (kind << RANK_BITS) + rank[which], "right") - 1
        _, _, first, _, part, sequence, each, nth, offset = steps[at].T
        nth = nth + rank[which] - first
        found.append((which, start, part, sequence + nth // each, offset + nth % each * part))
        start = start + part
        which, start = which[start < length[which]], start[start < length[which]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (which, start, start, start, start)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces with their ids, numbered by length within their task."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer, ranks), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows, of, parts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for start, length in cut(len(ids), capacity):
                    of.append(i)
                    rows.append((start, length, len(ids), seen[length]))
                    parts.append(ids[start : start + length].tobytes())
                    seen[length] += 1
            start, length, tokens, rank = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(start), pa.array(length, pa.int32()), pa.array(tokens), pa.array(np.full(len(rows), part), pa.int32()), pa.array(rank), pa.array(parts, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "part", "rank", "ids"],
            )

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(split, f"doc_id {base.schema[0].dataType.simpleString()}, {PIECES}")


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", cuts: bool = True) -> DataFrame:
    """One row for each piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` holds the piece's tokens, little-endian and unsigned, of four bytes each. With ``cuts``
    every sequence holds ``capacity`` tokens or a power of two; without, only documents longer than
    that are cut, and sequences may end early. Null texts are empty: their one token is ``end_id``.
    Repeated rows are packed as documents of their own; equal lengths go by number. Other columns
    are not carried, so their names don't matter. An empty table gives no rows.
    """
    cutup = store(pieces(docs, tokenizer, ranks, capacity, end_id, id_col, text_col), "pieces")
    counts = cutup.groupBy(F.col("part").alias("p"), F.col("length").alias("l")).agg((F.max("rank") + 1).alias("here"))
    counts = store(counts.withColumn("base", F.sum("here").over(Window.partitionBy("l").orderBy("p")) - F.col("here")), "lengths")
    lengths = counts.groupBy("l").agg(F.sum("here").alias("n")).collect()  # a row for each length, so capacity rows at most
    steps = plan({r.l: r.n for r in lengths}, capacity, cuts)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, start = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank", "start"))
            which, at, part, sequence, offset = places(steps, capacity, length, rank)
            ids, of = batch.column("ids").to_pylist(), pa.array(which)
            parts = [ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(which.tolist(), at.tolist(), part.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), pa.array(start[which] + at), pa.array(part), batch.column("doc_tokens").take(of), pa.array(sequence), pa.array(offset), pa.array(parts, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    numbered = cutup.join(counts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select("doc_id", "start", "length", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"), "ids")
    return numbered.mapInArrow(lay, f"doc_id {cutup.schema[0].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
