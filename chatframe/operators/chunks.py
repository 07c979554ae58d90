"""One conversation over many tasks: lines by chunks, and walks as functions of chunks that compose.

A conversation's text is cut at line ends into chunks. A chunk carries the lines around it that its own
lines' features look at, so features need no other chunk, and chunks are dealt out over the cluster. The
walk that finds messages is split likewise. For each chunk a function is made of how the walk leaves it
for every way of entering it:

* heads: a start candidate belongs to a head at most three lines above it, so a chunk is entered with no
  head in reach or with one that is one, two or three lines up;
* reach of a continuation: after its first lines it goes on to the next line that ends it, so a chunk is
  entered at one of its first lines, and either holds that end or is passed through.

What meets per conversation is one row of numbers for each chunk: these functions, composed in order (and
backwards for the reach), give the heads and reaches, and intervals join as in ``segment``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.functions.text import lines_of, trim_u
from chatframe.operators.lines import explode_lines, is_section, with_features
from chatframe.operators.segment import FLAGS, INTERVAL, REACH, join_intervals, sureness, together, with_candidates

#: Characters of a chunk; a longer line is a chunk of its own.
CHUNK = 100 * 1024
#: Lines before a chunk that its features look at, and how far back a head can be.
BEFORE, NEAR = 8, 3
#: Lines behind a chunk that its walk looks at, and those that these lines' features look at.
AHEAD, BEYOND = REACH + 2, 3
#: A line that is content and nothing else: it stands for content above the lines before a chunk.
CONTENT = "x,"
KEY = "struct<conv:bigint,chunk:int,first:int,lead:int,n:int,ahead:int,total:int>"


def _cut(lines: list[str], size: int) -> Iterator[tuple[int, int]]:
    first, chars = 0, 0
    for i, line in enumerate(lines):
        if i > first and chars + len(line) + 1 > size:
            yield first, i
            first, chars = i, 0
        chars += len(line) + 1
    yield first, len(lines)


def chunked(conversations: DataFrame, size: int = CHUNK, col: str = "raw") -> DataFrame:
    """(conv_id, raw): one row for each chunk, with the lines around it; ``conv_id`` is a struct that says
    which lines are its own: ``n`` from the ``lead``-th of the text on, ``first`` in the conversation."""
    text = F.coalesce(F.col(col), F.lit(""))
    filled = F.transform(lines_of(text), lambda x: (trim_u(x) != "") & ~is_section(trim_u(x)))
    rows = conversations.select("conv_id", text.alias("raw"), F.array_position(filled, True).cast("int").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.struct([(k, pa.int64() if k == "conv" else pa.int32()) for k in ("conv", "chunk", "first", "lead", "n", "ahead", "total")])), ("raw", pa.string())])
        for batch in batches:
            for conv, raw, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "raw", "content")), strict=True):
                lines, out = raw.split("\n"), []
                for k, (first, end) in enumerate(_cut(lines, size)):
                    start, stop = max(0, first - BEFORE), min(len(lines), end + AHEAD)
                    while stop < len(lines) and not lines[stop - 1].strip():
                        stop += 1
                    mark = [CONTENT] if 0 < content <= start else []
                    shown = [*mark, *lines[start : stop + BEYOND]]
                    key = {"conv": conv, "chunk": k, "first": first, "lead": first - start + len(mark), "n": end - first, "ahead": stop - end, "total": len(lines)}
                    out.append({"conv_id": key, "raw": "\n".join(shown)})
                yield from pa.Table.from_pylist(out, schema=kind).to_batches()

    return rows.mapInArrow(run, f"conv_id {KEY}, raw string")


def chunked_features(conversations: DataFrame, size: int = CHUNK, phrases: Sequence[str] = (), col: str = "raw") -> DataFrame:
    """Lines of chunks as ``segment.primary_lines`` has them of conversations, with those around them that
    the walk looks at. Chunks are dealt out before their lines are looked at."""
    dealt = chunked(conversations, size, col).repartition("conv_id")
    rows = with_candidates(with_features(explode_lines(dealt), phrases))
    at = F.col("line_no") - F.col("conv_id.lead")
    return rows.where(at.between(-NEAR, F.col("conv_id.n") + F.col("conv_id.ahead") - 1)).withColumn("line_no", at + F.col("conv_id.first"))


def own_lines(features: DataFrame) -> DataFrame:
    """The conversations' lines: those of chunks without the ones around them."""
    own = F.col("line_no").between(F.col("conv_id.first"), F.col("conv_id.first") + F.col("conv_id.n") - 1)
    return features.where(own).withColumn("conv_id", F.col("conv_id.conv"))


class Chunk:
    """Flags of a chunk's lines and those around it, from line ``base`` of its conversation on."""

    def __init__(self, flags: dict[str, np.ndarray], base: int, first: int, n: int, total: int) -> None:
        self.f, self.base, self.total, self.own, self.end = flags, base, total, first - base, first - base + n
        self.filled = np.flatnonzero(~flags["is_empty"]).tolist()

    def next_filled(self, i: int) -> int | None:
        k = bisect_left(self.filled, i)
        return self.filled[k] if k < len(self.filled) else None

    def goes_on(self, i: int) -> int:
        """The conversation's line of the next filled line from i on if it is a continuation, else -1."""
        j = self.next_filled(i)
        return self.base + j if j is not None and self.f["is_cont"][j] else -1

    def ends(self, i: int, start: int | None) -> bool:
        """Line i ends what the continuation at ``start`` takes in; None: one that is far above."""
        f = self.f
        if f["is_empty"][i]:
            j = self.next_filled(i)
            return j is not None and (start is None or j - start > 3) and bool(f["is_start"][j])
        if f["is_meta"][i]:
            return True
        if start is None:
            return bool(f["is_start"][i])
        return bool(f["user_time"][i] or f["has_ts"][i] and f["is_name"][i])

    def entered(self) -> list[tuple[int, int]]:
        """For a walk that enters at the k-th own line: the line that ends it and where it goes on from
        there, or (-1, -1) if it passes through."""
        late = [i for i in range(self.own, self.end) if self.ends(i, None)]
        found = []
        for k in range(REACH + 1):
            at = bisect_left(late, self.own + k)
            found.append((self.base + late[at], self.goes_on(late[at])) if at < len(late) else (-1, -1))
        self.late = late
        return found

    def reaches(self) -> Iterator[tuple[int, int, int, int]]:
        """(line, reach, where it goes on, -1) of continuations; with reach -1 it leaves the chunk, to enter
        the next one at the line that comes last."""
        last = self.total - self.base
        for i in (self.own + np.flatnonzero(self.f["is_cont"][self.own : self.end])).tolist():
            stop = next((k for k in range(i + 1, min(i + REACH + 1, last)) if self.ends(k, i)), None)
            if stop is None:
                at = bisect_left(self.late, i + REACH + 1)
                stop = self.late[at] if at < len(self.late) else None
            if stop is not None:
                yield self.base + i, self.base + stop - 1, self.goes_on(stop), -1
            elif i + REACH + 1 >= last or self.end >= last:
                yield self.base + i, self.total - 1, -1, -1
            else:
                yield self.base + i, -1, -1, max(0, i + REACH + 1 - self.end)

    def heads(self) -> list[list[int]]:
        """For a chunk that is entered with no head in reach, or one 1, 2 or 3 lines up: its heads."""
        candidates = (self.own + np.flatnonzero(self.f["is_candidate"][self.own : self.end])).tolist()
        found = []
        for up in range(NEAR + 1):
            head, heads = self.own - up if up else None, []
            for i in candidates:
                if head is None or i - head > NEAR or head < 0 or not together(self.f, head, i):
                    head = i
                    heads.append(self.base + i)
            found.append(heads)
        return found

    def facts(self) -> list[tuple[int, ...]]:
        """What intervals need of each line that can be a head: (line, strong, timed, users, times, content
        before it): users and times are bits of its first three lines."""
        f, n = self.f, len(self.f["is_empty"])
        content = np.concatenate([[0], np.cumsum((~f["is_empty"] & ~f["is_meta"])[self.own : self.end])])
        lines = {self.own} if self.base + self.own == 0 else set()
        out = []
        for i in sorted(lines | set((self.own + np.flatnonzero(f["is_candidate"][self.own : self.end])).tolist())):
            named = f["is_name"][i] and (f["has_ts"][i] or i + 1 < n and f["has_ts"][i + 1])
            bits = [sum(1 << k for k in range(3) if i + k < n and x[i + k]) for x in (f["could_be_user"], f["has_ts"] & ~f["is_empty"])]
            out.append((self.base + i, int(f["user_time"][i] or named or f["is_doubled"][i]), int(f["user_time"][i]), *bits, int(content[i - self.own])))
        return out


SUMMARY = "conv_id bigint, chunk int, total int, first int, n int, heads array<array<int>>, entered array<array<int>>, reaches array<array<int>>, facts array<array<int>>, authors array<string>, starts int, filled int, after_start int, content int"


def _summarise(table: pa.Table) -> pa.Table:
    table = table.sort_by("line_no")
    key = table["conv_id"][0].as_py()
    flags = {c: np.asarray(table[c].to_numpy(), bool) for c in FLAGS}
    chunk = Chunk(flags, table["line_no"][0].as_py(), key["first"], key["n"], key["total"])
    entered, own = chunk.entered(), slice(chunk.own, chunk.end)
    filled, starts, facts = ~flags["is_empty"][own], np.flatnonzero(flags["is_start"][own]), chunk.facts()
    authors = table["author"].to_pylist()
    row = {
        "conv_id": key["conv"], "chunk": key["chunk"], "total": key["total"], "first": key["first"], "n": key["n"], "heads": chunk.heads(), "entered": [list(x) for x in entered], "reaches": [list(x) for x in chunk.reaches()], "facts": [list(x) for x in facts],
        "authors": [authors[x[0] - chunk.base] for x in facts], "starts": len(starts), "filled": int(filled.sum()), "after_start": int(filled[starts[0] :].sum()) if len(starts) else 0, "content": int((filled & ~flags["is_meta"][own]).sum()),
    }
    lists = pa.list_(pa.list_(pa.int32()))
    kinds = [pa.int64(), *[pa.int32()] * 4, lists, lists, lists, lists, pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))


def compose(chunks: list[dict]) -> list[tuple[int, int, float]]:
    """(start, end, confidence) of a conversation's intervals by the functions of its chunks, in order."""
    total, heads, up, facts, users, content = chunks[0]["total"], [], 0, [], [], 0
    for c in chunks:
        heads += c["heads"][up]
        gone = c["first"] + c["n"] - heads[-1] if heads else NEAR + 1
        up = gone if gone <= NEAR else 0
        facts += [(*x[:5], content + x[5]) for x in c["facts"]]
        users += c["authors"]
        content += c["content"]
    enter = [(total, -1)] * (REACH + 1)  # what a walk that enters at the k-th line from here on meets
    reach: dict[int, tuple[int, int]] = {}
    for c in reversed(chunks):
        for line, to, on, at in c["reaches"]:
            reach[line] = (to, on) if to >= 0 else (enter[at][0] - 1, enter[at][1])
        enter = [tuple(x) if x[0] >= 0 else enter[max(0, k - c["n"])] for k, x in enumerate(c["entered"])]
    starts, after = sum(c["starts"] for c in chunks), 0
    for c in chunks:
        after += c["filled"] if after else c["after_start"]
    average = int(np.floor(after / starts + 0.5)) if starts else 0
    known = {x[0]: (*x[1:], u) for x, u in zip(facts, users, strict=True)}
    cuts = sorted({0, *heads})
    stops = [c - 1 for c in cuts[1:]] + [total - 1]
    conts = np.array(sorted(reach), np.int64)

    def extended(start: int, end: int) -> int:
        on = -1
        for line in conts[slice(*np.searchsorted(conts, (start, end + 1)))].tolist():
            if reach[line][0] > end:
                end, on = reach[line]
        while on >= 0 and end < total - 1:
            end, on = reach[on]
        return end

    sure = []
    for k, (s, e) in enumerate(zip(cuts, stops, strict=True)):
        bits = (1 << min(3, e - s + 1)) - 1
        upto = known[cuts[k + 1]][4] if k + 1 < len(cuts) else content
        sure.append(sureness(e - s + 1, average or 5, bool(known[s][2] & bits), bool(known[s][3] & bits), upto > known[s][4]))
    return join_intervals(np.array(cuts), np.array([extended(s, e) for s, e in zip(cuts, stops, strict=True)]), sure, np.array([bool(known[s][0]) for s in cuts]), np.array([bool(known[s][1]) for s in cuts]), [known[s][5] for s in cuts], conts, lambda i: reach[i][0])


def _compose(table: pa.Table) -> pa.Table:
    chunks = sorted(table.to_pylist(), key=lambda c: c["chunk"])
    found = compose(chunks)
    kinds = pa.schema([("conv_id", pa.int64()), ("msg_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])
    return pa.Table.from_pylist([{"conv_id": chunks[0]["conv_id"], "msg_no": k, "start": s, "end": e, "confidence": c} for k, (s, e, c) in enumerate(found)], schema=kinds)


def chunked_intervals(features: DataFrame) -> DataFrame:
    """What ``segment.primary_intervals`` gives, from ``chunked_features``: a task sees a chunk, and then
    one row of numbers for each chunk of a conversation."""
    summaries = features.select("conv_id", "line_no", "author", *FLAGS).groupBy("conv_id").applyInArrow(_summarise, SUMMARY)
    return summaries.groupBy("conv_id").applyInArrow(_compose, INTERVAL)
