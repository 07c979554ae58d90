"""Segmentation: lines of a conversation to message intervals.

``header_segments`` is the fast path for transcripts whose messages all start with one plain header
line: native columns and one window. ``primary_intervals`` follows the full rules, where an
interval may run on over later starts: native columns say what each line is, and one grouped
function per conversation, without any pattern of its own, walks over those flags.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions.names import app_name
from chatframe.functions.text import any_match, trim_u
from chatframe.operators.extract import clean_name, with_author
from chatframe.operators.lines import STAMPS, explode_lines, has_timestamp, line_order, with_features
from chatframe.schema import UNKNOWN_USER
from chatframe.storage import store

#: A header line: a name, then its clock in brackets, with or without a link, or bare.
HEADER = r"^([A-Za-z][A-Za-z0-9 \-_.]*?)\s+(?:\[([^\]]+)\](?:\(https?://[^)]+\))?|(\d{1,2}:\d{2}\s*(?:AM|PM)?))$"


def header_segments(conversations: DataFrame, col: str = "raw") -> DataFrame:
    """(conv_id, msg_idx, username, ts_text, text, start_line, end_line): each line belongs to the
    header above it; what stands above the first header is an unknown user's, if not blank."""
    lines = explode_lines(conversations, col).withColumn("is_start", F.col("trimmed").rlike(HEADER))
    lines = lines.withColumn("msg_no", F.sum(F.col("is_start").cast("int")).over(line_order().rowsBetween(W.unboundedPreceding, 0)))
    rows = lines.groupBy("conv_id", "msg_no").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(F.when(F.col("is_start"), F.col("trimmed"))).alias("header"),
        F.array_sort(F.collect_list(F.when(~F.col("is_start"), F.struct("line_no", "content")))).alias("body"),
    )
    text = trim_u(F.array_join(F.transform("body", lambda x: x["content"]), "\n"))
    clock = F.coalesce(F.nullif(F.regexp_extract("header", HEADER, 2), F.lit("")), F.nullif(F.regexp_extract("header", HEADER, 3), F.lit("")))
    rows = rows.select("conv_id", "msg_no", F.coalesce(F.regexp_extract("header", HEADER, 1), F.lit(UNKNOWN_USER)).alias("username"), clock.alias("ts_text"), text.alias("text"), "start_line", "end_line")
    rows = rows.where("msg_no > 0 or text <> ''")
    index = F.row_number().over(W.partitionBy("conv_id").orderBy("start_line")) - 1
    return rows.select("conv_id", index.cast("int").alias("msg_idx"), "username", "ts_text", "text", "start_line", "end_line")


def with_candidates(features: DataFrame) -> DataFrame:
    """``features`` with ``is_candidate``: a start that is no continuation and doesn't repeat the
    name of the candidate before it within two lines; and with authors and application headers."""
    rows = with_author(features)
    rows = rows.withColumn("_c", F.col("is_start") & ~F.col("is_cont")).withColumn("_clean", clean_name(F.col("trimmed")))
    rows = rows.withColumn("_stamp", any_match(F.col("trimmed"), STAMPS))
    rows = rows.withColumn("_last", F.last(F.when(F.col("_c"), F.struct("line_no", "_clean", "is_name", "_stamp", "is_section", "app_start")), True).over(line_order().rowsBetween(W.unboundedPreceding, -1)))
    plain = lambda c: ~F.col(f"{c}_stamp") & ~F.col(f"{c}is_section") & ~F.col(f"{c}app_start") & F.col(f"{c}is_name")
    again = F.coalesce((F.col("line_no") - F.col("_last.line_no") <= 2) & plain("") & plain("_last.") & (F.col("_clean") == F.col("_last._clean")), F.lit(False))
    app = F.col("is_app") & (F.lead("trimmed", 1).over(line_order()) == app_name(F.col("trimmed"))) & F.lead(F.col("trimmed").rlike(r"(?i)^APP\s+\w+\s+\d+") & F.col("has_ts"), 2).over(line_order())
    return rows.withColumns({"is_candidate": F.col("_c") & ~again, "app_triple": F.coalesce(app, F.lit(False))}).drop("_c", "_clean", "_stamp", "_last")


FLAGS = ["is_empty", "is_start", "is_candidate", "is_cont", "has_ts", "is_name", "is_meta", "user_time", "is_doubled", "app_triple", "could_be_user"]
INTERVAL_COLUMNS = ["conv_id", "line_no", "author", *FLAGS]
INTERVAL = "conv_id bigint, msg_no int, start int, end int, confidence double"
REACH, HEAD = 4, 5


def together(f: dict[str, np.ndarray], a: int, b: int) -> bool:
    """Candidates a < b head the same message."""
    if b - a > 2:
        return False
    if f["app_triple"][a] and b == a + 1 or f["is_name"][a] and f["has_ts"][b]:
        return True
    if f["has_ts"][b] or f["is_name"][b]:
        return False
    return bool(f["is_name"][a] and not f["has_ts"][a] or (f["has_ts"][a] or f["user_time"][a]) and not f["is_meta"][b])


def sureness(n: int, average: float, user: bool, time: bool, content: bool) -> float:
    """How sure an interval of n lines is: by its length, and by a user and a time in its first lines."""
    value = 0.2 if average * 0.2 <= n <= average * 3 else 0.15 if average * 0.1 <= n <= average * 5 else 0.0
    return min(1.0, value + 0.25 * user + 0.25 * time + 0.2 * content)


def join_intervals(starts: np.ndarray, ends: np.ndarray, sure: list[float], strong: np.ndarray, timed: np.ndarray, users: Sequence[str | None], conts: np.ndarray, reach: Callable[[int], int]) -> list[tuple[int, int, float]]:
    """Intervals take in later ones that a continuation reaches or, if they have a time, that carry on
    their author's words. ``conts``: the lines of continuations, in order; ``reach``: how far each goes."""
    within = lambda a, b: conts[slice(*np.searchsorted(conts, (a, b + 1)))].tolist()
    soon = np.array([bool(within(s, min(s + HEAD, e))) for s, e in zip(starts, ends, strict=True)])
    users = np.array([u or "" for u in users])
    used, out = np.zeros(len(starts), bool), []
    for i in range(len(starts)):
        if used[i]:
            continue
        end, value = int(ends[i]), sure[i]
        while True:
            far = max((reach(k) for k in within(max(starts[i], end - HEAD), end)), default=-2)
            joins = (far >= starts - 1) & ~strong
            if timed[i]:
                joins |= soon & ~(timed & (users != "") & (users[i] != "") & (users != users[i]))
            joins &= ~used
            joins[: i + 1] = False
            if not joins.any():
                break
            j = int(joins.argmax())
            end, value, used[j] = max(end, int(ends[j])), max(value, sure[j]), True
        out.append((int(starts[i]), end, value))
    return [x for x in out if x[2] > 0.1]


class Walk:
    """One conversation's flags, and the walks over them."""

    def __init__(self, flags: dict[str, np.ndarray], users: list[str | None]):
        self.f, self.users, self.n = flags, users, len(users)
        self.filled = np.append(np.flatnonzero(~flags["is_empty"]), self.n)
        self.ends: dict[int, int] = {}

    def next_filled(self, i: int) -> int:
        return int(self.filled[np.searchsorted(self.filled, i)])

    def heads(self) -> list[int]:
        candidates, heads, i = np.flatnonzero(self.f["is_candidate"]).tolist(), [], 0
        while i < len(candidates):
            head = candidates[i]
            heads.append(head)
            i += 1
            for other in candidates[i : i + 3]:
                if other - head > 3 or not together(self.f, head, other):
                    break
                i += 1
        return heads

    def reach(self, start: int) -> int:
        """The last line that the continuation at ``start`` takes in."""
        if start not in self.ends:
            f, end = self.f, start
            for i in range(start + 1, self.n):
                if f["is_empty"][i]:
                    after = self.next_filled(i)
                    if after < self.n and after - start > 3 and f["is_start"][after]:
                        break
                elif f["is_meta"][i]:
                    break
                elif i - start <= REACH:
                    if f["user_time"][i] or f["has_ts"][i] and f["is_name"][i]:
                        break
                elif f["is_start"][i]:
                    break
                end = i
            self.ends[start] = end
        return self.ends[start]

    def extended(self, start: int, end: int) -> int:
        for i in (start + np.flatnonzero(self.f["is_cont"][start : end + 1])).tolist():
            end = max(end, self.reach(i))
        while end < self.n - 1:
            after = self.next_filled(end + 1)
            if after >= self.n or not self.f["is_cont"][after]:
                break
            end = self.reach(after)
        return end

    def strong(self, i: int) -> bool:
        """Line i is a header that a continuation doesn't swallow."""
        f = self.f
        named = f["is_name"][i] and (f["has_ts"][i] or i + 1 < self.n and f["has_ts"][i + 1])
        return bool(f["user_time"][i] or named or f["is_doubled"][i])

    def confidence(self, start: int, end: int, average: float) -> float:
        f, head = self.f, slice(start, min(start + 2, end) + 1)
        return sureness(end - start + 1, average, bool(f["could_be_user"][head].any()), bool((f["has_ts"][head] & ~f["is_empty"][head]).any()), bool((~f["is_empty"][start : end + 1] & ~f["is_meta"][start : end + 1]).any()))

    def average(self) -> int:
        """Filled lines from a start to the next, on average."""
        starts = np.flatnonzero(self.f["is_start"])
        if not len(starts):
            return 0
        filled = np.add.reduceat(~self.f["is_empty"], starts).astype(int)
        filled = filled[filled > 0]
        return int(np.floor(filled.mean() + 0.5)) if len(filled) else 0

    def intervals(self) -> list[tuple[int, int, float]]:
        cuts = sorted({0, *self.heads()})
        average = self.average() or 5
        ends = [c - 1 for c in cuts[1:]] + [self.n - 1]
        sure = [self.confidence(s, e, average) for s, e in zip(cuts, ends, strict=True)]
        starts, ends = np.array(cuts), np.array([self.extended(s, e) for s, e in zip(cuts, ends, strict=True)])
        strong = np.array([self.strong(s) for s in starts])
        return join_intervals(starts, ends, sure, strong, self.f["user_time"][starts], [self.users[s] for s in starts], np.flatnonzero(self.f["is_cont"]), self.reach)


def _walk(table: pa.Table) -> pa.Table:
    table = table.sort_by("line_no")
    flags = {c: np.asarray(table[c].to_numpy(), bool) for c in FLAGS}
    found = Walk(flags, table["author"].to_pylist()).intervals()
    kinds = pa.schema([("conv_id", pa.int64()), ("msg_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])
    conv = table["conv_id"][0].as_py()
    return pa.Table.from_pylist([{"conv_id": conv, "msg_no": k, "start": s, "end": e, "confidence": c} for k, (s, e, c) in enumerate(found)], schema=kinds)


def primary_intervals(features: DataFrame) -> DataFrame:
    """(conv_id, msg_no, start, end, confidence) from ``with_candidates``. Intervals can overlap. A
    group is one conversation, which admission bounds. Flags are small beside what a walk over them
    takes, so their partitions are counted, not sized."""
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return features.select(*INTERVAL_COLUMNS).repartition(parts, "conv_id").groupBy("conv_id").applyInArrow(_walk, INTERVAL)


def primary_lines(conversations: DataFrame, col: str = "raw", phrases: Sequence[str] = ()) -> DataFrame:
    return with_candidates(with_features(explode_lines(conversations, col), phrases))


def common_usernames(features: DataFrame) -> DataFrame:
    """(conv_id, username, uses, first_line, rank): names that user-like lines give at least twice; the
    most used one of a conversation ranks first, ties by first use."""
    named = features.where("could_be_user").select("conv_id", "line_no", clean_name(F.coalesce("author", F.when(F.col("is_name"), F.col("trimmed")))).alias("username"))
    valid = (F.length("username").between(2, 50)) & ~F.col("username").rlike(r"(?i)^(?:\d+|(?:mon|tues|wednes|thurs|fri|satur|sun)day|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$|^\d{1,2}:\d{2}")
    return named.where(valid).groupBy("conv_id", "username").agg(F.count("*").alias("uses"), F.min("line_no").alias("first_line")).where("uses >= 2").withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("uses"), "first_line")))


def timestamp_spellings(features: DataFrame) -> DataFrame:
    """(conv_id, spelling, first_line): the distinct ways in which times are written."""
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    shapes = [r"(?i)\d{1,2}:\d{2}(?:\s*[AP]M)?", r"\[([^\]]+)\]\(https?://[^)]+\)", r"(?i)\[\d{1,2}:\d{2}(?:\s*[AP]M)?\]", rf"(?i)(?:{months})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s+at\s+\d{{1,2}}:\d{{2}}(?:\s*[AP]M)?)?",
              r"(?i)(?:Today|Yesterday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)(?:\s+at\s+\d{1,2}:\d{2}(?:\s*[AP]M)?)?"]
    found = F.array(*[F.regexp_extract("trimmed", p, 0) for p in shapes])
    rows = features.where(has_timestamp(F.col("trimmed"))).select("conv_id", "line_no", F.explode(F.filter(found, lambda x: x != "")).alias("spelling"))
    return rows.groupBy("conv_id", "spelling").agg(F.min("line_no").alias("first_line"))


def diagnostics(features: DataFrame) -> DataFrame:
    """(conv_id, starts, stamps, layout, alignment, confidence): whether times are written in brackets
    or plain (one of them in more than seven tenths of the signs, else mixed), the share of starts
    with a time at most two lines away, and how regular all of it is."""
    features = store(features.select("conv_id", "line_no", "trimmed", "author", "has_ts", "is_candidate", "could_be_user", "is_name"), "features")
    order = line_order()
    near = F.max(F.col("has_ts").cast("int")).over(order.rowsBetween(-2, 2)) == 1
    beside = F.coalesce(F.lag("has_ts").over(order) | F.lead("has_ts").over(order), F.lit(False))
    nth = F.sum(F.col("is_candidate").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = features.withColumns({"_near": near, "_beside": beside, "_nth": nth})
    counts = rows.groupBy("conv_id").agg(
        F.count_if("is_candidate").alias("starts"), F.count_if("has_ts").alias("stamps"), F.count_if(F.col("is_candidate") & F.col("_near")).alias("near"),
        F.count_if(F.col("is_candidate") & F.col("_beside") & (F.col("_nth") <= 5)).alias("beside"),
    )
    x = F.col("spelling")
    ways = timestamp_spellings(features).groupBy("conv_id").agg(F.count("*").alias("ways"), F.count_if(x.contains("[") & x.contains("]")).alias("brackets"), F.count_if(x.rlike(r"\d{1,2}:\d{2}") | x.contains("](https://")).alias("plain"))
    named = common_usernames(features).select("conv_id").distinct().withColumn("named", F.lit(1))
    rows = counts.join(ways, "conv_id", "left").join(named, "conv_id", "left").na.fill(0, ["ways", "brackets", "plain", "named"])
    plain, every = F.col("plain") + F.col("beside"), F.col("plain") + F.col("beside") + F.col("brackets")
    layout = F.when(F.col("starts") == 0, "standard").when(every == 0, "mixed").when(F.col("brackets") / every > 0.7, "bracket").when(plain / every > 0.7, "standard").otherwise("mixed")
    alignment = F.when((F.col("starts") > 0) & (F.col("stamps") > 0), F.col("near") / F.col("starts")).otherwise(0.0)
    ratio = F.col("starts") / F.greatest(F.col("stamps"), F.lit(1))
    some = lambda c: (F.col(c) > 0).cast("int")
    value = F.when(F.col("starts") == 0, 0.0).when(ratio.between(0.5, 2.0), 0.2).when(ratio.between(0.1, 3.0), 0.1).otherwise(0.0)
    value = value + F.when(F.col("ways") > 0, 0.2 * F.least(F.lit(1.0), 3 / F.col("ways"))).otherwise(0.0) + 0.2 * some("named") + F.when(layout == "mixed", 0.1).otherwise(0.2) + 0.2 * alignment
    factors = some("starts") + some("ways") + some("named") + 2
    return rows.select("conv_id", "starts", "stamps", layout.alias("layout"), alignment.alias("alignment"), F.least(F.lit(1.0), value / F.greatest(factors * 0.2, F.lit(1.0))).alias("confidence"))


def candidate_scores(features: DataFrame) -> DataFrame:
    """(conv_id, line_no, score) of start candidates: it ranks them, and drops none. What speaks for one:
    a time within two lines, a blank line above, a common name of the conversation in it, a capital, a
    short line, and a distance from the start above of half to twice the average message; metadata
    speaks against it."""
    features = store(features.select("conv_id", "line_no", "trimmed", "author", "is_name", "could_be_user", "is_start", "is_empty", "is_meta", "has_ts", "after_empty", "has_capital", "is_short"), "features")
    order = line_order()
    near = F.coalesce(F.max(F.col("has_ts").cast("int")).over(order.rowsBetween(-2, 2)), F.lit(0))
    nth = F.sum(F.col("is_start").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = features.withColumns({"near": near, "nth": nth})
    per = marked.where("nth > 0").groupBy("conv_id", "nth").agg(F.count_if(~F.col("is_empty")).alias("filled")).where("filled > 0")
    average = per.groupBy("conv_id").agg(F.floor(F.avg("filled") + 0.5).alias("average"))
    names = common_usernames(features).groupBy("conv_id").agg(F.collect_list("username").alias("names"))
    starts = marked.where("is_start").withColumn("gap", F.col("line_no") - F.lag("line_no").over(order)).join(average, "conv_id", "left").join(names, "conv_id", "left")
    known = F.coalesce(F.exists("names", lambda n: F.contains(F.col("trimmed"), n)), F.lit(False))
    spaced = F.coalesce(F.col("gap").between(F.col("average") * 0.5, F.col("average") * 2), F.lit(False))
    signs = ((F.col("near") > 0, 3), (F.col("after_empty"), 2), (known, 2), (F.col("has_capital"), 1), (F.col("is_short") & ~F.col("is_empty"), 1), (F.col("is_meta"), -3), (spaced, 1))
    return starts.select("conv_id", "line_no", sum((sign.cast("int") * worth for sign, worth in signs), F.lit(0)).alias("score"))
