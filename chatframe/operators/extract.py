"""Fields of a message: author, time, text, reactions and thread information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions.names import MONTH3, app_name, extract_name, is_app_message, is_valid_name, normalise_name
from chatframe.functions.text import group, let, trim_u
from chatframe.operators.lines import (
    PICTURE,
    TWICE,
    has_timestamp,
    is_continuation_shape,
    is_doubled_name,
    is_metadata,
    is_thread_info,
    looks_like_name,
)
from chatframe.schema import REACTION, UNKNOWN_USER

MONTHS = f"{MONTH3}|January|February|March|April|June|July|August|September|October|November|December"
CLOCK = r"\d{1,2}:\d{2}(?:\s*[AP]M)?"
#: Roles that stand where a name would (fixed values).
ROLES = ["new hire", "admin", "team lead", "manager", "engineer", "designer", "product manager", "ceo", "cto", "cfo", "intern", "contractor", "senior", "junior",
         "lead", "staff", "principal", "vp", "director", "new member", "guest", "bot"]
REACTION_MARK = rf"({PICTURE}|:\w+:)\s*(\d*)"
UNKNOWN_META = (r"(?i)^Added by\s+|^(?:Language|TypeScript|Last updated|View thread|Thread:|Last reply)$|^\d+\s*(?:minutes?|hours?|days?)\s*ago$|^!\[\]\(https?://[^)]+\)$|"
                r"^[a-zA-Z0-9\-_]+/[a-zA-Z0-9\-_]+$|^\d+\s+(?:reply|replies|files?)$")  # fmt: skip


def timestamp_of(t: Column) -> Column:
    """The time in a line: a link's label, the clock of a date, the date, any clock."""
    return F.coalesce(
        group(t, r"\[([^\]]+)\]\(https?://[^)]+\)"),
        group(t, rf"(?i)(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?\s+at\s+({CLOCK})"),
        group(t, rf"(?i)((?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?)"),
        group(t, rf"(?i)({CLOCK})"),
    )


def clean_name(t: Column) -> Column:
    """A name line as a name: the application's, or undoubled, without signs names don't have."""
    once = F.coalesce(group(t, TWICE[0]), group(t, TWICE[1]), t)
    return F.coalesce(trim_u(group(t, r"^\s*\(https?://[^)]+\)([A-Za-z][A-Za-z0-9\s\-_.]*)")), trim_u(F.regexp_replace(once, r"[^\w\s\-_.()]", "")))


def _clocked(c: Column) -> Column:
    return c.contains("AM") | c.contains("PM") | c.rlike(r"\d{1,2}:\d{2}") | has_timestamp(c)


def with_author(lines: DataFrame, col: str = "trimmed") -> DataFrame:
    """``lines`` with ``author`` and ``author_ts``: what a line alone tells. The forms are tried in
    order: application, role with clock (a time, no author), name before a bracketed time, name
    before a clock, doubled name before a time, plain name, name before APP, name before any time."""
    t = F.col(col)
    doubled = r"^([A-Za-z][A-Za-z0-9\s\-_.]*?)\1(?:!\[:[^\]]+:\][^\[]*)\s*\[([^\]]+)\]"
    bracket = r"^([A-Za-z][A-Za-z0-9\s\-_.]*?)\s*\[([^\]]+)\]"
    clock = rf"(?i)^([A-Za-z0-9\s\-_.]+?)\s+({CLOCK})"
    tag = rf"(?i)^([A-Za-z][A-Za-z\s🌟🔧]+?)\s+({CLOCK})"
    twice = r"^([A-Za-z][A-Za-z0-9\s\-_.]{2,30})\s*\1\s+(.+)$"
    app_mark = r"^([A-Za-z][A-Za-z0-9\s\-_.]*?)(?:\s+APP\s+(.+))?$"
    loose = r"^([A-Za-z][A-Za-z0-9\s\-_.]{1,25})\s+(.+)$"
    dated = rf"(?i)\b(?:{MONTHS})\b.*\b(?:at|on)\s*$|\d+(?:st|nd|rd|th).*\bat\s*$|^.*(?:today|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday).*at\s*$"
    rows = lines.withColumns(
        {
            "_app": F.when(is_app_message(t), app_name(t)), "_two": F.when(t.rlike(doubled), extract_name(group(t, doubled), "thread")),
            "_bra": F.when(t.rlike(bracket), extract_name(group(t, bracket), "thread")), "_tag": trim_u(group(t, tag)), "_clk": group(t, clock), "_twi": group(t, twice),
            "_mar": trim_u(group(t, app_mark)), "_loo": trim_u(group(t, loose)), "_rest": trim_u(group(t, loose, 2)), "_twr": trim_u(group(t, twice, 2)),
            "_name": F.col("is_name") if "is_name" in lines.columns else looks_like_name(t), "_ts": F.col("has_ts") if "has_ts" in lines.columns else has_timestamp(t),
        }
    )
    c = F.col
    role = ~t.rlike(r"(?i)^APP\s+\w+\s+\d+") & (F.lower("_tag").isin(ROLES) | ((F.length("_tag") < 3) & (F.lower("_tag") != "app")) | (F.size(F.split("_tag", " ")) > 2))
    by_clock = ~c("_clk").rlike(dated) & ~c("_clk").rlike(r"(?i)\b(?:at|on|today|yesterday|am|pm)\b") & (F.length("_clk") <= 30) & looks_like_name(c("_clk"))
    plain = t.rlike(r"^[A-Za-z][A-Za-z0-9\s\-_.]*$") & F.length(t).between(2, 30) & c("_name") & ~c("_ts") & ~t.contains("http")
    marked = looks_like_name(c("_mar")) & F.length("_mar").between(2, 25) & ~c("_mar").rlike("[.,?!]") & ~c("_mar").rlike(r"(?i)\b(?:the|and|but|for|with|this|that|what|when|where|how|why|can|will|would|should|could|might|may)\b")
    cases = [
        (c("_app").isNotNull() & is_valid_name(c("_app")), normalise_name(c("_app")), timestamp_of(t)),
        (role, F.lit(None), F.lit(None)),
        (c("_two").isNotNull() & is_valid_name(c("_two")), normalise_name(c("_two")), group(t, doubled, 2)),
        (c("_bra").isNotNull() & is_valid_name(c("_bra")), normalise_name(c("_bra")), group(t, bracket, 2)),
        (by_clock, clean_name(c("_clk")), group(t, clock, 2)),
        (c("_twi").isNotNull() & _clocked(c("_twr")) & looks_like_name(c("_twi")), clean_name(c("_twi")), c("_twr")),
        (plain, clean_name(t), F.lit(None)),
        (marked, clean_name(c("_mar")), trim_u(group(t, app_mark, 2))),
        (F.length("_loo").between(2, 25) & _clocked(c("_rest")) & looks_like_name(c("_loo")), clean_name(c("_loo")), c("_rest")),
    ]
    found = F.lit(None).cast("struct<author:string,time:string>")  # one chain, so that no case is tried twice
    for when, a, b in reversed(cases):
        found = F.when(F.coalesce(when, F.lit(False)), F.struct(a.cast("string").alias("author"), b.cast("string").alias("time"))).otherwise(found)
    rows = rows.withColumn("_found", found).withColumns({"author": c("_found.author"), "author_ts": c("_found.time")})
    return rows.drop(*[x for x in rows.columns if x in ("_found", "_app", "_two", "_bra", "_tag", "_clk", "_twi", "_mar", "_loo", "_rest", "_twr", "_name", "_ts")])


def single_reaction(t: Column) -> Column:
    """An emoji and its count on a line: one (name, count), or null."""
    pattern = rf"^({PICTURE}|:\w+:)\s*(\d+)$"
    return F.when(t.rlike(pattern), F.struct(F.replace(F.regexp_extract(t, pattern, 1), F.lit(":"), F.lit("")).alias("name"), F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), F.lit(1)).cast("int").alias("count")))


def many_reactions(t: Column) -> Column:
    """Reactions run together on a line; without a count they have 1, but count from the first one
    with a count on. A lone picture is one reaction. Lines that start with a letter have none."""
    names = F.transform(F.regexp_extract_all(t, F.lit(REACTION_MARK), F.lit(1)), lambda x: F.replace(x, F.lit(":"), F.lit("")))
    counts = F.regexp_extract_all(t, F.lit(REACTION_MARK), F.lit(2))
    first = F.array_position(F.transform(counts, lambda x: x != ""), True)
    every = F.arrays_zip(names.alias("name"), counts.alias("count"))
    kept = F.transform(F.filter(every, lambda x, i: (first > 0) & (i >= first - 1)), lambda x: F.struct(x["name"].alias("name"), F.when(x["count"] == "", 1).otherwise(x["count"].try_cast("int")).alias("count")))
    lone = F.array(F.struct(t.alias("name"), F.lit(1).alias("count")))
    none = F.array().cast(f"array<{REACTION}>")
    return F.when(t.rlike("^[A-Za-z]"), none).when(F.size(kept) > 0, kept.cast(f"array<{REACTION}>")).when(t.rlike(rf"^{PICTURE}$"), lone.cast(f"array<{REACTION}>")).otherwise(none)


def clean_content(c: Column) -> Column:
    """Without leading blank and doubled-name lines; runs of blank lines become one."""
    lines = F.split(c, "\n", -1)
    start = F.array_position(F.transform(lines, lambda x: (trim_u(x) != "") & ~is_doubled_name(trim_u(x))), True)
    body = F.when(start > 0, F.array_join(F.slice(lines, start.cast("int"), F.size(lines)), "\n")).otherwise("")
    return F.regexp_replace(trim_u(body), "\n{3,}", "\n\n")


def split_content(lines: Column) -> Column:
    """A struct (text, reactions, thread_info) of a message's content lines (array<string>)."""
    return let(F.transform(lines, trim_u), lambda t: let(_line_kinds(t), lambda kinds: _by_kind(lines, t, kinds)))


def _line_kinds(t: Column) -> Column:
    """What each trimmed line is: text, skip, reaction, pair (a reaction's name before its count), thread."""

    def kind(x: Column, i: Column) -> Column:
        counted = F.coalesce(F.get(t, i + 1).rlike(r"^\d+$"), F.lit(False))
        marked = x.rlike(REACTION_MARK) & (single_reaction(x).isNotNull() | (F.size(many_reactions(x)) > 0))
        return (
            F.when(x == "", "text").when((i == 0) & is_doubled_name(x), "skip").when(is_metadata(x), "skip")
            .when(is_continuation_shape(x), "text").when(marked, "reaction")
            .when(x.rlike(r"^:[a-zA-Z0-9_-]+:$") & counted, "pair").when(is_thread_info(x), "thread").otherwise("text")
        )

    return F.transform(t, kind)


def _by_kind(lines: Column, t: Column, kinds: Column) -> Column:
    marks = lambda x, i: F.when(F.get(kinds, i) == "pair", F.array(F.struct(F.replace(x, F.lit(":"), F.lit("")).alias("name"), F.get(t, i + 1).try_cast("int").alias("count")))).when(F.get(kinds, i) == "reaction", F.when(single_reaction(x).isNotNull(), F.array(single_reaction(x))).otherwise(many_reactions(x))).otherwise(F.array().cast(f"array<{REACTION}>")).cast(f"array<{REACTION}>")
    text = trim_u(F.array_join(F.filter(lines, lambda x, i: F.get(kinds, i) == "text"), "\n"))
    thread = F.try_element_at(F.filter(t, lambda x, i: F.get(kinds, i) == "thread"), F.lit(-1))
    return F.struct(clean_content(text).alias("text"), F.flatten(F.transform(t, marks)).alias("reactions"), thread.alias("thread_info"))


LINE_COLUMNS = ["conv_id", "line_no", "content", "trimmed", "author", "author_ts", "is_name", "has_ts", "is_section", "is_app"]


def extract_messages(lines: DataFrame, intervals: DataFrame) -> DataFrame:
    """Messages of ``intervals`` over the lines of ``with_candidates``: (conv_id, msg_idx, username,
    ts_text, text, thread_info, reactions, start_line, end_line)."""
    of = intervals.select(F.col("conv_id").alias("c"), "msg_no", "start", "end")
    cells = lines.select(*LINE_COLUMNS)
    rows = cells.join(of, (F.col("conv_id") == F.col("c")) & F.col("line_no").between(F.col("start"), F.col("end")))
    rows = rows.groupBy("conv_id", "msg_no", "start", "end").agg(F.array_sort(F.collect_list(F.struct("line_no", "content", "trimmed", "author", "author_ts", "is_name", "has_ts", "is_section", "is_app"))).alias("ls"))
    ls, get = F.col("ls"), lambda i, f: F.get("ls", i)[f]
    head = F.slice(ls, 1, 5)
    at = lambda p: F.array_position(F.transform(head, lambda x: F.coalesce((x["trimmed"] != "") & p(x), F.lit(False))), True).cast("int") - 1
    rows = rows.withColumns({"_u": at(lambda x: x["author"].isNotNull() | x["is_name"]), "_t": at(lambda x: x["has_ts"]), "_section": F.coalesce(get(F.lit(0), "is_section"), F.lit(False))})
    app = get(F.lit(0), "is_app") & get(F.lit(2), "trimmed").startswith("APP ") & (get(F.lit(1), "trimmed") == app_name(get(F.lit(0), "trimmed")))
    rows = rows.withColumn("_app", F.coalesce(app, F.lit(False)))
    own = F.when(F.col("_u") >= 0, F.coalesce(get(F.col("_u"), "author"), clean_name(get(F.col("_u"), "trimmed"))))
    by_author = (F.col("_u") >= 0) & get(F.col("_u"), "author_ts").isNotNull() & ((F.col("_t") < 0) | (F.col("_u") <= F.col("_t")))
    time = F.when(by_author, get(F.col("_u"), "author_ts")).when(F.col("_t") >= 0, F.coalesce(timestamp_of(get(F.col("_t"), "trimmed")), get(F.col("_t"), "trimmed")))
    last = F.greatest(F.when(by_author, F.col("_u")).otherwise(F.col("_t")), F.col("_u"))
    rows = rows.withColumns(
        {
            "own": F.when(F.col("_app"), app_name(get(F.lit(0), "trimmed"))).otherwise(own),
            "ts_text": F.when(F.col("_app"), group(get(F.lit(2), "trimmed"), r"APP\s+(.+)")).otherwise(time),
            "_from": F.when(F.col("_section"), 0).when(F.col("_app"), 3).otherwise(F.greatest(last + 1, F.lit(0))),
        }
    )
    body = F.slice(F.transform("ls", lambda x: x["content"]), F.col("_from") + 1, F.greatest(F.size("ls") - F.col("_from"), F.lit(0)))
    rows = rows.withColumn("_c", split_content(body)).select("conv_id", "msg_no", "start", "end", "own", "ts_text", "_section", "_c.text", "_c.reactions", "_c.thread_info")
    before = W.partitionBy("conv_id").orderBy("msg_no").rowsBetween(W.unboundedPreceding, -1)
    known = F.last(F.when(~F.col("_section") & F.col("own").isNotNull() & (F.col("own") != UNKNOWN_USER) & (F.col("text") != ""), F.col("own")), True).over(before)
    rows = rows.withColumn("username", F.coalesce(F.when(F.col("_section"), known), "own", F.lit(UNKNOWN_USER)))
    rows = rows.where(accept(F.col("username"), F.col("text")))
    index = F.row_number().over(W.partitionBy("conv_id").orderBy("msg_no")) - 1
    return rows.select("conv_id", index.cast("int").alias("msg_idx"), "username", "ts_text", "text", "thread_info", "reactions", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def accept(username: Column, text: Column) -> Column:
    """A message is kept if it has text; an unknown user's needs more than 20 characters, and more
    than metadata or plain words."""
    unknown = (F.length(text) > 20) & ~text.rlike(UNKNOWN_META) & ~text.rlike(r"^[A-Za-z0-9\s\-_.]+$")
    return F.when(username == UNKNOWN_USER, unknown).otherwise(text != "")
