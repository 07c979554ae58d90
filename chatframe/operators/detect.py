"""Admission and format classification of conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.text import any_match, let, lines_of, trim_u, unlines

MAX_CHARS, MAX_LINES, WARN_CHARS, WARN_LINES, SCANNED = 5 * 1024 * 1024, 50_000, 1024 * 1024, 10_000, 60

#: Signs of pasted chat, of which two make a text likely (fixed values).
GATE = [r":[\w+-]+:", r"(?i)\d{1,2}:\d{2}\s*(?:AM|PM)", r"<@U[A-Z0-9]+>", r"(?i)View thread", r"(?i)\d+\s+repl(?:y|ies)",
        r"(?im)^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)", r"(?i)uploaded a file:", r"(?i)joined the channel"]
#: Line patterns of each layout (fixed values). They are tried on single trimmed lines.
LAYOUTS = {
    "standard": [r"^[A-Za-z0-9\s\-_.]+\s+\d{1,2}:\d{2}\s*(?:AM|PM)?$", r"^[A-Za-z0-9\s\-_.]+\s+\[.+\]\(.+\)$", r"^\d{1,2}:\d{2}\s*(?:AM|PM)?$",
                 r"^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)", r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}"],
    "bracket": [r"^\[Message from .+\]", r"^\[Time: .+\]", r"^>\s*\[Message from", r"\[Thread:.+\]", r"\[Channel:.+\]"],
    "mixed": [r":([\\w+-]+):", r"<@U[A-Z0-9]+>", r"View thread", r"\d+\s+repl(?:y|ies)", r"https?://"],
    "dm": [r"^\[\d{1,2}:\d{2}\]\(https://.*/archives/D[A-Z0-9]+/p\d+\)$", r"/archives/D[A-Z0-9]+/", r"!\[\]\(https://ca\.slack-edge\.com/E[A-Z0-9]+-U[A-Z0-9]+-[a-f0-9]+-48\)",
           r"^[A-Za-z\s]{3,}+(?<=\s)\[\d{1,2}:\d{2}\s*(?:AM|PM)?\]\(https://.*/archives/[CD][A-Z0-9]+/p\d+\)\s*$", r"^[A-Za-z\s]{21,}+(?<=\s)\[\d{1,2}:\d{2}",
           r"\[@\w+\]\(https://.*/team/U[A-Z0-9]+\)", r"^([A-Za-z\s\x{00C0}-\x{017F}]+)\1\s+\[\d{1,2}:\d{2}\s*(?:AM|PM)?\]\(https://.*/archives/[CD][A-Z0-9]+/p\d+\)",
           r"^([A-Za-z]+)\1([A-Za-z\s]+)\2\s+\[\d{1,2}:\d{2}"],
    "thread": [r"thread_ts=", r"^!\[\]\(https://ca\.slack-edge\.com/", r"\d+\s+replies", r"^---$", r"!\[:[\w-]+:\]\(.*?\)\s+\[.+\]\(.+\)",
               r"\[(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday).*?\]\(.*?thread_ts="],
    "channel": [r"/archives/C[A-Z0-9]+/", r"joined the channel", r"set the channel", r"Channel:", r"pinned a message to this channel", r"shared a file:.*to this channel",
                r"^#[a-z0-9-]+", r"^---\s+[A-Za-z]", r"\[@\w+\]\([^)]+\)(?:\s+\[@\w+\]\([^)]+\)){2,}"],
    "sure": [r"^\d{1,2}:\d{2}\s*(?:AM|PM)?$", r"^[A-Za-z0-9\s\-_.]+$", r"--- .+ ---"],
}
SCORES = ["standard", "bracket", "mixed", "dm", "thread", "channel"]
#: Whole-text signs that settle direct message against channel (fixed values).
AVATARS = r"!\[\]\(https://ca\.slack-edge\.com/E[A-Z0-9]+-U[A-Z0-9]+-[a-f0-9]+-48\)"
#: A doubled name before a clock in brackets, in a text read backwards: from the bracket only the run of
#: letters and blanks before it is tried, so runs are looked through once.
LETTER = r"A-Za-z\x{00C0}-\x{017F}"
WORDS = rf"\s*+[{LETTER}][{LETTER}\s]*?"
DOUBLED = rf"\d{{2}}:\d{{1,2}}\[(?:\s+?(\s+?)\1|\s+({WORDS})\2)"
#: The same from a line's beginning, before a clock with a link to an archive, which ``MARK`` stands for.
MARK = "\x01"
DOUBLED_HEADER = rf"(?m){MARK}(?:(\s)\1{{2,}}|(?=\s*$)\s+?(\s+?)\2|\s+({WORDS})\3)$"
CLOCK_LINK, ARCHIVE = r"\[\d{1,2}:\d{2}\s*(?:AM|PM)?\]\(https://", r"/archives/[CD][A-Z0-9]+/p\d+\)"
AVATAR_THEN_NAME = r"!\[\]\(https://ca\.slack-edge\.com/[^)]++\)[^\S\n]*+\n[A-Za-z\s]{3,}+(?<=\s)\["
TEAM_LINKS = r"\[@\w+\]\(https://.*/team/U[A-Z0-9]+\)"
CHANNEL_WORDS = r"(?i)joined the channel|set the channel|pinned a message to this channel|#[a-z0-9-]+\s+channel"
STRONG_CHANNEL = r"(?m)joined the channel|set the channel|pinned a message to this channel|shared a file:.*to this channel|^#[a-z0-9-]+"
CHANNEL_LAYOUT = r"(?m)^---\s+[A-Za-z]|\[@\w+\]\([^)]+\)(?:\s+\[@\w+\]\([^)]+\)){2,}"


def admission_error(c: Column) -> Column:
    """Why a text is refused (null: it isn't): too many characters, or too many lines."""
    n, lines = F.length(c), F.size(lines_of(c))
    size = F.format_string(f"❌ **Input too large**: %.2fMB exceeds maximum limit of {MAX_CHARS / 2**20:.2f}MB.\n\nPlease break the content into smaller chunks or reduce the text size.", n / float(2**20))
    many = F.format_string(f"❌ **Too many lines**: %d lines exceeds maximum limit of {MAX_LINES}.\n\nPlease reduce the content or split into smaller sections.", lines)
    return F.when(n > MAX_CHARS, size).when(lines > MAX_LINES, many)


def admission_warning(c: Column) -> Column:
    return F.when(F.length(c) > WARN_CHARS, "large input").when(F.size(lines_of(c)) > WARN_LINES, "many lines")


def is_likely_chat(c: Column) -> Column:
    """Two or more of the signs of pasted chat."""
    return F.coalesce(sum((c.rlike(p).cast("int") for p in GATE), F.lit(0)) >= 2, F.lit(False))


def route(c: Column, hotkey_mode: str = "cmdShiftV", confirmed: Column | None = None) -> Column:
    """format or passthrough: the dedicated key always formats; an intercepted paste does if it is
    likely chat and, where asked, confirmed."""
    if hotkey_mode != "interceptCmdV":
        return F.lit("format")
    fine = is_likely_chat(c) if confirmed is None else is_likely_chat(c) & confirmed
    return F.when(fine, "format").otherwise("passthrough")


def has_doubled_name(c: Column) -> Column:
    return F.reverse(c).rlike(DOUBLED)


def has_doubled_header(c: Column) -> Column:
    """In each line a clock's link counts up to the line's last link to an archive."""

    def marked(x: Column) -> Column:
        upto = F.regexp_extract(x, f"^(.*){ARCHIVE}", 1)
        return F.when(x.rlike(ARCHIVE), F.regexp_replace(upto, CLOCK_LINK, MARK)).otherwise(x)

    text = let(lines_of(F.replace(c, F.lit(MARK), F.lit(""))), lambda ls: F.reverse(unlines(F.transform(ls, marked))))
    return F.when(c.rlike(r"/archives/[CD]") & c.rlike(r"\s\[\d{1,2}:\d{2}"), text.rlike(DOUBLED_HEADER))


def hits(c: Column) -> dict[str, Column]:
    """For each layout the lines, of the first ``SCANNED`` that aren't blank, that show it; and how
    many lines there are."""
    lines = F.filter(F.transform(F.slice(lines_of(c), 1, SCANNED), trim_u), lambda x: x != "")
    doubled = [p for p in LAYOUTS["dm"] if "\\1" in p]  # these need a clock in brackets, which is looked for first

    def shows(patterns: list[str]) -> Callable[[Column], Column]:
        plain, twice = [p for p in patterns if p not in doubled], [p for p in patterns if p in doubled]
        return lambda x: any_match(x, plain) | (x.rlike(r"\s\[\d{1,2}:\d{2}") & any_match(x, twice)) if twice else any_match(x, plain)

    return {k: F.size(F.filter(lines, shows(p))) for k, p in LAYOUTS.items()} | {"lines": F.greatest(F.size(lines), F.lit(1))}


def classify(conversations: DataFrame, col: str = "raw") -> DataFrame:
    """(conv_id, standard, bracket, mixed, dm, thread, channel, confidence, format): one row each.
    Native and without shuffle; each stage is a projection over the one before."""
    c = F.col(col)
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = conversations.select("conv_id", F.coalesce(c, F.lit("")).alias(col)).withColumns({f"_{k}": v for k, v in hits(c).items()})
    n = {k: F.col(f"_{k}") for k in [*LAYOUTS, "lines"]}
    total = sum((n[k] for k in LAYOUTS if k != "mixed"), F.lit(0))
    rows = rows.withColumns({k: n[k] / n["lines"] for k in SCORES} | {"confidence": F.least(F.lit(1.0), total / (n["lines"] * 0.3))})
    boost = {"bracket": (2, 1.5), "standard": (5, 1.2), "dm": (1, 2.5), "thread": (2, 2.2), "channel": (2, 1.4)}
    rows = rows.withColumns({k: F.when(n[k] > least, F.col(k) * by).otherwise(F.col(k)) for k, (least, by) in boost.items()})
    signs = {"_av": AVATARS, "_tl": TEAM_LINKS, "_an": AVATAR_THEN_NAME, "_sc": STRONG_CHANNEL, "_cl": CHANNEL_LAYOUT}
    rows = rows.withColumns({k: no(c.rlike(p)) for k, p in signs.items()} | {"_dn": no(has_doubled_name(c)), "_dh": no(has_doubled_header(c)), "_cu": c.rlike(r"/archives/C[A-Z0-9]+/"), "_only": c.contains("/archives/C") & ~c.rlike(CHANNEL_WORDS)})
    dm, channel = F.col("dm"), F.col("channel")
    direct = sum((F.col(k).cast("int") for k in ("_av", "_dn", "_tl", "_dh", "_an")), F.lit(0)) >= 2
    plain = ~F.col("_sc") & ~F.col("_cl")
    cases = [
        (F.col("_an") & plain, F.greatest(dm * 3.0, F.lit(0.7)), channel * 0.3),
        (F.col("_cu") & (F.col("_cl") | F.col("_sc")), dm * 0.2, F.greatest(channel * 2.0, F.lit(0.7))),
        (F.col("_cu") & F.col("_dh") & ~F.col("_av"), dm * 0.6, F.greatest(channel * 1.5, F.lit(0.5))),
        (direct & plain & F.col("_only"), F.greatest(dm * 2.0, F.lit(0.5)), channel * 0.5),
        (F.col("_only") & (n["dm"] > 0) & ~F.col("_sc"), dm * 1.5, channel * 0.7),
    ]
    settled = {"dm": dm, "channel": channel}
    for when, new_dm, new_channel in reversed(cases):
        asked = ((n["dm"] > 0) | (n["channel"] > 0)) & when
        settled = {"dm": F.when(asked, new_dm).otherwise(settled["dm"]), "channel": F.when(asked, new_channel).otherwise(settled["channel"])}
    rows = rows.withColumns(settled)
    rows = rows.withColumn("_max", F.greatest(*map(F.col, SCORES), F.lit(0.1)))
    rows = rows.withColumns({k: F.least(F.lit(1.0), F.col(k) / F.col("_max")) for k in SCORES})
    thread = c.contains("thread_ts=") | c.rlike(r"\d+\s+replies?") | c.rlike(r"(?m)^---$")
    dm_leads = (dm > 0.4) & (dm > channel)
    form = (
        F.when(F.col("confidence") <= 0.3, "standard")
        .when(F.col("thread") > 0.3, F.when(thread, "thread").when(dm_leads, "dm").when(channel > 0.3, "channel").otherwise("standard"))
        .when(dm_leads, "dm")
        .when((dm > 0.3) & (channel > 0.3), F.when(dm > channel * 1.2, "dm").otherwise("channel"))
        .when((channel > 0.3) & (channel > dm), "channel")
        .when((F.col("bracket") > F.col("standard")) & (F.col("confidence") > 0.5), "bracket")
        .otherwise("standard")
    )
    return rows.select("conv_id", *SCORES, "confidence", form.alias("format"))


def standard_type(form: Column) -> Column:
    return F.when(form == "dm", "COMPACT").when(form == "thread", "DETAILED").otherwise("CONVERSATION")


#: Signs of the plain vote (fixed values).
VOTES = {
    "dm": [r"(?m)^\[\d{1,2}:\d{2}\]\(https://.*/archives/D[A-Z0-9]+/p\d+\)$", r"/archives/D[A-Z0-9]+/"],
    "thread": [r"thread_ts=", r"(?m)^!\[\]\(https://ca\.slack-edge\.com/", r"\d+\s+replies", r"Last reply.*ago.*View thread"],
    "channel": [r"/archives/C[A-Z0-9]+/", r"(?m)^---\s*[A-Za-z]"],
}


def vote_format(c: Column) -> Column:
    """The layout by how many signs of it the whole text shows: dm, thread, channel or standard."""
    dm, thread, channel = (sum((c.rlike(p).cast("int") for p in VOTES[k]), F.lit(0)) for k in ("dm", "thread", "channel"))
    return F.when((dm > thread) & (dm > channel), "dm").when((thread > dm) & (thread >= channel), "thread").when(channel > 0, "channel").otherwise("standard")
