"""Messages as Markdown: call-out blocks, notes with front matter, and the plain reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.emoji import format_reactions, replace_emoji
from chatframe.functions.enrich import convert_links, fences_before, link_threads, step
from chatframe.functions.names import display_name
from chatframe.functions.text import group, is_blank, let, lines_of, postprocess, trim_u, unlines
from chatframe.functions.times import display_time
from chatframe.schema import UNKNOWN_USER
from chatframe.settings import Settings

CALLOUT = "slack"
SHORT_TEXT, SHOWN_LINES, UNPARSED_LINES = 50, 100, 50


def thread_lines(info: Column) -> Column:
    """array<string>: reply and what it answers, count and last reply, link, broadcast."""
    return let(info, _thread_lines)


def _thread_lines(info: Column) -> Column:
    reply = group(info, r"(?i)(\d+)\s+repl(?:y|ies)")
    last = F.coalesce(group(info, r"(?i)Last reply\s+(.+?)(?:View thread|$)"), group(info, r"(?i)(\d+\s+(?:days?|months?|hours?|minutes?)\s+ago)View thread"))
    view = info.rlike("(?i)View thread")
    answers = r'(?i)replied to a thread:\s*(?:"([^"]+)"|(.+?)(?=\s*(?:View thread|Last reply|$)))?'
    context = trim_u(F.coalesce(group(info, answers, 1), group(info, answers, 2)))
    counts = F.concat_ws(" • ", F.when(reply.isNotNull(), F.concat(F.lit("**"), reply, F.when(reply.cast("long") == 1, " reply**").otherwise(" replies**"))), F.concat(F.lit("Last reply "), trim_u(last)))
    url = group(info, r"View thread.*?(https?://[^\s]+)")
    found = F.array(
        F.when(info.rlike(answers), "🧵 **Thread Reply**"),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit('   _Replying to: "'), context, F.lit('"_'))),
        F.when(counts != "", F.concat(F.lit("📊 "), counts)),
        F.when(view, F.coalesce(F.concat(F.lit("🔗 [View thread]("), url, F.lit(")")), F.lit("🔗 View thread"))),
        F.when(info.rlike("(?i)Also sent to the channel"), "📢 Also sent to the channel"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def body_lines(text: Column, settings: Settings, compat: bool = True) -> Column:
    """The text's lines behind ``>``. Outside fences, links and emoji are converted once more,
    whatever the switches (``compat``: as ever; else only with them on)."""
    def shown(x: Column) -> Column:
        if compat or settings.convert_links:
            x = convert_links(x)
        if compat or settings.replace_emoji:
            x = replace_emoji(x, settings.emoji_map)
        return link_threads(x) if settings.highlight_threads else x

    def quoted(x: Column) -> Column:
        return F.when(trim_u(x) == "", ">").otherwise(F.concat(F.lit("> "), x))

    def fence(x: Column, inside: Column) -> Column:
        language = F.substring(x, 4, 1 << 30)
        mark = F.when(inside | (x == "```"), "> ").otherwise("")
        return F.concat(mark, F.lit("```"), F.when(inside, F.lit("")).otherwise(trim_u(language)) if settings.detect_code_blocks else language)

    def line(x: Column, inside: Column) -> Column:
        return F.when(x.startswith("```"), fence(x, inside)).when(inside, quoted(x)).otherwise(let(shown(x), quoted))

    def fenced(ls: Column) -> Column:
        return let(fences_before(ls), lambda n: F.transform(ls, lambda x, i: line(x, F.get(n, i) % 2 == 1)))

    plain = lambda ls: F.transform(ls, lambda x: let(shown(x), quoted))
    return let(text, lambda t: F.when(t.contains("```"), let(lines_of(t), fenced)).otherwise(let(lines_of(t), plain)))


def _header(kind: str, name: Column, time: Column, reply: Column) -> list[Column]:
    what = F.when(reply, "Thread Reply").otherwise("Message")
    if kind == "bracket":
        return [F.concat(F.lit(f"> [!{CALLOUT}]+ ["), what, F.lit(" from "), name, F.lit("]")), F.concat(F.lit("> [Time: "), time, F.lit("]")), F.lit(">")]
    return [F.concat(F.lit(f"> [!{CALLOUT}]+ "), what, F.lit(" from "), name), F.concat(F.lit("> **Time:** "), time), F.lit(">")]


def render_block(kind: str, settings: Settings, ref: Column, compat: bool = True) -> Column:
    """One message (columns of the MESSAGE schema) as a call-out block; null if it has no text."""
    info, marks = F.col("thread_info"), format_reactions(F.col("reactions"), settings.emoji_map)
    reply = F.coalesce(F.col("is_thread_reply"), F.lit(False)) | F.coalesce(F.contains(info, F.lit("replied to a thread:")), F.lit(False))
    head = _header(kind, display_name(F.col("username")), display_time(F.col("ts_text"), ref, F.col("msg_date"), settings.time_zone), reply)
    thread = F.when(F.coalesce(info, F.lit("")) != "", F.concat(F.array(F.lit(">")), F.transform(thread_lines(info), lambda x: F.concat(F.lit("> "), x)))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(F.lit("> [Reactions: "), marks, F.lit("]")) if kind == "bracket" else F.concat(F.lit("> "), marks)
    reactions = F.when(marks != "", F.array(F.lit(">"), shown)).otherwise(F.array().cast("array<string>"))
    block = unlines(F.concat(F.array(*head), body_lines(F.col("text"), settings, compat), thread, reactions))
    return F.when(~is_blank(F.col("text")), block)


def mixed_block(settings: Settings, ref: Column) -> Column:
    """The mixed layout: standard, bracket or, for unknown authors, minimal by message."""
    c = F.col
    time = display_time(c("ts_text"), ref, c("msg_date"), settings.time_zone)
    text = c("text")
    for name, on in (("links", settings.convert_links), ("mentions", settings.convert_user_mentions), ("code_fences", settings.detect_code_blocks), ("emoji", settings.replace_emoji), ("thread_links", settings.highlight_threads)):
        for f in step(name, settings) if on else ():
            text = f(text)
    lines, marks = lines_of(text), format_reactions(c("reactions"), settings.emoji_map)
    has_text, has_time = F.coalesce(c("text"), F.lit("")) != "", F.coalesce(c("ts_text"), F.lit("")) != ""
    quoted = F.transform(lines, lambda x: F.concat(F.lit("> "), x))
    brief = has_text & (F.size(lines) == 1) & (F.length(text) < SHORT_TEXT)
    info = F.nullif(c("thread_info"), F.lit(""))
    only = lambda when, x: F.when(when, x)
    some = lambda *xs: F.filter(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in xs])), lambda x: x.isNotNull())
    one = lambda x: F.array(x)
    standard = some(
        one(F.concat(F.lit(">[!note]+ Message from [["), c("username"), F.lit("]]"))),
        one(only(has_time, F.concat(F.lit("> **Time:** "), time, F.when(brief, F.concat(F.lit(" — "), text)).otherwise("")))),
        F.when(brief & ~has_time, quoted).when(has_text & ~brief, F.concat(one(F.lit(">")), quoted)),
        one(only(marks != "", F.concat(F.lit("> **Reactions:** "), marks))),
        one(F.concat(F.lit("> **Thread:** "), info)),
    )
    bracket = some(
        one(F.concat(F.lit(">[!note]+ [Message from "), c("username"), F.lit("]"))), one(only(has_time, F.concat(F.lit("> [Time: "), time, F.lit("]")))),
        F.when(has_text, F.concat(one(F.lit(">")), quoted)), one(only(marks != "", F.concat(F.lit("> [Reactions: "), marks, F.lit("]")))), one(F.concat(F.lit("> ["), info, F.lit("]"))),
    )
    minimal = some(
        one(F.lit(">[!info]")), one(only(has_time, F.concat(F.lit("> "), time))), F.when(has_text, F.concat(F.when((F.coalesce(c("username"), F.lit("")) != "") | has_time, one(F.lit(">"))).otherwise(F.array().cast("array<string>")), quoted)),
        one(only(marks != "", F.concat(F.lit("> "), marks))),
    )
    return unlines(F.when(c("text").contains("[Message from") | c("text").contains("[Time:"), bracket).when(F.coalesce(c("username"), F.lit(UNKNOWN_USER)) == UNKNOWN_USER, minimal).otherwise(standard))


#: Layouts by format: direct messages, threads and channels use the standard one.
STRATEGIES: dict[str, Callable[[Settings, Column], Column]] = {
    **{k: lambda s, ref: render_block("standard", s, ref, s.compat) for k in ("standard", "dm", "thread", "channel")},
    "bracket": lambda s, ref: render_block("bracket", s, ref, s.compat),
    "mixed": mixed_block,
}


#: Names that were registered from outside: rendering looks these up as formats.
REGISTERED: list[str] = []


def register_strategy(name: str, strategy: Callable[[Settings, Column], Column]) -> None:
    """Render conversations of the format ``name`` by ``strategy``, in place of what had the name."""
    STRATEGIES[name] = strategy
    REGISTERED.append(name) if name not in REGISTERED else None


def render_conversations(messages: DataFrame, formats: DataFrame | None, ref: Column, settings: Settings | None = None) -> DataFrame:
    """(conv_id, markdown): the blocks of a conversation in order, joined by blank lines. ``formats``
    is (conv_id, format); without it all are standard."""
    return join_blocks(messages, formats, ref, settings).select("conv_id", postprocess(F.col("joined")).alias("markdown"))


def join_blocks(messages: DataFrame, formats: DataFrame | None, ref: Column, settings: Settings | None = None) -> DataFrame:
    """(conv_id, joined): the same before its outer white space goes."""
    settings = settings or Settings()
    rows = messages
    for c, kind in (("thread_info", "string"), ("msg_date", "timestamp"), ("is_thread_reply", "boolean"), ("reactions", "array<struct<name:string,count:int>>"), ("ts_text", "string")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    if formats is None:
        block = STRATEGIES["standard"](settings, ref)
    else:
        rows = rows.join(formats.select("conv_id", F.col("format").alias("_format")), "conv_id", "left")
        standard, bracket = STRATEGIES["standard"](settings, ref), STRATEGIES["bracket"](settings, ref)
        block = F.when(F.col("_format") == "bracket", bracket).otherwise(standard)
        for name in REGISTERED:
            block = F.when(F.col("_format") == name, STRATEGIES[name](settings, ref)).otherwise(block)
    rows = rows.select("conv_id", "msg_idx", block.alias("block")).where("block is not null")
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "block"))).alias("bs"))
    return joined.select("conv_id", F.array_join(F.transform("bs", lambda b: b["block"]), "\n\n").alias("joined"))


def notes(rendered: DataFrame, stats: DataFrame, date: str, settings: Settings | None = None) -> DataFrame:
    """(conv_id, note): front matter and body. ``date`` is an ISO day, never the wall clock."""
    settings = settings or Settings()
    title = f"{settings.frontmatter_title}\n\n" if settings.frontmatter_title else ""
    head = F.format_string(f"---\ncssclasses: {settings.frontmatter_css_class or 'slack-conversation'}\nparticipants: %d\nmessages: %d\nformat: %s\ndate: {date}\n---\n\n{title}", "unique_users", "message_count", "format")
    return rendered.join(stats, "conv_id").select("conv_id", F.concat(head, "markdown").alias("note"))


def preview_line(stats: DataFrame) -> DataFrame:
    return stats.select("conv_id", F.format_string("%d messages • %d participants • %s format", F.coalesce("message_count", F.lit(0)), F.coalesce("unique_users", F.lit(0)), F.coalesce("format", F.lit("unknown"))).alias("preview"))


def unparsed_lines(lines: DataFrame, messages: DataFrame, most: int = UNPARSED_LINES) -> DataFrame:
    """(conv_id, line_no, content, total): filled lines that no message's whole text equals; the
    first ``most`` of a conversation, with their number in all."""
    from pyspark.sql import Window as W

    texts = messages.select("conv_id", trim_u(F.col("text")).alias("trimmed")).distinct()
    left = lines.where("trimmed <> ''").join(texts, ["conv_id", "trimmed"], "left_anti")
    order = W.partitionBy("conv_id").orderBy("line_no")
    left = left.withColumns({"_n": F.row_number().over(order), "total": F.count("*").over(W.partitionBy("conv_id"))})
    return left.where(F.col("_n") <= most).select("conv_id", "line_no", "content", "total")


def failure_note(c: Column, error: Column) -> Column:
    """What a conversation that failed renders as: its first lines and the signs found in it."""
    lines = lines_of(c)
    users, times = F.regexp_count(c, F.lit("<@U[A-Z0-9]+>")), F.regexp_count(c, F.lit(r"(?i)\d{1,2}:\d{2}\s*(?:AM|PM)"))
    signs = F.filter(F.array(F.when((users > 0) | (times > 0), ">"), F.when((users > 0) | (times > 0), "> **Detected Elements:**"), F.when(users > 0, F.format_string("> - User mentions: %d", users)), F.when(times > 0, F.format_string("> - Timestamps: %d", times))), lambda x: x.isNotNull())
    more = F.when(F.size(lines) > SHOWN_LINES, F.array(F.format_string("> ... and %d more lines", F.size(lines) - SHOWN_LINES))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(">[!warning]+ Slack Formatting Error"), F.lit("> Failed to parse this content as Slack conversation."), F.concat(F.lit("> Error: "), F.coalesce(F.nullif(error, F.lit("")), F.lit("Unknown error"))), F.lit(">"), F.lit("> **Original Content:**"), F.lit(">"), F.lit("> ```"))
    return unlines(F.concat(head, F.transform(F.slice(lines, 1, SHOWN_LINES), lambda x: F.concat(F.lit("> "), x)), more, F.array(F.lit("> ```")), signs))
