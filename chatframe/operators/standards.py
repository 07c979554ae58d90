"""Messages by one of three formatting standards: template columns over the MESSAGE schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.text import let, lines_of, trim_u, unlines


@dataclass(frozen=True)
class Standard:
    """Templates of a standard; ``%s`` is the name, time, or a reaction's name and count."""

    user: str
    time: str
    indent: str
    thread: str
    embed: str
    spacing: str
    reaction: str | None = None
    thread_info: bool = False

    @property
    def callout(self) -> bool:
        return self.user.startswith("> [!slack]")


#: The standards (fixed values).
STANDARDS = {
    "CONVERSATION": Standard("> [!slack]+ Message from %s", "> **Time:** %s", "> ", "> ", "> ", "\n\n", "\n> %s %s"),
    "COMPACT": Standard("%s:", "`%s`", " ", "• ", "  ", "\n"),
    "DETAILED": Standard("> [!slack]+ Message from %s", "> **Time:** %s", "> ", "> ", "> ", "\n\n", "\n> %s %s", True),
}
#: Signs of attachments in a text, and names of systems (fixed values).
ATTACHMENTS = ["files.slack.com", ".pdf", ".doc", ".docx", ".zip", "download/", "PDF", "Google Doc"]
SYSTEMS = ["slackbot", "system", "bot", "integration"]
FILE_LINES = r"(?m)^\s*(?:PDF|Doc|Google Doc|Zip)\s*$|^\s*\d+ files?\s*$|^\s*\[\s*\]\s*$"


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def content_type() -> Column:
    """What a message is: the first that holds of reply, start, edited, file, preview, system, regular."""
    text, name, no = _or_empty("text"), F.lower(_or_empty("username")), F.lit(False)
    file, system = no, no
    for sign in ATTACHMENTS:
        file = file | text.contains(sign)
    for sign in SYSTEMS:
        system = system | name.contains(sign)
    flag = lambda c: F.coalesce(F.col(c), no)
    return (
        F.when(flag("is_thread_reply"), "thread_reply").when(flag("is_thread_start"), "thread_start").when(flag("is_edited"), "edited_message").when(file, "file_attachment")
        .when(text.rlike(r"https?://\S"), "link_preview").when(system, "system_message").otherwise("regular_message")
    )


def clean_embedded(text: Column) -> Column:
    """Without lines that are a link and nothing else, if there are other lines, and without lines
    that only name a file's kind or count."""
    def kept(ls: Column) -> Column:
        others = lambda x: F.exists(ls, lambda y: (trim_u(y) != "") & (y != x))
        return unlines(F.filter(ls, lambda x: ~(trim_u(x).rlike(r"^https?://\S+$") & others(x))))

    plain = F.when(text.rlike("(?m)^\\s*https?://"), let(lines_of(text), kept)).otherwise(text)
    return trim_u(F.regexp_replace(F.regexp_replace(plain, FILE_LINES, ""), r"\n\s*\n\s*\n", "\n\n"))


def block(kind: str, metadata: bool = True) -> Column:
    """One message as the standard has it, from its content type ``_what`` and cleaned text ``_text``."""
    s, what, c = STANDARDS[kind], F.col("_what"), F.col
    reply = what == "thread_reply"
    user = F.when(what == "system_message", F.concat(F.lit("*"), c("username"), F.lit("*"))).otherwise(F.concat(F.when(reply, s.thread).otherwise(""), F.format_string(s.user, c("username"))))
    time = F.concat(F.when(reply, s.thread).otherwise(""), F.format_string(s.time, c("ts_text")))
    indent = F.when(reply, s.thread + s.indent).when(what == "link_preview", s.embed).otherwise(s.indent)
    body = unlines(F.transform(lines_of(c("_text")), lambda x: F.when(trim_u(x) == "", ">" if s.callout else "").otherwise(F.concat(indent, x))))
    filled = lambda x, shown: F.when(F.coalesce(x, F.lit("")) != "", shown)
    parts = [filled(c("username"), user)]
    if metadata:
        parts.append(filled(c("ts_text"), time))
    parts.append(filled(c("text"), body))
    if s.reaction:
        marks = F.transform("reactions", lambda r: F.format_string(s.reaction, F.coalesce(F.nullif(r["name"], F.lit("")), F.lit("👍")), F.when(F.coalesce(r["count"], F.lit(0)) == 0, 1).otherwise(r["count"]).cast("string")))
        parts.append(F.when(F.size("reactions") > 0, F.array_join(marks, "")))
    if s.thread_info and metadata:
        parts.append(filled(c("thread_info"), F.concat(F.lit("*"), c("thread_info"), F.lit("*"))))
    parts.append(F.when(F.coalesce(c("is_edited"), F.lit(False)), "*(edited)*"))
    joined = lambda ps: F.when(F.size(ps) > 2, F.concat(F.slice(ps, 1, 2), F.array(F.lit(">")), F.slice(ps, 3, len(parts)))).otherwise(ps)
    return let(F.filter(F.array(*parts), lambda x: x.isNotNull()), lambda ps: F.array_join(joined(ps), "\n") if s.callout else F.array_join(ps, " "))


def apply_standard(messages: DataFrame, kind: str = "CONVERSATION", metadata: bool = True, cleanup: bool = True) -> DataFrame:
    """(conv_id, text): a conversation's messages in order by a standard."""
    rows = messages.withColumns({"_what": content_type(), "_text": clean_embedded(F.col("text")) if cleanup else F.col("text")})
    rows = rows.select("conv_id", F.struct("msg_idx", block(kind, metadata).alias("x")).alias("m"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return joined.select("conv_id", F.array_join(F.transform("ms", lambda m: m["x"]), STANDARDS[kind].spacing).alias("text"))
