"""User names: undoubling, display form, decorations, validity and application messages."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatframe.functions.emoji import remove_emoji
from chatframe.functions.text import group, let, lines_of, trim_u, unlines
from chatframe.schema import UNKNOWN_USER

#: Letters of names, by script ranges (fixed values).
SCRIPTS = r"\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{0590}-\x{06FF}"
#: Signs of names; ASCII ones are listed one by one, as Java looks those up in a table, before any range.
NAME = rf"[[{ascii_letters}{digits}'\-][{SCRIPTS}]]"
PICTURES = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F100}-\x{1F1FF}\x{1F200}-\x{1F2FF}]"
EMOJI_LINK = r"!?\[:[\w\-+]+:\]\([^)]+\)"
#: Names no user has, and words that titles keep in lower case (fixed values).
RESERVED = ["unknown user", "unknown", "user", "bot", "slack", "app", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SMALL_WORDS = ["and", "or", "the", "a", "an", "in", "on", "at", "to", "for"]
MONTH3 = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
APP_NAME = rf"([A-Za-z][A-Za-z0-9\-_.]*(?:\s+App)?)\s*(?:\s+(?:{MONTH3})|\s+\w.*|$)"
APP_IN_PARENS = rf"^\s*\(https?://[^)]+\){APP_NAME}"
APP_AFTER_URL = rf"^\s*https?://[^\s]+\s+{APP_NAME}"
APP_SERVICE = r"https?://[^\s/]*slack[^\s/]*/services/[A-Z0-9]+"
APP_DOUBLED = r"(?i)^([A-Za-z][A-Za-z0-9\s\-_.]+)\1\s*(?:APP\s*)?"
MAX_LENGTH, MAX_WORDS = 10_000, 1_000
#: Words of a doubled name that a pattern finds anywhere in a line. A pattern that repeats a group without
#: bound before a reference to it goes one call deeper for each word, which a long text doesn't survive;
#: longer names are found where they and their double are the line.
NAME_WORDS = 8


def _strip_marks(c: Column) -> Column:
    """Without codes, emoji images and pictures."""
    return let(c, lambda v: F.when(v.rlike(rf":|!\[|{PICTURES}"), _strip_all_marks(v)).otherwise(trim_u(v)))


def _strip_all_marks(c: Column) -> Column:
    for pattern in (r":[\w+-]+:(?::[\w-]+:)?", r"(?::[\w+-]+:)+", r"!\[:[\w\-+]+:\]\([^)]+\)", r"!\[\]\([^)]+\)", PICTURES):
        c = trim_u(F.regexp_replace(c, pattern, ""))
    return c


def _without_repeats(line: Column) -> Column:
    """A word that repeats the one before it, whatever its case, goes; a third one stays again."""
    return F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"(?iu)(?<!\S)(\S++) \1(?!\S)", "$1")


def halved_name(line: Column) -> Column:
    """A line that is a name of more than ``NAME_WORDS`` words and its double, with or without white space
    between, once; null for other lines. Halves are compared, so a line is looked through once, however long."""

    def halved(x: Column) -> Column:
        n = F.length(x)
        half, rest = F.substring(x, F.lit(1), F.floor(n / 2).cast("int")), F.substring(x, F.floor((n + 3) / 2).cast("int"), n)
        joined = (n % 2 == 0) & (F.concat(half, half) == x)
        spaced = (n % 2 == 1) & (half == rest) & (F.substring(x, F.floor((n + 1) / 2).cast("int"), F.lit(1)) == " ")
        words = F.split(half, " ")
        return F.when((joined | spaced) & (F.size(words) > NAME_WORDS) & F.forall(words, lambda w: w.rlike(rf"^{NAME}+$")), half)

    return F.when(F.size(F.split(line, r"\s+", 2 * NAME_WORDS + 1)) > 2 * NAME_WORDS, let(F.regexp_replace(trim_u(line), r"\s+", " "), halved))


def _thread_form(c: Column) -> Column:
    """A doubled name before an emoji link, and what follows it."""
    return let(c, _thread_once)


def _thread_once(c: Column) -> Column:
    doubled = rf"^(.+?)\1{EMOJI_LINK}(.*)$"
    plain = trim_u(F.regexp_replace(c, EMOJI_LINK, ""))
    with_link = trim_u(F.concat_ws(" ", trim_u(F.regexp_extract(c, doubled, 1)), F.nullif(trim_u(F.regexp_extract(c, doubled, 2)), F.lit(""))))
    return F.when(c.rlike(doubled), with_link).otherwise(F.coalesce(trim_u(group(plain, r"^(.+?)\1$")), plain))


def _dm_form(c: Column) -> Column:
    return let(c, lambda v: F.coalesce(trim_u(group(v, r"^(.+?)\1$")), trim_u(group(v, r"^(.+?)\s+\1$")), v))


def undouble(c: Column, form: str | None = None) -> Column:
    """``AnnAnn``, ``Ann Ann`` and doubled parts once; emoji go and white space collapses by line.
    ``form``: thread or dm, whose layouts double names in their own ways."""
    return let(c, lambda v: _undouble(v, form))


def _undouble(c: Column, form: str | None) -> Column:
    half = F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))
    long_double = (F.length(c) > 500) & (F.concat(half, half) == c)
    x = _thread_form(c) if form == "thread" else _dm_form(c) if form == "dm" else c
    x = unlines(F.transform(lines_of(x), lambda line: F.coalesce(halved_name(line), line)))
    words = rf"\b{NAME}+(?:\s+{NAME}+){{0,{NAME_WORDS - 1}}}"
    x = F.regexp_replace(x, rf"({words})\1\b", "$1")
    whole = words.replace("+", "++")  # white space follows these, so no part of a word will do
    x = F.regexp_replace(x, rf"({whole})\s++\1\b", "$1")
    x = F.regexp_replace(x, rf"(\b{NAME}++)\s++\1(\b{NAME}++)\s++\2\b", "$1 $2")
    x = _strip_marks(unlines(F.transform(lines_of(x), _without_repeats)))
    x = trim_u(unlines(F.transform(lines_of(x), lambda line: trim_u(F.regexp_replace(line, r"\s+", " ")))))
    return F.when(long_double, _strip_marks(half)).otherwise(x)


def display_name(c: Column) -> Column:
    """Without emoji, links and edge signs; camel case stays, all else becomes title case. Empty
    stays as it is, and a name of which nothing is left is unknown."""
    x = remove_emoji(undouble(c))
    for pattern, new in ((r"!\[.*?\]\(.*?\)", ""), (r"\[.*?\]\(.*?\)", ""), (r"https?://[^\s]+", ""), ("[<>]", ""), (r"\|", " "), (r"[.,;:!?]+$", "")):
        x = F.regexp_replace(x, pattern, new)
    x = F.regexp_replace(trim_u(x), r"^[_\s-]+|[_\s-]+$", "")
    return F.when(c.isNull() | (trim_u(c) == ""), c).otherwise(let(x, _titled))


def _titled(x: Column) -> Column:
    parts = F.filter(F.split(x, r"[_\s-]+", -1), lambda p: p != "")
    cased = F.transform(parts, lambda p, i: F.when((i > 0) & F.lower(p).isin(SMALL_WORDS), F.lower(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, MAX_LENGTH)))))
    shown = F.when(x.rlike("[a-z][A-Z]"), trim_u(F.regexp_replace(x, "[_-]+", " "))).otherwise(F.array_join(cased, " "))
    return F.when(x == "", UNKNOWN_USER).otherwise(shown)


def strip_decorations(c: Column) -> Column:
    """Without emoji, links, the APP mark and signs that names don't have."""
    x = _strip_marks(c)
    for pattern, new in ((r"!?\[.*?\]\(.*?\)", ""), (r"https?://[^\s]+", ""), (r"[<>|]", ""), (r"(?i)\s*APP\s*", " "), (rf"[^a-zA-Z0-9{SCRIPTS}\s\-_.']", " ")):
        x = F.regexp_replace(x, pattern, new)
    x = trim_u(F.regexp_replace(x, r"[.,;:!?]+$", ""))
    return trim_u(F.regexp_replace(x, r"\s+", " "))


def normalise_name(c: Column) -> Column:
    x = trim_u(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(x, rf"^[^a-zA-Z0-9{SCRIPTS}]+|[^a-zA-Z0-9{SCRIPTS}\s']+$", "")
    x = F.regexp_replace(x, rf"[^a-zA-Z0-9{SCRIPTS}\s\-_.'()]", " ")
    return F.substring(F.regexp_replace(x, r"\s+", " "), 1, MAX_LENGTH)


def is_valid_name(c: Column) -> Column:
    """Not empty, reserved, all digits, without any letter, or a clock."""
    return F.coalesce(let(F.lower(trim_u(c)), _fine), F.lit(False))


def _fine(x: Column) -> Column:
    return (x != "") & (F.length(x) <= MAX_LENGTH) & ~x.isin(RESERVED) & (F.size(F.split(x, r"\s+")) <= MAX_WORDS) & x.rlike(rf"[a-zA-Z{SCRIPTS}]") & ~x.rlike(r"^\d{1,2}:\d{2}")

def is_app_message(c: Column) -> Column:
    return F.coalesce(c.rlike(APP_IN_PARENS) | c.rlike(APP_AFTER_URL) | c.rlike(APP_SERVICE), F.lit(False))


def app_name(c: Column) -> Column:
    one = trim_u(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(trim_u(group(one, APP_IN_PARENS)), trim_u(group(one, APP_AFTER_URL)), trim_u(group(one, APP_DOUBLED)), trim_u(c))


def extract_name(c: Column, form: str | None = None) -> Column:
    """The user that a text names, or unknown."""
    x = trim_u(c)
    by_app = (F.lit(form == "app") | is_app_message(x)) & is_valid_name(app_name(x))
    plain = normalise_name(strip_decorations(undouble(x, form if form in ("thread", "dm") else None)))
    valid = let(plain, lambda p: F.when(is_valid_name(p), p).otherwise(UNKNOWN_USER))
    return F.when(c.isNull() | (c == ""), UNKNOWN_USER).when(by_app, normalise_name(app_name(x))).otherwise(valid)


def name_of_thread_header(line: Column) -> Column:
    link = r"\s+\[.*?\]\(https?://[^)]+\)$"
    before = trim_u(F.regexp_replace(line, link, ""))
    return F.when(line.rlike(link), extract_name(before, "thread")).when(~line.rlike(r"\[.*?\]\(https?://[^)]+\)"), UNKNOWN_USER).otherwise(extract_name(line, "thread"))


def name_of_dm_header(line: Column) -> Column:
    x = trim_u(line)
    whole = trim_u(group(x, r"^([A-Za-z\s\x{00C0}-\x{017F}]+)\1\s+\[\d{1,2}:\d{2}\s*(?:AM|PM)?\]\(https://.*/archives/[CD][A-Z0-9]+/p\d+\)"))
    parts = r"^([A-Za-z]+)\1([A-Za-z\s]+)\2\s+\[\d{1,2}:\d{2}"
    split = F.when(x.rlike(parts), F.concat(F.regexp_extract(x, parts, 1), F.regexp_extract(x, parts, 2)))
    return extract_name(F.coalesce(whole, split, group(x, r"^(.+?)\s+\[\d{1,2}:\d{2}"), x), "dm")


def header_form(line: Column) -> Column:
    """app, thread, dm or unknown, by the layout of a header line."""
    return (
        F.when(is_app_message(line), "app")
        .when(line.rlike(rf"^.+{EMOJI_LINK}\s+\[.*?\]\(https?://[^)]+\)"), "thread")
        .when(trim_u(line).rlike(r"^\[.*?\]\(https?://[^)]+\)$"), "dm")
        .when(line.rlike(r"^.+\s+\[.*?\]\(https?://[^)]+\)$"), "thread")
        .otherwise("unknown")
    )
