"""Text enrichment: an ordered pipeline of scalar steps over a message's text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatframe.functions.emoji import literal_map, replace_emoji
from chatframe.functions.names import NAME_WORDS, halved_name, undouble
from chatframe.functions.text import let, lines_of, map_tokens, nfc_of, sanitise, trim_u, unlines
from chatframe.settings import Settings

#: What escaping leaves as it is: fences, mentions, links and entities.
KEPT = r"```[\s\S]*?```|<@[A-Z0-9]+>|<#[A-Z0-9]+\|[^>]+>|<#[A-Z0-9]+>|<https?://[^>]+\|[^>]+>|<https?://[^>]+>|&lt;|&gt;"
OPEN, CLOSE = "(?:<|&lt;)", "(?:>|&gt;)"
LABELLED = rf"{OPEN}(https?://[^|>]+)\|([^>]+){CLOSE}"
PLAIN = rf"{OPEN}(https?://[^>]+){CLOSE}"
DOMAIN = rf"{OPEN}((?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{{2,}}[^>]*){CLOSE}"
MAIL = rf"{OPEN}mailto:([^>]+){CLOSE}"
URL_OK = r"^https?://[^\s/?#]+"
DOUBLED_NAME = rf"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){{0,{NAME_WORDS - 1}}})\1"
JUST_A_NAME = r"^[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}$"
AVATAR = r"^!\[\]\(https://ca\.slack-edge\.com/[^)]+\)$"
#: Lines that stand for attachment metadata (fixed values).
ATTACHMENT_META = (r"(?i)^(?:\d+\s+files?|Download|Open in browser|Preview not available|File type: .+|File size: .+|Language|TypeScript|Last updated|"
                   r"\d+\s+(?:minutes?|hours?|days?|weeks?|months?|years?)\s+ago)$|^\s*\[\s*$|^\s*\]\(https?://[^)]+\)\s*$|^!\[\]\(https://ca\.slack-edge\.com/[^)]+\)$")  # fmt: skip
#: Icons of uploads by file extension (fixed values).
UPLOADS = [("🖼️", "png|jpg|jpeg|gif|webp|svg"), ("📄", "pdf|doc|docx|xls|xlsx|ppt|pptx"), ("💻", "js|ts|py|java|c|cpp|go|rs|rb|php")]


def fences_before(lines: Column) -> Column:
    """For each line how many fences stand before it."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.startswith("```").cast("int")))
    return F.aggregate(lines, F.array(F.lit(0)), step)


def format_fences(c: Column) -> Column:
    """An opening fence keeps its trimmed language, a closing one is bare."""
    def fence(x: Column, before: Column) -> Column:
        return F.when(before % 2 == 0, F.concat(F.lit("```"), trim_u(F.substring(x, 4, 1 << 30)))).otherwise("```")

    def formatted(ls: Column) -> Column:
        return let(fences_before(ls), lambda n: unlines(F.transform(ls, lambda x, i: F.when(x.startswith("```"), fence(x, F.get(n, i))).otherwise(x))))

    return let(c, lambda v: F.when(v.contains("```"), let(lines_of(v), formatted)).otherwise(v))


def escape_brackets(c: Column) -> Column:
    escaped = lambda g: F.replace(F.replace(g, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return map_tokens(c, KEPT, lambda t: t, escaped)


def convert_links(c: Column) -> Column:
    """Angle-bracket links, domains and mail addresses, escaped or not, as Markdown. What has no opening
    bracket passes as it is."""

    def labelled(t: Column) -> Column:
        url, label = F.regexp_extract(t, LABELLED, 1), trim_u(F.regexp_extract(t, LABELLED, 2))
        label = F.regexp_replace(F.when(label == "", "Link").otherwise(label), r"([\[\]()])", r"\\$1")
        return F.when(url.rlike(URL_OK), F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))).otherwise(t)

    def domain(t: Column) -> Column:
        url = F.regexp_extract(t, DOMAIN, 1)
        full = F.concat(F.when(url.startswith("www."), F.lit("https://")).otherwise(F.lit("https://www.")), url)
        return F.when(full.rlike(r"^https://[^\s/?#]+(?:[/?#]\S*)?$"), full).otherwise(t)

    def mail(t: Column) -> Column:
        address = F.regexp_extract(t, MAIL, 1)
        return F.when(address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.concat(F.lit("["), address, F.lit("](mailto:"), address, F.lit(")"))).otherwise(t)

    def converted(v: Column) -> Column:
        v = map_tokens(v, LABELLED, labelled)
        v = map_tokens(v, PLAIN, lambda t: F.when(F.regexp_extract(t, PLAIN, 1).rlike(URL_OK), F.regexp_extract(t, PLAIN, 1)).otherwise(t))
        return map_tokens(map_tokens(v, DOMAIN, domain), MAIL, mail)

    return let(c, lambda v: F.when(v.contains("<") | v.contains("&lt;"), converted(v)).otherwise(v))


def wiki_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(trim_u(c), r"[\[\]|#^<>]", ""), r"\s+", " "), 1, 100)


def convert_mentions(c: Column, users: Mapping[str, str] | None = None, compat: bool = False) -> Column:
    """Mentions by id (through the user map), bare, bracketed and linked as wiki links; broadcasts
    bold. With ``compat`` a run of spaces counts as part of the word it touches, as where runs are
    masked by words before this step: a bare mention goes on after it, and none starts behind it."""
    bare = r"(?<![\[@\w.])(?<! {2})@((?:\w| {2,})++)(?![@\w.])" if compat else r"(?<![\[@\w.])@(\w+)(?![@\w.])"
    names = literal_map(users or {})

    def by_id(t: Column) -> Column:
        user = F.regexp_extract(t, "<@(U[A-Z0-9]+)>", 1)
        name = F.try_element_at(names, user)
        return (
            F.when(F.coalesce(trim_u(name), F.lit("")) == "", F.concat(F.lit("[[User-"), F.substring(user, 1, 6), F.lit("]]")))
            .when(name.rlike(r"^\[\[.*\]\]$"), name)
            .otherwise(F.concat(F.lit("[["), wiki_name(name), F.lit("]]")))
        )

    c = map_tokens(c, "<@U[A-Z0-9]+>", by_id)
    for pattern, new in (
        (bare, "[[$1]]"),
        (r"<@(\w+)>", "[[$1]]"),
        (r"\[@(\w+)\]\(https?://[^)]+\)", "[[$1]]"),
        (r"<!(?:channel|here|everyone)\|([^>]+)>", "**$1**"),
        (r"<!(channel|here|everyone)>", "**@$1**"),
        (r"<![a-z]+\|([^>]+)>", "$1"),
        (r"<!([a-z]+)>", "@$1"),
    ):
        c = F.regexp_replace(c, pattern, new)
    return c


def undouble_in_text(c: Column) -> Column:
    """A text with a doubled capitalised name, or that is just a name, is undoubled as a whole."""
    return let(c, _undouble_named)


def _undouble_named(c: Column) -> Column:
    longer = F.exists(lines_of(c), lambda x: halved_name(x).isNotNull())
    named = c.rlike(DOUBLED_NAME) | longer | (trim_u(c).rlike(JUST_A_NAME) & (F.length(trim_u(c)) < 50))
    return F.when(named, undouble(c)).otherwise(c)


def link_threads(c: Column) -> Column:
    return F.regexp_replace(c, r"View thread:\s*(https://[^\s]+)", r"[View thread]($1)")


def mark_uploads(c: Column) -> Column:
    """``X uploaded a file: F`` with the icon of its kind. Texts without these words pass as they are; in
    others X starts a line, since a match can't start later, so each line is looked through once."""
    pattern = r"(?im)(?:\A([^\S\n])|^(.*?\S))\s++uploaded a file:\s*(.+)"

    def shown(t: Column) -> Column:
        file, who = trim_u(F.regexp_extract(t, pattern, 3)), F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2))
        icon = F.lit("📎")
        for sign, extensions in reversed(UPLOADS):
            icon = F.when(file.rlike(rf"(?i)\.({extensions})$"), sign).otherwise(icon)
        return F.concat(icon, F.lit(" "), who, F.lit(" uploaded: **"), file, F.lit("**"))

    return let(c, lambda v: F.when(v.rlike("(?i)uploaded a file:"), map_tokens(v, pattern, shown)).otherwise(v))


def mark_images(c: Column) -> Column:
    """A text that is one image, or names an image's source, as a whole."""
    return let(c, _mark_image)


def _mark_image(c: Column) -> Column:
    image = r"^!\[([^\]]*)\]\(([^)]+)\)\z"
    alt, url = trim_u(F.regexp_extract(c, image, 1)), F.regexp_extract(c, image, 2)
    shown = F.concat(F.lit("!["), F.when(alt == "", "Image").otherwise(alt), F.lit("]("), url, F.lit(")"))
    return F.when(c.rlike(r"(?i)^Image from (?:iOS|Android|Desktop)\z"), F.concat(F.lit("🖼️ _"), c, F.lit("_"))).when(c.rlike(image) & url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S"), shown).otherwise(c)


def mark_services(c: Column) -> Column:
    """The first ``Added by [service](url)`` in italics."""
    pattern = r"(?s)^(.*?)📎\s*Added by\s*\[([^\]]+)\]\([^)]+\)"
    return F.regexp_replace(c, pattern, "$1📎 _Added by $2_")


def mark_avatars(c: Column) -> Column:
    """An avatar on a line of its own goes, or becomes a comment before a header or real text."""
    return let(c, lambda v: F.when(v.contains("![](https://ca.slack-edge.com/"), let(lines_of(v), _mark_avatar_lines)).otherwise(v))


def _mark_avatar_lines(lines: Column) -> Column:
    def kept(i: Column) -> Column:
        after = F.transform(F.slice(lines, i + 2, 4), trim_u)
        header = F.coalesce(F.try_element_at(after, F.lit(1)).rlike(r"(?i)^[A-Za-z0-9\s\-_.'\x{00C0}-\x{017F}]+.*\[[^\]]+\]\(https?://[^)]+\)$"), F.lit(False))
        return header | F.exists(after, lambda x: (F.length(x) > 20) & ~x.rlike(ATTACHMENT_META))

    shown = F.transform(lines, lambda x, i: F.when(~trim_u(x).rlike(AVATAR), x).when(kept(i), F.concat(F.lit("<!-- Avatar: "), trim_u(x), F.lit(" -->"))))
    return unlines(F.filter(shown, lambda x: x.isNotNull()))


#: A preview's title: a service, a repository, a doubled word; and what ends it (fixed values).
SERVICE = re.compile(r"^(?:Google Docs|Notion|GitHub|Twitter|YouTube|Wikipedia|Stack Overflow)", re.I)
URL_LINE, REPO, TWICE = re.compile(r"^https?://\S+$"), re.compile(r"^[\w-]+/[\w-]+$", re.A), re.compile(r"^([A-Za-zÀ-ſ]+)\1$")
REPO_META = re.compile(r"^(Language|Last updated|Added by \[GitHub\])$", re.I)
ENDS = re.compile(r"^!?[:\[].*?[:\]]\([^)]+\)\d+|^:[a-zA-Z0-9_+-]+:$|^!\[\]\(https://ca\.slack-edge\.com/[^)]+\)$|^[A-Za-z0-9\s\-_.]+.*\[[^\]]+\]\(https?://[^)]+\)$|^\d{1,2}:\d{2}\s*(?:AM|PM)?$|^\d+\s+repl(?:y|ies)|^View thread$|^Last reply", re.I)


def _opens_preview(at: int, lines: list[str]) -> bool:
    def soon(n: int, *patterns: re.Pattern) -> bool:
        return any(p.search(x) for x in lines[at + 1 : at + n] for p in patterns)

    line = lines[at]
    if SERVICE.search(line) and soon(3, URL_LINE) or REPO.search(line) and soon(5, REPO_META):
        return True
    return len(line) > 6 and bool(TWICE.search(line)) and soon(3, URL_LINE, REPO_META)


def _preview(found: dict[str, str]) -> list[str]:
    title, url, note = (found.get(k) for k in ("title", "url", "note"))
    if not title and not url:
        return []
    head = f"[{title}]({url})" if title and url else f"<{url}>" if url else f"**{title}**"
    return [f"🔗 {head}" + (f" — _{note[:100] + '...' if len(note) > 100 else note}_" if note else "")]


def fold_previews_of(text: str) -> str:
    raw = text.split("\n")
    lines, out, found = [x.strip() for x in raw], [], None
    for i, line in enumerate(lines):
        if found is None and _opens_preview(i, lines):
            found = {}
            if SERVICE.search(line):
                found["title"] = line
                continue
        if found is None:
            out.append(raw[i])
        elif URL_LINE.search(line):
            found["url"] = line
        elif "note" not in found and 10 <= len(line) <= 500:
            found["note"] = line
        elif not line or re.search(r"^Added by \[GitHub\]$", line, re.I) or i + 1 < len(lines) and ENDS.search(lines[i + 1]):
            out += _preview(found) + ([raw[i]] if line else [])
            found = None
    return "\n".join(out + (_preview(found) if found else []))


@F.arrow_udf(T.StringType())
def _fold_previews(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else fold_previews_of(t) for t in texts.to_pylist()], pa.string())


def fold_previews(c: Column) -> Column:
    """Link-preview lines as one line. Texts without a line that can open one skip Python."""
    may = c.rlike(r"(?im)^\s*(?:Google Docs|Notion|GitHub|Twitter|YouTube|Wikipedia|Stack Overflow|[\w-]+/[\w-]+\s*$)|^\s*([A-Za-z\x{00C0}-\x{017F}]{4,})\1\s*$")
    return F.coalesce(_fold_previews(F.when(may, c)), c)


#: Names of the steps with the switch of each; None: always on.
STEPS = [
    ("sanitise", None), ("code_fences", "detect_code_blocks"), ("escape_brackets", None), ("attachments", None), ("links", "convert_links"),
    ("mentions", "convert_user_mentions"), ("emoji", "replace_emoji"), ("thread_links", "highlight_threads"),
]


def step_report(settings: Settings) -> dict[str, bool]:
    return {name: switch is None or getattr(settings, switch) for name, switch in STEPS}


@dataclass(frozen=True)
class InPython:
    """A step that runs in Python, text by text."""

    function: Callable[[str], str]


def step(name: str, settings: Settings) -> list[Callable[[Column], Column] | InPython]:
    """The functions of a step, each to be a projection of its own."""
    steps = {
        "sanitise": [InPython(nfc_of), lambda x: sanitise(x, normal_form=False)],
        "code_fences": [format_fences],
        "escape_brackets": [escape_brackets],
        "attachments": [mark_uploads, mark_images, InPython(fold_previews_of), mark_avatars, mark_services],
        "links": [convert_links],
        "mentions": [undouble_in_text, lambda x: convert_mentions(x, settings.user_map, settings.compat)],
        "emoji": [lambda x: replace_emoji(x, settings.emoji_map)],
        "thread_links": [link_threads],
    }
    return steps[name]
