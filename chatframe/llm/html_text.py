"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder turn markup into balanced open, text and close events, adding the
end tags that HTML implies (a paragraph ends where a block starts, an item where the next starts,
cells end with their row). A renderer then lays out what a reader sees: hidden elements are left
out, white space collapses as in a browser, blocks stand on lines of their own, paragraphs and
headings are set off by a blank line, list items carry markers and indentation, and the cells of a
table are aligned in columns, row spans included. All visible text is kept, also that of formulas,
drawings and image maps. The fallback of an object shows where no ``data`` takes its place.

Time and output are in proportion to the markup, however deep or uneven it is.
"""

from __future__ import annotations

import html
import re
import textwrap
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: The rest of a tag: quoted values are stepped over whole, and a quote opens one only after "=".
TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>""")
SPACE = re.compile(r"[ \t\n\r\f]+")
CONCEALED = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none\b")
VISIBILITY = re.compile(r"(?i)(?:^|;)\s*visibility\s*:\s*(\w+)")

#: Element classes (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes canvas audio video datalist".split())
#: Formulas and drawings; their children that no browser shows, and those that words don't run through.
FOREIGN = frozenset("svg math".split())
UNDRAWN = frozenset("desc metadata annotation annotation-xml".split())
APART = frozenset("text mtr mtd".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split())
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure ul ol dl table hr xmp".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li option optgroup legend summary".split()) | {"li"}
#: An opening tag ends these open elements, looked for up to the listed barriers.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "body": (("head",), ("html",)),
}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
CELL_GAP = "  "
#: Layout that deep or uneven markup can't multiply: indents in a line, columns' widest (longer lines go on
#: below, and inner tables are up to LAID wide), tables within tables that are aligned, and cells of a
#: grid beyond twice those that are there.
INDENTS, COLUMN, LAID, NESTED, GRID = 20, 60, 240, 64, 4096
WRAP = textwrap.TextWrapper(width=COLUMN, break_long_words=False, break_on_hyphens=False, expand_tabs=False, replace_whitespace=False)


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close; rest is the text, or an open tag's inside."""
    at, n, quoted, foreign = 0, len(text), True, 0
    while at < n:
        m = MARKUP.search(text, at)
        if m is None:
            yield "text", "", html.unescape(text[at:])
            return
        if m.start() > at:
            yield "text", "", html.unescape(text[at : m.start()])
        start = m.start()
        if m[0] == "<!--":
            end = text.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if foreign and text.startswith("<![CDATA[", start):
            end = text.find("]]>", start)
            yield "text", "", text[start + 9 : end if end >= 0 else n]
            at = n if end < 0 else end + 3
            continue
        end = text.find(">", start)
        if end < 0:  # an unfinished tag is dropped
            return
        if quoted and text[start + 1] not in "!?":
            whole = TAG_END.match(text, start)
            if whole:
                end = whole.end() - 1
            else:  # quotes that never pair up hide no text: from here on a tag ends at its first ">"
                quoted = False
        inside = text[start + 1 : end]
        at = end + 1
        if inside[0] in "!?":
            continue
        name = NAME.match(inside)[1].lower()
        if inside[0] == "/":
            foreign = max(0, foreign - (name in FOREIGN))
            yield "close", name, ""
            continue
        yield "open", name, inside[len(name) :]
        empty = inside.endswith("/")
        foreign += name in FOREIGN and not empty
        if name in RAW and not (foreign and empty):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
            end = close.start() if close else n
            body = text[at:end]
            yield "text", "raw", html.unescape(body) if name in ("textarea", "title") else body
            yield "close", name, ""
            at = n if close is None or text.find(">", end) < 0 else text.find(">", end) + 1


class Open:
    """The open elements, and where each name stands among them, so that no step looks through all
    of them."""

    def __init__(self):
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)

    def pop_to(self, n: int) -> Iterator[tuple[str, str, str]]:
        """Close the elements from place ``n`` on, innermost first."""
        while len(self.stack) > n:
            name = self.stack.pop()
            self.at[name].pop()
            yield "close", name, ""

    def last(self, *names: str) -> int:
        """The innermost place of any of the names, or -1."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def first_after(self, wall: int, *names: str) -> int:
        """The outermost place of any of the names beyond ``wall``, or -1."""
        found = -1
        for x in names:
            places = self.at.get(x, ())
            k = bisect_right(places, wall)
            if k < len(places) and (found < 0 or places[k] < found):
                found = places[k]
        return found


def events(text: str) -> Iterator[tuple[str, str, str]]:
    """Balanced events, with implied end tags."""
    o = Open()
    for kind, name, rest in tokens(text):
        head = o.stack and o.stack[-1] == "head"
        if kind == "text":
            if head and rest.strip():
                yield from o.pop_to(len(o.stack) - 1)
            yield kind, name, rest
        elif kind == "open":
            if head and name not in HEAD_ONLY:
                yield from o.pop_to(len(o.stack) - 1)
            if name in IMPLIED:
                ends, barriers = IMPLIED[name]
                place = o.first_after(o.last(*barriers), *ends)
                if place >= 0:
                    yield from o.pop_to(place)
            if name in ENDS_P:
                place = o.last("p")
                if place > o.last("td", "th", "table", "li", "object", "button", "caption"):
                    yield from o.pop_to(place)
            yield kind, name, rest
            if name in VOID or rest.endswith("/") and name not in BLOCK:
                yield "close", name, ""
            else:
                o.push(name)
        else:
            place = o.last(name)
            # a stray end tag inside a table doesn't close what is around it
            if place >= 0 and (name in ("td", "th", "tr", "table", "body", "html") or o.last("table") < place):
                yield from o.pop_to(place)
    yield from o.pop_to(0)


class Flow:
    """Lines of one column of text: the page's, or a cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.blank = False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.line.append(first)
            for x in rest:
                self.end_line(keep=True)
                self.line.append(x)
            return
        parts = SPACE.split(s)
        if len(parts) == 1:
            if parts[0]:
                self._word(parts[0])
            return
        if not parts[0]:
            self.gap = True
        else:
            self._word(parts[0])
            self.gap = True
        body = " ".join(p for p in parts[1:] if p)
        if body:
            self._word(body)
            self.gap = not parts[-1]

    def _word(self, s: str) -> None:
        if self.gap and self.line:
            self.line.append(" ")
        self.gap = False
        self.line.append(s)

    def end_line(self, keep: bool = False) -> None:
        s = "".join(self.line).replace("\xa0", " ").rstrip()
        self.line, self.gap = [], False
        if s or keep:
            self.put(s)

    def put(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        pad = "".join(self.indent[:INDENTS])
        if self.marker:
            pad = pad[: -len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append(type(s)((pad + s).rstrip()))

    def block(self, set_off: bool) -> None:
        self.end_line()
        if set_off and self.lines:
            self.blank = True

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells, each (lines, columns spanned, rows spanned)."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def grid(self) -> list[list[tuple[int, int, list[str]]]] | None:
        """(column, columns spanned, lines) of each row's cells, below what spans from above; None if
        the spans make a grid that is mostly empty."""
        most, cells = 0, sum(map(len, self.rows))
        out, busy = [], {}
        for row in self.rows:
            at, placed = 0, []
            for lines, span, down in row:
                while at in busy:
                    at += 1
                placed.append((at, span, lines))
                if down != 1:
                    busy |= dict.fromkeys(range(at, at + span), down or len(self.rows))
                at += span
            most = max(most, at, len(busy))
            if most * len(self.rows) > 2 * cells + GRID:
                return None
            out.append(placed)
            busy = {c: n - 1 for c, n in busy.items() if n > 1}
        return out

    def lines(self) -> list[str]:
        """The table's lines, in columns as wide as their widest cell of one column. Lines longer than
        COLUMN go on below, between words. Where aligning would mostly add blanks, cells follow each
        other, so that what comes out is in proportion to what went in."""
        grid = self.grid()
        if grid is None:
            return [line for row in self.rows for line in _beside([(lines, 0) for lines, _, _ in row])]
        widths: dict[int, int] = {}
        for row in grid:
            for at, span, lines in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), max(map(_asked, lines), default=0))
        out = []
        for row in grid:
            cells, at = [], 0
            for column, span, lines in row:
                cells += [([], widths.get(c, 0)) for c in range(at, column)]
                cells.append((_wrapped(lines), sum(widths.get(c, 0) for c in range(column, column + span)) + len(CELL_GAP) * (span - 1)))
                at = column + span
            out += _beside(cells)
        return out


class Laid(str):
    """A line of a table: it isn't broken where it stands in a cell."""


def _asked(line: str) -> int:
    """The width that a line wants its column to have."""
    return min(LAID if isinstance(line, Laid) else COLUMN, len(line))


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of a cell that are longer than COLUMN, cut between words."""
    if not any(len(x) > COLUMN for x in lines):
        return lines
    return [y for x in lines for y in ([x] if len(x) <= COLUMN or isinstance(x, Laid) else WRAP.wrap(x) or [""])]


def _beside(cells: list[tuple[list[str], int]]) -> list[str]:
    """Cells (lines, width) side by side, or one below the other where few of them have a line. Behind a
    line that is wider than its column the row goes on below, so that columns stay aligned."""
    tall, every = max((len(lines) for lines, _ in cells), default=0), sum(len(lines) for lines, _ in cells)
    wide = sum(len(x) > width for lines, width in cells[:-1] for x in lines)
    if (tall + wide) * len(cells) > 8 * every + 64:
        return [Laid(x) for lines, _ in cells for x in lines]
    out = []
    for k in range(tall):
        line: list[str] = []
        for i, (lines, width) in enumerate(cells):
            x = lines[k] if k < len(lines) else ""
            line.append(x.ljust(width))
            if len(x) > width and any(k < len(later) and later[k] for later, _ in cells[i + 1 :]):
                out.append(CELL_GAP.join(line))
                line = [" " * w for _, w in cells[: i + 1]]
        out.append(CELL_GAP.join(line))
    return [Laid(x.rstrip()) for x in out]


def _attributes(rest: str) -> dict[str, str]:
    """Of attributes with one name the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return found


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,6}", value) else default


def _sight(a: dict[str, str]) -> bool | None:
    """What an element says of its own visibility: inherited, unless an inner element says other."""
    found = VISIBILITY.findall(a["style"]) if "style" in a else []
    said = (found[-1] if found else a.get("visibility", "")).lower()
    return True if said == "visible" else False if said in ("hidden", "collapse") else None


def render(markup: str) -> str:
    """The visible text of a page, laid out; an empty string for markup without any."""
    flows, tables, lists = [Flow()], [], []
    unseen, pre, foreign, flat, visible, details = 0, 0, 0, 0, True, []
    opened: list[tuple[str, bool, bool, bool]] = []  # name, hidden with all inside, laid out as a table's part, what was visible before
    for kind, name, rest in events(markup):
        flow = flows[-1]
        if kind == "text":
            if visible and not unseen and not (details and not details[-1][0] and details[-1][1] == len(opened)):
                flow.text(rest.lstrip("\n") if pre and not flow.line and name == "raw" else rest, pre > 0)
            continue
        if kind == "open":
            a = _attributes(rest) if rest and not rest.isspace() else {}
            hide = name in UNSEEN or "hidden" in a or ("style" in a and bool(CONCEALED.search(a["style"]))) or (name == "dialog" and "open" not in a) or (name == "object" and "data" in a)
            foreign += name in FOREIGN
            if foreign:
                hide = hide or name in UNDRAWN or a.get("display") == "none"
            inside = details and details[-1][1] == len(opened) and name != "summary"
            hide = hide or bool(inside and not details[-1][0])
            opened.append((name, hide, False, visible))
            if "style" in a or foreign:
                said = _sight(a)
                visible = visible if said is None else said
            if name == "details":
                details.append(("open" in a, len(opened)))
            if hide:
                unseen += 1
            if unseen:
                continue
            in_table = tables and not flat
            if foreign and name in APART:
                flow.gap = True
            if name == "br":
                if visible:
                    flow.end_line(keep=True)
            elif name in ("pre", "textarea", "xmp"):
                pre += 1
                flow.block(name != "textarea")
            elif name in ("td", "th"):
                if not in_table:
                    flow.block(False)
                else:
                    rows = tables[-1].rows
                    if not rows:
                        rows.append([])
                    rows[-1].append(([], max(1, min(1000, _number(a.get("colspan"), 1))), max(0, min(65534, _number(a.get("rowspan"), 1)))))
                    flows.append(Flow())
                    opened[-1] = (name, hide, True, opened[-1][3])
            elif name == "tr" and in_table:
                tables[-1].rows.append([])
            elif name == "table":
                flow.block(True)
                if flat or len(tables) >= NESTED:
                    flat += 1
                else:
                    tables.append(Table())
                opened[-1] = (name, hide, True, opened[-1][3])
            elif name in BLOCK and not (name in ("thead", "tbody", "tfoot") and in_table):
                flow.block(name in SET_OFF and not (lists and name in ("ul", "ol")))
                if name in ("ul", "ol", "menu", "dir"):
                    lists.append([name, _number(a.get("start"), 1)])
                elif name == "li":
                    number = ""
                    if lists and lists[-1][0] == "ol":
                        number = f"{_number(a.get('value'), lists[-1][1])}. "
                        lists[-1][1] = _number(a.get("value"), lists[-1][1]) + 1
                    flow.marker = number or "- "
                    flow.indent.append(" " * len(flow.marker))
                elif name in ("dd", "blockquote"):
                    flow.indent.append("  ")
            continue
        if not opened:
            continue
        _, hide, own, visible = opened.pop()
        foreign -= name in FOREIGN
        if name == "details" and details:
            details.pop()
        if unseen:
            unseen -= hide
            continue
        in_table = tables and not flat
        if foreign and name in APART:
            flow.gap = True
        if own and name in ("td", "th"):
            rows = tables[-1].rows
            rows[-1][-1] = (flows.pop().finish(), *rows[-1][-1][1:])
        elif own and name == "table":
            if flat:
                flat -= 1
            else:
                for line in tables.pop().lines():
                    flow.put(line)
            flow.block(True)
        elif name in ("pre", "textarea", "xmp"):
            flow.block(name != "textarea")
            pre -= 1
        elif name in BLOCK and not (name in ("thead", "tbody", "tfoot", "tr") and in_table):
            flow.block(name in SET_OFF and not (len(lists) > 1 and name in ("ul", "ol")))
            if name in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif name in ("li", "dd", "blockquote") and flow.indent:
                flow.indent.pop()
                flow.marker = ""
    while len(flows) > 1:
        lines = flows.pop().finish()
        for line in lines:
            flows[-1].put(line)
    return "\n".join(flows[0].finish()).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines): one row for each input row, repeated rows included. Null
    markup gives a null text and zeros, empty markup an empty text. Pages are rendered whole, each
    by itself; other columns are not carried; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else render(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    base = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    out = base.mapInArrow(run, f"page_id {base.schema[0].dataType.simpleString()}, text string")
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    return out.select("page_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
