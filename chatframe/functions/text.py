"""Text normalisation: Column -> Column, all of it inside whole-stage codegen except NFC."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript has it: Unicode white space and the byte-order mark.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


#: A word boundary as ECMAScript has it, of ASCII words.
B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII words."""
    return pattern.replace(r"\b", B)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def trim_u(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def rtrim_u(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(trim_u(c)) == 0, F.lit(True))


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def unlines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def map_tokens(c: Column, pattern: str, f: Callable[[Column], Column], gaps: Callable[[Column], Column] = lambda g: g) -> Column:
    """Replace the matches of a pattern by ``f`` of each, and what is between them by ``gaps``:
    left to right, without overlap, and without a Python function."""

    def replaced(v: Column) -> Column:
        found = F.regexp_extract_all(v, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(F.split(v, pattern, -1), F.transform(found, f), lambda g, t: F.concat(gaps(g), F.coalesce(t, F.lit("")))), "")

    return let(c, replaced)


def strip_nul(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


def crlf_to_lf(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def strip_zero_width(c: Column) -> Column:
    """Zero-width space, joiners and the byte-order mark; joined emoji fall apart."""
    return F.regexp_replace(c, r"[\x{200B}-\x{200D}\x{FEFF}]", "")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def first_lines(c: Column, n: int) -> Column:
    """The first ``n`` lines, right-trimmed if any were cut."""
    cut = lambda ls: F.when(F.size(ls) > n, rtrim_u(unlines(F.slice(ls, 1, n)))).otherwise(unlines(ls))
    return let(lines_of(c), cut)


def preprocess(c: Column) -> Column:
    """Null to empty, NUL, CRLF, zero-width, newline runs, outer white space: in this order."""
    return trim_u(squeeze_newlines(strip_zero_width(crlf_to_lf(strip_nul(F.coalesce(c, F.lit("")))))))


def postprocess(c: Column) -> Column:
    return trim_u(F.coalesce(c, F.lit("")))


def nfc_of(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Unicode normal form C, which Spark has no function for; ASCII passes as it is."""
    return pa.array([t if t is None else nfc_of(t) for t in texts.to_pylist()], pa.string())


def straighten(c: Column) -> Column:
    """Curly quotes, dashes and the ellipsis as ASCII."""
    quotes = F.translate(c, "‘’“”", "''\"\"")
    return F.regexp_replace(F.regexp_replace(quotes, "[–—]", "--"), "…", "...")


def squeeze_spaces(c: Column) -> Column:
    """Runs of spaces before a non-space, except on indented lines and fences."""
    kept = lambda x: x.startswith("  ") | x.startswith("\t") | x.startswith("```")
    return unlines(F.transform(lines_of(c), lambda x: F.when(kept(x), x).otherwise(F.regexp_replace(x, r"  +(?=\S)", " "))))


def sanitise(c: Column, normal_form: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    return squeeze_spaces(straighten(nfc(c) if normal_form else c))


def normalise_whitespace(c: Column) -> Column:
    """Tabs and no-break spaces to spaces, runs to one, ends trimmed."""
    return trim_u(F.regexp_replace(F.translate(c, "\t ", "  "), " {2,}", " "))


def clean_text(c: Column) -> Column:
    flat = F.regexp_replace(F.translate(c, "\t ", "  "), " {2,}", " ")
    return trim_u(F.regexp_replace(flat, "\r\n|\r", "\n"))


def has_text(c: Column) -> Column:
    """Something is left without white space and C0 controls."""
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)[\s\x{FEFF}\x00-\x1F]", "")) > 0, F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """A search that is false for null and empty."""
    return F.coalesce(c.rlike(pattern), F.lit(False)) & F.coalesce(F.length(c) > 0, F.lit(False))


def either(patterns: list[str]) -> list[str]:
    """As few patterns as possible that find what any of these does: those without references to
    their own groups become one, each keeping its flags."""
    parts, apart = [], []
    for p in patterns:
        flags = re.match(r"\(\?([a-z]+)\)", p)
        body = p[flags.end() :] if flags else p
        (apart if re.search(r"\\[1-9]", body) else parts).append(f"(?{flags[1]}:{body})" if flags else f"(?:{body})")
    return ["|".join(parts)] * bool(parts) + apart


def any_match(c: Column, patterns: list[str]) -> Column:
    """One of the patterns is found."""
    found = F.lit(False)
    for p in either(patterns):
        found = found | c.rlike(ascii_words(p))
    return F.coalesce(found, F.lit(False))


def group(c: Column, pattern: str, i: int = 1) -> Column:
    """The group of the first match, null instead of empty."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
