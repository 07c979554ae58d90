"""Null-safe text: guards of inputs, searches that have a value for null and empty, plain fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatframe.functions.text import matches

__all__ = ["all_of", "as_list", "as_text", "first_of", "matches", "replaced", "simple_links", "simple_mentions", "split_by"]


def as_text(c: Column) -> Column:
    """Any column as text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def as_list(c: Column, of: str = "string") -> Column:
    """An array, null as empty."""
    return F.coalesce(c, F.array().cast(f"array<{of}>"))


def _some(c: Column) -> Column:
    return F.length(as_text(c)) > 0


def first_of(c: Column, pattern: str) -> Column:
    """The first match; null for null, empty and none."""
    return F.when(_some(c) & c.rlike(pattern), F.regexp_extract(c, pattern, 0))


def all_of(c: Column, pattern: str) -> Column:
    """All matches; an empty list for null, empty and none."""
    return as_list(F.when(_some(c), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))


def replaced(c: Column, pattern: str, new: str) -> Column:
    """Null gives empty."""
    return as_text(F.regexp_replace(c, pattern, new))


def split_by(c: Column, pattern: str) -> Column:
    """Parts; null and empty are one empty part."""
    return F.when(_some(c), F.split(c, pattern, -1)).otherwise(F.array(F.lit("")))


def simple_links(c: Column) -> Column:
    """Angle-bracket links as Markdown, without any check."""
    return F.regexp_replace(F.regexp_replace(c, r"<(https?://[^|>]+)\|([^>]+)>", r"[$2]($1)"), r"<(https?://[^>]+)>", "$1")


def simple_mentions(c: Column) -> Column:
    """Ids as one user, and each word behind @ as a wiki link."""
    return F.regexp_replace(F.regexp_replace(c, "<@U[A-Z0-9]+>", "@user"), r"@(\w+)", "[[$1]]")
