"""Dates and clock times in pasted text. Nothing reads the wall clock: relative words and missing
years go by an explicit reference timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatframe.functions.emoji import literal_map
from chatframe.functions.text import group, let, trim_u

#: Month names and their numbers (fixed values).
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
          "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
CLOCK = r"(\d{1,2}):(\d{2})\s*(AM|PM)?"
MONTH_DAY = rf"(?i)({'|'.join(sorted(MONTHS, key=len, reverse=True))})[\s.]*(\d{{1,2}})(?:st|nd|rd|th)?"
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?$"


def month_number(name: Column) -> Column:
    return F.try_element_at(literal_map({k: str(v) for k, v in MONTHS.items()}), F.lower(name)).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def parse_date(c: Column, ref: Column) -> Column:
    """``YYYY-M-D``, or month and day with a year after a comma, else the year of ``ref``."""
    x = trim_u(c)
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    year = F.coalesce(group(x, r",\s*(\d{4})$").cast("int"), F.year(ref))
    named = _day(year, month_number(group(x, MONTH_DAY, 1)), group(x, MONTH_DAY, 2))
    return F.when(x.rlike(ymd), _day(group(x, ymd, 1), group(x, ymd, 2), group(x, ymd, 3))).otherwise(named)


def _minutes(x: Column, pattern: str, first: int) -> Column:
    """Minutes since midnight of the clock whose groups start at ``first``."""
    hour, minute, half = group(x, pattern, first).cast("int"), group(x, pattern, first + 1).cast("int"), F.upper(group(x, pattern, first + 2))
    hour = F.when((half == "PM") & (hour != 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    return hour * 60 + minute


def _at(day: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, day.cast("date").cast("timestamp"))


def parse_timestamp(c: Column, ref: Column, context: Column | None = None) -> Column:
    """A timestamp, or null: ISO forms, today, yesterday and weekdays (before ``ref``; the same
    weekday is a week ago), a clock, month and day with or without clock, explicit years. A clock
    alone is on the day of ``context``, else of ``ref``."""
    return let(F.regexp_replace(trim_u(c), r"^[\[(]|[\])]$", ""), lambda x: _parse(x, ref, context))


def _parse(x: Column, ref: Column, context: Column | None) -> Column:
    base = F.coalesce(context, ref) if context is not None else ref
    today = F.to_date(ref)
    named_day = rf"(?i)^({'|'.join(WEEKDAYS)})(?:\s+at\s+{CLOCK})?$"
    target = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(group(x, named_day))).cast("int")
    ago = F.pmod(F.dayofweek(today) - target - 1, F.lit(7)) + 1
    month_time, month_only = rf"(?i)^(\w+)\s+(\d{{1,2}})(?:st|nd|rd|th)?\s+at\s+{CLOCK.rstrip('?')}$", r"(?i)^(\w+)\s+(\d{1,2})(?:st|nd|rd|th)?$"
    dated = rf"(?i)^(\w+\s+\d+(?:st|nd|rd|th)?),\s*(\d{{4}})(?:\s+at\s+{CLOCK.rstrip('?')})?$"
    of = lambda p: _month_day(base, group(x, p, 1), group(x, p, 2))
    return (
        F.when(x.rlike(ISO), F.try_to_timestamp(F.regexp_replace(x, "Z$", "")))
        .when(x.rlike(rf"(?i)^Today\s+at\s+{CLOCK}$"), _at(today, _minutes(x, rf"(?i)^Today\s+at\s+{CLOCK}$", 1)))
        .when(x.rlike(rf"(?i)^Yesterday\s+at\s+{CLOCK}$"), _at(F.date_sub(today, 1), _minutes(x, rf"(?i)^Yesterday\s+at\s+{CLOCK}$", 1)))
        .when(x.rlike(named_day), _at(F.date_sub(today, ago), F.coalesce(_minutes(x, named_day, 2), F.lit(0))))
        .when(x.rlike(rf"(?i)^{CLOCK}$"), _at(base, _minutes(x, rf"(?i)^{CLOCK}$", 1)))
        .when(x.rlike(month_time) & month_number(group(x, month_time)).isNotNull(), _at(of(month_time), _minutes(x, month_time, 3)))
        .when(x.rlike(month_only) & month_number(group(x, month_only)).isNotNull(), of(month_only).cast("timestamp"))
        .when(x.rlike(r"(?i)^\d{1,2}:\d{2}:\d{2}\s*(AM|PM)?$"), F.timestamp_add("SECOND", group(x, r"^\d{1,2}:\d{2}:(\d{2})").cast("int"), _at(base, _minutes(F.regexp_replace(x, r"^(\d{1,2}:\d{2}):\d{2}", "$1"), rf"(?i)^{CLOCK}$", 1))))
        .when(x.rlike(dated), _at(parse_date(F.concat_ws(", ", group(x, dated, 1), group(x, dated, 2)), ref), F.coalesce(_minutes(x, dated, 3), F.lit(0))))
    )


def _month_day(base: Column, month: Column, day: Column) -> Column:
    """Month and day in the year of ``base``; days beyond the month roll over."""
    first = _day(F.year(base), month_number(month), F.lit(1))
    return F.date_add(first, day.cast("int") - 1)


def format_clock(ts: Column, zone: str = "") -> Column:
    """``h:mm AM``; ``zone`` shifts from UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone) if zone else ts, "h:mm a")


def display_time(c: Column, ref: Column, context: Column | None = None, zone: str = "") -> Column:
    """What a message shows as its time: the clock if the text parses, else its label as it is."""
    label = F.coalesce(group(c, r"\[([^\]]+)\]\(https?://[^)]+\)"), c)
    shown = let(label, lambda x: F.coalesce(format_clock(parse_timestamp(x, ref, context), zone), x))
    return F.when(c.isNull() | (c == ""), "").otherwise(shown)
