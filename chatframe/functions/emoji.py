"""Emoji codes, images and reactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatframe.functions.text import group, let, map_tokens, trim_u

#: Emoji by name (fixed values).
EMOJI = {
    "smile": "😄", "grin": "😁", "joy": "😂", "smiley": "😃", "wink": "😉", "blush": "😊", "heart_eyes": "😍", "thinking": "🤔",
    "neutral_face": "😐", "worried": "😟", "cry": "😢", "sob": "😭", "wave": "👋", "ok_hand": "👌", "thumbsup": "👍", "+1": "👍",
    "thumbsdown": "👎", "-1": "👎", "clap": "👏", "pray": "🙏", "muscle": "💪", "raised_hands": "🙌", "heart": "❤️", "star": "⭐",
    "sparkles": "✨", "fire": "🔥", "check": "✅", "white_check_mark": "✅", "x": "❌", "no_entry": "⛔", "warning": "⚠️", "bulb": "💡",
    "gift": "🎁", "birthday": "🎂", "spiral_calendar_pad": "🗓️", "computer": "💻", "iphone": "📱", "keyboard": "⌨️", "camera": "📷",
    "tv": "📺", "slightly_smiling_face": "🙂", "shrug": "🤷", "facepalm": "🤦", "eyes": "👀", "brain": "🧠", "hugs": "🤗",
    "thinking_face": "🤔",
}
#: Names that have an image in the CDN (fixed values).
IMAGE_NAMES = ["no_entry", "pray", "heart", "spiral_calendar_pad", "thumbsup", "thumbsdown", "joy", "smile", "wink", "blush", "heart_eyes",
               "cry", "sob", "thinking", "wave", "ok_hand", "clap", "muscle", "raised_hands", "star", "sparkles", "fire", "white_check_mark",
               "x", "warning", "bulb", "gift", "birthday", "computer", "iphone", "keyboard", "camera", "tv", "slightly_smiling_face",
               "shrug", "facepalm", "eyes", "brain", "hugs"]
#: Code points, joined by hyphens, of the images: those of the emoji itself.
IMAGES = {"-".join(f"{ord(ch):x}" for ch in EMOJI[n]): n for n in IMAGE_NAMES} | {"1f614": "pensive"}

CODE = r":([a-zA-Z0-9_+-]+):"
NAMED_IMAGE = r"!\[:([a-zA-Z0-9_+-]+):\]\(([^)]+)\)"
BARE_IMAGE = r"!\[\]\(https://[ae]\.(?:slack-edge\.com|emoji\.slack-edge\.com)[^)]+\)"
ASSET = r"production-standard-emoji-assets/[\d.]+/[^/]+/([a-f0-9-]+)(?:@\d+x)?\.png"
PICTURES = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F000}-\x{1F02F}\x{1F0A0}-\x{1F0FF}\x{1F100}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{3000}-\x{303F}]"
#: Host and path words that a paste may have split (fixed values).
SPLIT_HOSTS = [(r"(?i)https://slack\s+imgs\.com", "https://slack-imgs.com"), (r"(?i)https://([ae])\.slack\s+edge\.com", "https://$1.slack-edge.com"),
               (r"(?i)https://emoji\.slack\s+edge\.com", "https://emoji.slack-edge.com"), (r"(?i)production\s+standard\s+emoji\s+assets", "production-standard-emoji-assets"),
               (r"(?i)apple\s+large", "apple-large")]
#: What those without a colon need.
SPLIT_PATH = r"(?i)standard\s+emoji|apple\s+large"


def literal_map(values: Mapping[str, str]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def merged(custom: Mapping[str, str] | None) -> dict[str, str]:
    return {**EMOJI, **(custom or {})}


def _image(url: Column, name: Column | None, names: Column) -> Column:
    """The emoji of an image: by its name, by its code points, or its name as a code."""
    standard = F.try_element_at(literal_map(IMAGES), F.regexp_extract(url, ASSET, 1))
    by_url = F.coalesce(F.try_element_at(names, standard), F.concat(F.lit(":"), standard, F.lit(":")))
    if name is not None:
        return F.coalesce(F.try_element_at(names, name), by_url, F.concat(F.lit(":"), name, F.lit(":")))
    file = group(url, r"/([a-zA-Z0-9_-]+)\.[a-z]+$")
    return F.coalesce(by_url, F.try_element_at(names, file), F.concat(F.lit(":"), file, F.lit(":")), F.lit(":emoji:"))


def replace_emoji(c: Column, custom: Mapping[str, str] | None = None) -> Column:
    """Codes and emoji images as emoji; unknown codes stay. Custom names override the defaults. What has
    no colon and no split host or path passes as it is."""
    names = literal_map(merged(custom))

    def replaced(v: Column) -> Column:
        for pattern, fixed in SPLIT_HOSTS:
            v = F.regexp_replace(v, pattern, fixed)
        v = map_tokens(v, NAMED_IMAGE, lambda t: _image(F.regexp_extract(t, NAMED_IMAGE, 2), F.regexp_extract(t, NAMED_IMAGE, 1), names))
        v = map_tokens(v, BARE_IMAGE, lambda t: _image(F.regexp_extract(t, r"!\[\]\(([^)]+)\)", 1), None, names))
        return map_tokens(v, CODE, lambda t: F.coalesce(F.try_element_at(names, F.regexp_extract(t, CODE, 1)), t))

    return let(c, lambda v: F.when(v.contains(":") | v.rlike(SPLIT_PATH), replaced(v)).otherwise(v))


def format_reactions(reactions: Column, custom: Mapping[str, str] | None = None) -> Column:
    """``emoji count`` for each (name, count), joined by spaces; unknown names as codes."""
    names = literal_map(merged(custom))
    shown = lambda r: F.concat_ws(" ", F.coalesce(F.try_element_at(names, r["name"]), F.concat(F.lit(":"), r["name"], F.lit(":"))), r["count"].cast("string"))
    return F.coalesce(F.array_join(F.transform(reactions, shown), " "), F.lit(""))


def remove_emoji(c: Column) -> Column:
    """Without images, codes and pictures; white space collapses."""
    for pattern in (r"!\[:[a-zA-Z0-9_+-]+:\]\([^)]+\)", BARE_IMAGE, CODE, PICTURES):
        c = F.regexp_replace(c, pattern, "")
    return trim_u(F.regexp_replace(c, r"\s+", " "))


def contains_emoji(c: Column) -> Column:
    return F.coalesce(c.rlike(f"{NAMED_IMAGE}|{BARE_IMAGE}|{CODE}|{PICTURES}"), F.lit(False))


def emoji_codes(c: Column) -> Column:
    """Distinct names: of named images, then of CDN images by their code points, then of codes."""
    named = F.regexp_extract_all(c, F.lit(NAMED_IMAGE), F.lit(1))
    assets = F.transform(F.regexp_extract_all(c, F.lit(ASSET), F.lit(1)), lambda p: F.try_element_at(literal_map(IMAGES), p))
    codes = F.regexp_extract_all(F.regexp_replace(c, NAMED_IMAGE, ""), F.lit(CODE), F.lit(1))
    return F.coalesce(F.array_distinct(F.filter(F.concat(named, assets, codes), lambda x: x.isNotNull())), F.array().cast("array<string>"))


def clean_emoji_from_name(c: Column) -> Column:
    return remove_emoji(c)
