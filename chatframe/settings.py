"""Settings of a run, and the string maps that come as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """All switches of the pipeline. Python values: a switched-off step never enters a plan."""

    detect_code_blocks: bool = True
    convert_user_mentions: bool = True
    replace_emoji: bool = True
    parse_times: bool = True  # no effect on results
    highlight_threads: bool = True
    convert_links: bool = True
    user_map_json: str = "{}"
    emoji_map_json: str = "{}"
    hotkey_mode: str = "cmdShiftV"
    max_lines: int = 5000
    enable_preview_pane: bool = True
    enable_confirmation_dialog: bool = False
    show_success_message: bool = True
    collapse_threads: bool = True  # no effect on results
    thread_collapse_threshold: int = 10  # no effect on results
    frontmatter_css_class: str = "slack-conversation"
    frontmatter_title: str = ""
    time_zone: str = ""
    debug: bool = False
    compat: bool = False  # reproduce quirks: masked spaces in mentions, links and emoji converted again at rendering
    phrases: tuple[str, ...] = ()  # further patterns of lines that carry on a message

    @property
    def user_map(self) -> dict[str, str]:
        return parse_json_map(self.user_map_json) or {}

    @property
    def emoji_map(self) -> dict[str, str]:
        return parse_json_map(self.emoji_map_json) or {}


def load_settings(stored: Mapping[str, Any] | None = None) -> Settings:
    """Defaults overlaid by stored values; unknown keys and nulls are left out."""
    names = {f.name for f in fields(Settings)}
    return replace(Settings(), **{k: v for k, v in (stored or {}).items() if k in names and v is not None})


def parse_json_map(text: str | None) -> dict[str, str] | None:
    """A JSON object of strings as a dict: blank gives {}, anything else that isn't one gives None."""
    if not text or not text.strip():
        return {}
    try:
        value = json.loads(text)
    except ValueError:
        return None
    if not isinstance(value, dict) or not all(isinstance(v, str) for v in value.values()):
        return None
    return value
