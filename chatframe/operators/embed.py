"""What is embedded in a message: link previews, files, quoted messages and reaction runs.

Where a block ends depends on where the one before ended, so a cursor walks over a message's lines;
what a line is comes from patterns. It runs as an Arrow function over the text column alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of blocks and their priority when two of them are alike (fixed values).
PRIORITY = {"quoted_message": 4, "file_attachment": 3, "link_preview": 2, "metadata": 1, "reactions": 0, "continuation": 0}
#: Patterns of trimmed lines (fixed values).
URL = re.compile(r"^https?://\S+$")
FILE = re.compile(r"^\[(.*)\]\((.*)\)$|^(\S+\.(pdf|doc|docx|zip|png|jpg|jpeg|gif))$", re.I)
FILE_KIND = re.compile(r"^(?:PDF|Doc|Zip|Google Doc|\d+ files?)$", re.I)
QUOTE = re.compile(r"^([A-Za-z\s]+\s+\[[0-9:]+\s*(AM|PM)?\])$")
TITLE = re.compile(r"^[A-Z][a-z\s]*[a-z]$|^(?:Google Doc|PDF|Zip)$")
REACTIONS = re.compile(r"^:[^:]+:\s*\d+$|^[\d\s]+$")
NEW_MESSAGE = re.compile(r"^\d{1,2}:\d{2}|^[A-Z][a-z]+ [A-Z][a-z]+")
LOOK_AHEAD, FILE_AHEAD = 5, 10
KIND = pa.struct([("blocks", pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("url", pa.string()), ("filename", pa.string())]))), ("cleaned", pa.string())])
BLOCK = T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("type", "content", "start", "end", "url", "filename")])
SCHEMA = T.StructType([T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("cleaned", T.StringType())])


def _run(lines: list[str], start: int, ahead: int, fits) -> int:
    """The last of the lines after ``start`` that are blank or fit."""
    end = start
    for i in range(start + 1, min(len(lines), start + ahead)):
        if lines[i] and not fits(lines[i]):
            break
        end = i
    return end


def _describes(x: str) -> bool:
    return bool(TITLE.search(x)) or len(x) < 60 and x[:1].isascii() and x[:1].isupper() or 20 < len(x) < 200 and "[" not in x and "http" not in x


def _is_file(x: str) -> bool:
    return bool(FILE.search(x)) or "files.slack.com" in x or "download/" in x


def _is_quote(x: str) -> bool:
    return bool(QUOTE.search(x)) and len(x) < 100 and x[0].isupper()


def _files(lines: list[str], start: int) -> list[int]:
    """Lines of a file block: others before the first file line are passed over."""
    found: list[int] = []
    for i in range(start, min(len(lines), start + FILE_AHEAD)):
        if not lines[i]:
            found += [i] if found else []
        elif _is_file(lines[i]) or FILE_KIND.search(lines[i]):
            found.append(i)
        elif found:
            break
    return found


def analyse(text: str) -> dict:
    """{blocks, cleaned}: blocks in order, and the text without them."""
    raw = text.split("\n")
    lines, blocks, kept, i = [x.strip() for x in raw], [], [], 0
    while i < len(lines):
        line, kind, end, at = lines[i], "", i, None
        if line:
            if URL.search(line) and (end := _run(lines, i, LOOK_AHEAD, _describes)) > i:
                kind = "link_preview"
            elif at := _files(lines, i):
                kind, end = "file_attachment", at[-1]
            elif _is_quote(line):
                kind, end = "quoted_message", _run(lines, i, LOOK_AHEAD, lambda x: len(x) < 200 and "http" not in x and not NEW_MESSAGE.search(x))
            elif REACTIONS.search(line):
                kind, end = "reactions", _run(lines, i, LOOK_AHEAD, REACTIONS.search)
        if not kind:
            kept.append(raw[i])
            i += 1
            continue
        body = [raw[k] for k in at] if at else [line if kind == "link_preview" else raw[i], *raw[i + 1 : end + 1]]
        content = "\n".join(body)
        url = re.search(r"https?://[^\s)]+", content) if kind in ("link_preview", "file_attachment") else None
        name = re.search(r"([^/\s]+\.\w+)", content) if kind == "file_attachment" else None
        blocks.append({"type": kind, "content": content, "start": i, "end": end, "url": url and url[0], "filename": name and name[1]})
        i = end + 1
    return {"blocks": blocks, "cleaned": "\n".join(kept).strip()}


@F.arrow_udf(SCHEMA)
def _analyse(texts: pa.Array) -> pa.Array:
    return pa.array([analyse(t or "") for t in texts.to_pylist()], KIND)


def embedded(c: Column) -> Column:
    """A struct (blocks, cleaned) of a text; null counts as empty."""
    return _analyse(c)
