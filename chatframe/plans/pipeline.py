"""The whole way from pasted text to notes: composition of the operators, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.text import first_lines, lines_of, postprocess, preprocess
from chatframe.operators.chunks import CHUNK, chunked_features, chunked_intervals, own_lines
from chatframe.operators.continuation import fold_continuations
from chatframe.operators.dedup import drop_equal_messages, drop_repeated_blocks, drop_similar_messages
from chatframe.operators.detect import admission_error, admission_warning, classify, is_likely_chat
from chatframe.operators.diagnostics import Log, steps_taken, with_appendix
from chatframe.operators.enrich import enrich_messages
from chatframe.operators.extract import LINE_COLUMNS, extract_messages
from chatframe.operators.fallback import fallback_messages, quality
from chatframe.operators.lines import explode_lines
from chatframe.operators.render import failure_note, join_blocks, notes, preview_line, render_conversations
from chatframe.operators.segment import INTERVAL_COLUMNS, header_segments, primary_intervals, primary_lines
from chatframe.operators.stats import conversation_stats, with_defaults
from chatframe.schema import UNKNOWN_USER
from chatframe.settings import Settings
from chatframe.storage import store

REF = "2024-06-15 12:00:00"
MESSAGE = ["conv_id", "msg_idx", "username", "ts_text", "text", "thread_info", "reactions", "start_line", "end_line"]


def normalise(conversations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(conv_id, raw) normalised: characters, newlines, repeated blocks, most lines."""
    settings = settings or Settings()
    rows = drop_repeated_blocks(conversations.select("conv_id", preprocess(F.col("raw")).alias("raw")))
    return rows.select("conv_id", first_lines(F.col("raw"), settings.max_lines).alias("raw"))


def admitted(conversations: DataFrame) -> DataFrame:
    """Conversations within the bounds of admission, which parsers rely on: one of them is a group."""
    return conversations.where(admission_error(F.coalesce("raw", F.lit(""))).isNull())


def parse_headers(conversations: DataFrame) -> DataFrame:
    rows = header_segments(conversations)
    return rows.withColumns({"thread_info": F.lit(None).cast("string"), "reactions": F.array().cast("array<struct<name:string,count:int>>")}).select(*MESSAGE)


def parse_primary(conversations: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Messages by the primary parser."""
    lines = primary_lines(conversations, phrases=settings.phrases if settings else ())
    lines = store(lines.select(*dict.fromkeys([*INTERVAL_COLUMNS, *LINE_COLUMNS])), "lines")  # intervals and messages read them
    return extract_messages(lines, primary_intervals(lines)).select(*MESSAGE)


def parse_chunked(conversations: DataFrame, settings: Settings | None = None, size: int = CHUNK) -> DataFrame:
    """What ``parse_primary`` gives, with a conversation's lines dealt out over tasks by chunks."""
    seen = chunked_features(conversations, size, settings.phrases if settings else ())
    seen = store(seen.select(*dict.fromkeys([*INTERVAL_COLUMNS, *LINE_COLUMNS])), "lines")
    return extract_messages(own_lines(seen), chunked_intervals(seen)).select(*MESSAGE)


def parse_fallback(conversations: DataFrame, ref: Column | None = None) -> DataFrame:
    """Messages by the fallback parser."""
    return fallback_messages(conversations, ref if ref is not None else F.lit(REF).cast("timestamp")).select(*MESSAGE)


def parse(conversations: DataFrame, settings: Settings | None = None, ref: Column | None = None) -> DataFrame:
    """Primary messages, and the fallback parser's of the conversations that fail the quality gate."""
    return parse_gated(conversations, settings, ref)[0]


def parse_gated(conversations: DataFrame, settings: Settings | None = None, ref: Column | None = None, log: Log | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages, and the conversations (conv_id) whose messages are the fallback parser's. The parse is
    stored once, and so is the gate: both are read more than once."""
    log = log or Log()
    primary = log.stored(parse_primary(conversations, settings), "primary", messages=("info", F.count("*")), unknown_users=("warn", F.count_if(F.col("username") == UNKNOWN_USER)))
    gate = log.stored(quality(conversations, primary).where("use_fallback").select("conv_id"), "fallback", conversations=("warn", F.count("*")))
    other = parse_fallback(conversations.join(gate, "conv_id", "left_semi"), ref)
    return primary.join(gate, "conv_id", "left_anti").unionByName(other), gate


@dataclass(frozen=True)
class Result:
    messages: DataFrame
    formats: DataFrame
    rendered: DataFrame
    stats: DataFrame


def run(conversations: DataFrame, settings: Settings | None = None, ref: Column | None = None, fast: bool = False, log: Log | None = None) -> Result:
    """All stages; what several of them read is stored in the shared folder, and ``log`` counts while it
    is written. ``fast`` takes the plain-header segmenter for all. Conversations refused on admission
    render as their error. With ``settings.debug`` each has an appendix: steps, unparsed lines, warnings."""
    settings = settings or Settings()
    log, debug = log or Log(settings.debug), settings.debug
    ref = ref if ref is not None else F.lit(REF).cast("timestamp")
    checked = conversations.select("conv_id", F.coalesce("raw", F.lit("")).alias("raw")).withColumn("error", admission_error(F.col("raw")))
    counted = log.watch(
        checked, "admission", conversations=("info", F.count("*")), characters=("debug", F.sum(F.length("raw"))), refused=("error", F.count_if(F.col("error").isNotNull())),
        large=("warn", F.count_if(F.col("error").isNull() & admission_warning(F.col("raw")).isNotNull())),
    )
    accepted = log.stored(normalise(counted.where("error is null"), settings), "normal", characters=("debug", F.sum(F.length("raw"))))
    formats = classify(accepted)
    found, fallback = (parse_headers(accepted), None) if fast else parse_gated(accepted, settings, ref, log)
    parsed = drop_equal_messages(found)
    parsed = store(parsed, "parsed") if debug else parsed
    folded = log.stored(fold_continuations(parsed, settings.phrases), "folded", messages=("info", F.count("*")), without_time=("warn", F.count_if(F.coalesce(F.col("ts_text"), F.lit("")) == "")))
    distinct = drop_similar_messages(folded)
    distinct = store(distinct, "distinct") if debug else distinct
    found = log.stored(enrich_messages(distinct, settings), "messages", messages=("info", F.count("*")), characters=("debug", F.sum(F.length("text"))), unknown_users=("warn", F.count_if(F.col("username") == UNKNOWN_USER)))
    rendered = render_conversations(found, formats, ref, settings)
    if debug:
        formats = store(formats, "formats")
        joined = store(join_blocks(found, formats, ref, settings), "joined").select("conv_id", "joined", postprocess(F.col("joined")).alias("markdown"))
        normal = checked.where("error is null").select("conv_id", "raw", preprocess(F.col("raw")).alias("normal"))
        truncated = normal.select("conv_id", F.when(F.size(lines_of(F.col("normal"))) > settings.max_lines, settings.max_lines).alias("truncated"))
        steps = steps_taken(truncated, formats, parsed, folded, distinct, fallback, joined.select("conv_id", (F.col("joined") != F.col("markdown")).alias("postprocessed")))
        rendered = with_appendix(joined.select("conv_id", "markdown"), steps, explode_lines(normal), distinct, found)
    refused = checked.where("error is not null").select("conv_id", F.col("error").alias("markdown"))
    return Result(found, formats, rendered.unionByName(refused), with_defaults(conversations, conversation_stats(found, formats)))


def build_notes(conversations: DataFrame, date: str, settings: Settings | None = None, fast: bool = False) -> DataFrame:
    result = run(conversations, settings, fast=fast)
    return notes(result.rendered, result.stats, date, settings)


def likely_previews(conversations: DataFrame, settings: Settings | None = None, fast: bool = False) -> DataFrame:
    """Statistics lines of the conversations that look like chat."""
    return preview_line(run(conversations.where(is_likely_chat(F.col("raw"))), settings, fast=fast).stats)


def render_failures(failed: DataFrame) -> DataFrame:
    """(conv_id, markdown) of (conv_id, raw, error)."""
    return failed.select("conv_id", failure_note(F.coalesce("raw", F.lit("")), F.col("error")).alias("markdown"))
