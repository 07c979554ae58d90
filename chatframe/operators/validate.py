"""Checks of message tables: issues as rows, verdicts and scores as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions.text import is_blank, trim_u
from chatframe.schema import UNKNOWN_USER

METADATA_ONLY = r"(?i)^Added by\s+\w+$|^(?:Language|TypeScript|Last updated)$|^\d+\s*(?:minutes?|hours?|days?)\s*ago$|^!\[\]\(https?://[^)]+\)$"
SUSPICIOUS = ["unknown", "undefined", "null", "anonymous", "user", "guest", "temp", "test"]
TIMES = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}|^(?i:\d{1,2}:\d{2}\s*(?:AM|PM)?)$|^\d{10,13}$"
LONG = 10_000


def _issues(messages: DataFrame, checks: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """(conv_id, msg_idx, type, severity, message): a row for each check that hits."""
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), text.alias("message"))) for when, kind, level, text in checks])
    return messages.select("conv_id", "msg_idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("conv_id", "msg_idx", "i.*")


def _said(text: str, *cols: Column | str) -> Column:
    return F.format_string(text, *cols)


def unknown_users(messages: DataFrame) -> DataFrame:
    unknown = F.coalesce(F.nullif("username", F.lit("")), F.lit(UNKNOWN_USER)) == UNKNOWN_USER
    preview = F.coalesce(F.substring("text", 1, 50), F.lit("[no text]"))
    return _issues(messages, [(unknown, "unknown_user", "warning", _said('Message %d: Unknown User with text: "%s..."', "msg_idx", preview))])


def structure_issues(messages: DataFrame) -> DataFrame:
    text = F.col("text")
    return _issues(
        messages,
        [
            (is_blank(text), "empty_content", "warning", _said("Message %d: Empty message content", "msg_idx")),
            (trim_u(text).rlike(METADATA_ONLY), "metadata_only", "warning", _said('Message %d: Contains only metadata: "%s"', "msg_idx", text)),
            ((F.col("username") != "") & (F.length("username") <= 2), "short_username", "warning", _said('Message %d: Suspiciously short username: "%s"', "msg_idx", "username")),
        ],
    )


def verdicts(messages: DataFrame) -> DataFrame:
    """(conv_id, is_valid, unknown_user_count, structure_issue_count): one row per conversation."""
    bad = unknown_users(messages).union(structure_issues(messages)).groupBy("conv_id").agg(F.count_if(F.col("type") == "unknown_user").alias("u"), F.count_if(F.col("type") != "unknown_user").alias("s"))
    rows = messages.select("conv_id").distinct().join(bad, "conv_id", "left")
    u, s = F.coalesce("u", F.lit(0)), F.coalesce("s", F.lit(0))
    return rows.select("conv_id", ((u + s) == 0).alias("is_valid"), u.alias("unknown_user_count"), s.alias("structure_issue_count"))


def message_errors(messages: DataFrame) -> DataFrame:
    """A missing author is an error, a blank text a warning."""
    return _issues(messages, [(is_blank(F.col("username")), "missing_username", "error", _said("Message %d: Missing or empty username", "msg_idx")), (is_blank(F.col("text")), "empty_content", "warning", _said("Message %d: Empty content", "msg_idx"))])


def full_issues(messages: DataFrame) -> DataFrame:
    name, ts, text = F.col("username"), F.col("ts_text"), F.col("text")
    odd = F.lower(name).isin(SUSPICIOUS) | name.rlike(r"^\d+$") | (F.length(name) < 2)
    same = F.lower(trim_u(text))
    nth = F.row_number().over(W.partitionBy("conv_id", same).orderBy("msg_idx"))
    rows = messages.withColumn("_again", (nth > 1) & (same != ""))
    return _issues(
        rows,
        [
            (is_blank(name), "missing_username", "error", _said("Message %d has missing or empty username", "msg_idx")),
            (~is_blank(name) & odd, "suspicious_username", "warning", _said("Suspicious username detected: %s", name)),
            (F.coalesce(ts, F.lit("")) == "", "missing_timestamp", "error", _said("Message %d missing timestamp", "msg_idx")),
            ((ts != "") & ~ts.rlike(TIMES), "invalid_timestamp", "warning", _said("Invalid timestamp format: %s", ts)),
            (is_blank(text), "empty_content", "error", _said("Message %d has empty content", "msg_idx")),
            (F.col("_again"), "duplicate_message", "warning", _said("Duplicate message detected at line %d", "msg_idx")),
        ],
    )


def full_report(messages: DataFrame) -> DataFrame:
    """(conv_id, total_messages, messages_with_timestamps, duplicate_messages, suspicious_usernames,
    errors, warnings, score, recommendations)."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("total_messages"), F.count_if(F.coalesce(F.col("ts_text").rlike(TIMES), F.lit(False))).alias("messages_with_timestamps"))
    names = F.array_sort(F.collect_set(F.when(F.col("type") == "suspicious_username", F.substring("message", len("Suspicious username detected: ") + 1, 1 << 20))))
    bad = full_issues(messages).groupBy("conv_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("type") == "duplicate_message").alias("duplicate_messages"), names.alias("suspicious_usernames"))
    rows = counts.join(bad, "conv_id", "left").na.fill(0, ["errors", "warnings", "duplicate_messages"])
    names = F.coalesce("suspicious_usernames", F.array().cast("array<string>"))
    advice = F.array(
        F.when(F.size(names) > 0, "Review and correct suspicious usernames"),
        F.when(F.col("messages_with_timestamps") < F.col("total_messages") * 0.8, "Add missing timestamps for better message tracking"),
        F.when(F.col("duplicate_messages") > 0, "Remove duplicate messages to improve clarity"),
    )
    score = F.greatest(F.lit(0), 100 - F.col("errors") * 10 - F.col("warnings") * 2)
    return rows.select("conv_id", "total_messages", "messages_with_timestamps", "duplicate_messages", names.alias("suspicious_usernames"), "errors", "warnings", score.alias("score"), F.filter(advice, lambda x: x.isNotNull()).alias("recommendations"))


def content_check(c: Column) -> Column:
    """A struct (is_valid, score) of a rendered text: long ones lose 5, unsafe ones all."""
    unsafe = c.contains("<script>") | c.contains("javascript:")
    return F.struct((~unsafe).alias("is_valid"), F.when(unsafe, 0).when(F.length(c) > LONG, 95).otherwise(100).alias("score"))
