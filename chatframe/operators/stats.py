"""Statistics of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversation_stats(messages: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """(conv_id, message_count, unique_users, thread_replies, format)."""
    rows = messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.countDistinct(F.nullif("username", F.lit(""))).alias("unique_users"), F.count_if(F.coalesce(F.col("thread_info"), F.lit("")) != "").alias("thread_replies")
    )
    if formats is None:
        return rows.withColumn("format", F.lit("unknown"))
    return rows.join(formats.select("conv_id", "format"), "conv_id", "left").select("conv_id", "message_count", "unique_users", "thread_replies", F.coalesce("format", F.lit("unknown")).alias("format"))


def with_defaults(conversations: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for every conversation; those without messages have zeros and an unknown format."""
    rows = conversations.select("conv_id").distinct().join(stats, "conv_id", "left")
    return rows.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("message_count", "unique_users", "thread_replies")], F.coalesce("format", F.lit("unknown")).alias("format"))


def failure_stats(conversations: DataFrame, col: str = "raw") -> DataFrame:
    """Statistics of conversations that failed: users are counted by their mentions."""
    return conversations.select("conv_id", F.lit(0).cast("long").alias("message_count"), F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit("<@U[A-Z0-9]+>")).cast("long").alias("unique_users"), F.lit(0).cast("long").alias("thread_replies"), F.lit("fallback").alias("format"))


def user_rollup(messages: DataFrame) -> DataFrame:
    """Extension: message counts by conversation and user, with subtotals and the total."""
    return messages.rollup("conv_id", "username").agg(F.count("*").alias("message_count"), F.grouping_id().alias("level"))


def user_sketches(messages: DataFrame, precision: int = 12) -> DataFrame:
    """(conv_id, day, users): a sketch of each conversation's users by day. Sketches merge, so they are
    stored once and a day's users are counted without its messages; 2 ** ``precision`` registers each."""
    return messages.groupBy("conv_id", "day").agg(F.hll_sketch_agg("username", precision).alias("users"))


def users_by_day(sketches: DataFrame) -> DataFrame:
    """(day, estimate): distinct users over all conversations, each conversation's sketch merged."""
    return sketches.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("estimate"))
