"""Continuation fragments fold into the last message of a known author: one window to find it, one
aggregate to join the pieces in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions.text import any_match, trim_u
from chatframe.schema import UNKNOWN_USER

#: How a fragment starts that carries on a message (fixed values).
CLOCK_LED = [r"(?i)^\[\d{1,2}:\d{2}(?:\s*(?:AM|PM))?\]", r"(?i)^\d{1,2}:\d{2}(?:\s*(?:AM|PM))?", r"(?i)^(?:Today|Yesterday) at \d{1,2}:\d{2}\s*(?:AM|PM)?"]


def is_fragment(text: Column, ts_text: Column, phrases: Sequence[str] = ()) -> Column:
    """An unknown author's text that starts with a clock or one of ``phrases``, or is its own time."""
    t = trim_u(text)
    return F.coalesce((text != "") & (any_match(t, [*CLOCK_LED, *phrases]) | ((ts_text != "") & ((t == "") | (t == ts_text)))), F.lit(False))


def fold_continuations(messages: DataFrame, phrases: Sequence[str] = ()) -> DataFrame:
    """``messages`` with fragments folded in: texts joined by blank lines, a fragment's own time put
    before it if it differs, reactions concatenated, the last thread information kept. Other columns
    are those of the message that takes the fragments in."""
    earlier = W.partitionBy("conv_id").orderBy("msg_idx").rowsBetween(W.unboundedPreceding, -1)
    known = F.col("username").isNotNull() & (F.col("username") != "") & (F.col("username") != UNKNOWN_USER)
    last = F.last(F.when(known, F.struct("msg_idx", "ts_text")), True).over(earlier)
    folds = (F.col("username") == UNKNOWN_USER) & F.col("_last").isNotNull() & is_fragment(F.col("text"), F.col("ts_text"), phrases)
    rows = messages.withColumn("_last", last).withColumn("_fold", F.coalesce(folds, F.lit(False)))
    rows = rows.withColumn("_to", F.when(F.col("_fold"), F.col("_last.msg_idx")).otherwise(F.col("msg_idx")))
    clocked = any_match(trim_u(F.split_part("text", F.lit("\n"), F.lit(1))), CLOCK_LED)
    own_time = (F.col("ts_text") != "") & ~F.col("ts_text").eqNullSafe(F.col("_last.ts_text"))
    timed = F.when(F.col("text") == F.col("ts_text"), F.col("text")).otherwise(F.concat("ts_text", F.lit("\n\n"), "text"))
    piece = F.when(~F.col("_fold"), F.col("text")).when(clocked, trim_u(F.col("text"))).when(F.coalesce(own_time, F.lit(False)), timed).otherwise(F.col("text"))
    others = [c for c in messages.columns if c not in ("conv_id", "msg_idx", "text", "reactions", "thread_info")]
    rows = rows.withColumn("_piece", F.nullif(piece, F.lit("")))
    out = rows.groupBy("conv_id", F.col("_to").alias("msg_idx")).agg(
        F.min_by(F.struct(*others), "msg_idx").alias("_own"),
        F.array_sort(F.collect_list(F.struct("msg_idx", "_piece", "reactions"))).alias("_ps"),
        F.max_by("thread_info", F.when(F.col("thread_info") != "", F.col("msg_idx"))).alias("thread_info"),
    )
    text = F.array_join(F.filter(F.transform("_ps", lambda p: p["_piece"]), lambda x: x.isNotNull()), "\n\n")
    reactions = F.flatten(F.filter(F.transform("_ps", lambda p: p["reactions"]), lambda x: x.isNotNull()))
    return out.select("conv_id", "msg_idx", "_own.*", text.alias("text"), reactions.alias("reactions"), "thread_info").select(*messages.columns)
