"""Extension: state over the batches of a stream: pastes seen before are dropped, equal messages count
once, and statistics go on from batch to batch.

State grows with what is remembered and is dealt out by key over the shuffle partitions; it lives in
the state store under the query's checkpoint, so it survives lost executors and restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatframe.operators.dedup import message_key

TALLY = "conv_id bigint, message_count bigint, unique_users bigint, thread_replies bigint"


def new_pastes(feed: DataFrame, keep: str = "7 days") -> DataFrame:
    """``feed`` without pastes whose text came before, within ``keep`` at least and twice that at most;
    a null text counts as empty. Native: only a digest of each text is remembered. Its result goes into ``format_stream``. The time is that of
    the batch, which a batch that runs again keeps."""
    rows = feed.withColumns({"_arrived": F.current_timestamp(), "_digest": F.sha2(F.coalesce("raw", F.lit("")), 256)}).withWatermark("_arrived", keep)
    return rows.dropDuplicatesWithinWatermark(["_digest"]).select(*feed.columns)


STATE = "messages bigint, replies bigint, users array<string>, said array<string>"


def _tally(idle_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    def tally(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        messages, replies, users, said = state.get if state.exists else (0, 0, [], [])
        users, said = dict.fromkeys(users), dict.fromkeys(said)  # in order of arrival
        batch = pd.concat(list(rows)).sort_values("msg_idx", kind="stable").drop_duplicates("said")
        batch_time = batch["ms"].max()
        batch = batch[~batch["said"].isin(said.keys())]
        said.update(dict.fromkeys(batch["said"]))
        users.update(dict.fromkeys(batch["user"].dropna()))
        messages, replies = messages + len(batch), replies + int(batch["reply"].sum())
        state.update((messages, replies, list(users), list(said)))
        state.setTimeoutTimestamp(max(int(batch_time), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "message_count": [messages], "unique_users": [len(users)], "thread_replies": [replies]})

    return tally


def running_stats(messages: DataFrame, idle_hours: float = 24 * 7) -> DataFrame:
    """(conv_id, message_count, unique_users, thread_replies): for each conversation of which messages
    came, its statistics so far; an equal message of an earlier batch counts no more, as in
    ``drop_equal_messages``. Rows without ``conv_id`` aren't counted. A conversation's state is its counts,
    users and digests of messages, which admission bounds; a timer forgets it when nothing came for
    ``idle_hours``. Times are those of the batches, by a watermark: a timer by the machine's clock would let
    a run over what is available never end. Only digests and names reach Python."""
    rows = messages.where("conv_id is not null").withColumn("at", F.current_timestamp()).withWatermark("at", "0 seconds")
    rows = rows.select(
        "conv_id", "msg_idx", "at", F.unix_millis("at").alias("ms"), F.md5(message_key(F.col("username"), F.col("ts_text"), F.col("text"))).alias("said"), F.nullif("username", F.lit("")).alias("user"),
        (F.coalesce("thread_info", F.lit("")) != "").alias("reply"),
    )
    return rows.groupBy("conv_id").applyInPandasWithState(_tally(max(1, int(idle_hours * 3_600_000))), TALLY, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stats_stream(messages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, idle_hours: float = 24 * 7):
    """Start a query that hands each batch's new statistics to ``write``."""
    return running_stats(messages, idle_hours).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
