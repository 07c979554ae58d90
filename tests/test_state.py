"""State over batches: three batches give what one run over all of them gives."""

import pytest
from pyspark.sql import functions as F

from chatframe.operators.dedup import drop_equal_messages
from chatframe.operators.stats import conversation_stats
from chatframe.schema import CONVERSATION, MESSAGE
from chatframe.sources.transcripts import messages_of, turns
from chatframe.streaming import state
from chatframe.streaming.feed import read_feed


def arrive(df, folder, k):
    df.coalesce(2).write.parquet(f"{folder}/batch={k}")


@pytest.fixture
def feed_of(spark):
    def made(folder, schema):
        return spark.readStream.schema(schema).parquet(f"{folder}/*")

    return made


def test_statistics_go_on_over_batches(spark, sf_dir, tmp_path, feed_of):
    rows = messages_of(turns(spark, sf_dir)).withColumn("thread_info", F.when(F.col("msg_idx") % 3 == 0, "2 replies"))
    again = rows.where("msg_idx % 4 = 0").withColumn("msg_idx", F.col("msg_idx") + 1000)
    odd = spark.createDataFrame([(None, 0, "Ann", None, "x"), (10**9, 0, None, None, None), (10**9, 1, "", None, "")], "conv_id bigint, msg_idx int, username string, ts_text string, text string").withColumn("thread_info", F.lit(None).cast("string"))
    columns = odd.columns
    every = rows.unionByName(again).select(*columns).union(odd)
    parts = [every.where("msg_idx < 3"), every.where("msg_idx between 3 and 1003"), every.where("msg_idx > 1003")]
    latest: dict[int, tuple] = {}
    seen = []

    def write(batch, number):
        got = {r.conv_id: (r.message_count, r.unique_users, r.thread_replies) for r in batch.collect()}
        seen.append(len(got))
        latest.update(got)

    for k, part in enumerate(parts):
        arrive(part, tmp_path / "in", k)
        query = state.stats_stream(feed_of(tmp_path / "in", every.schema), write, str(tmp_path / "cp"))
        assert query.awaitTermination(60) and query.exception() is None
    want = conversation_stats(drop_equal_messages(every.where("conv_id is not null")))
    assert latest == {r.conv_id: (r.message_count, r.unique_users, r.thread_replies) for r in want.collect()}
    assert sum(map(bool, seen)) == 3  # batches without rows only move the watermark


def test_idle_conversations_are_forgotten(spark, tmp_path, feed_of):
    row = spark.createDataFrame([(1, 0, "Ann", "3:04 PM", "hello", None)], "conv_id bigint, msg_idx int, username string, ts_text string, text string, thread_info string")
    other = row.withColumn("conv_id", F.lit(2).cast("bigint"))
    out = []
    for k, part in enumerate([row, other, row]):
        arrive(part, tmp_path / "in", k)
        query = state.stats_stream(feed_of(tmp_path / "in", row.schema), lambda df, i: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), idle_hours=0)
        assert query.awaitTermination(60)
    assert sorted(out) == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0)]  # counted anew: its key was gone


def test_pastes_seen_before_are_dropped(spark, tmp_path):
    raw = "Ann Lee  [3:04 PM](https://x.example/a)\nhello there, all"
    batches = [[(1, raw), (2, raw), (3, None)], [(4, raw), (5, raw + " and more")], [(6, ""), (7, raw), (8, raw + " and more")]]
    out = []
    for k, rows in enumerate(batches):
        arrive(spark.createDataFrame(rows, CONVERSATION), tmp_path / "in", k)
        feed = state.new_pastes(read_feed(spark, str(tmp_path / "in") + "/*"))
        query = feed.writeStream.foreachBatch(lambda df, i: out.append(sorted(r.conv_id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(90) and query.exception() is None
    first, second = [x for x in out if x]
    assert first in ([1, 3], [2, 3]) and second == [5]  # all of the third came before
