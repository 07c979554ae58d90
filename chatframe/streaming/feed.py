"""Extension: new pastes as a stream. A paste is complete when it arrives, so there is no state and
no watermark; each micro-batch goes through the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatframe.plans.pipeline import run
from chatframe.schema import CONVERSATION
from chatframe.settings import Settings
from chatframe.storage import scratch


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, raw) from Parquet files as they are added."""
    return spark.readStream.schema(CONVERSATION).parquet(path)


def format_stream(feed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings | None = None, fast: bool = False):
    """Start a query that hands each batch's (conv_id, markdown) to ``write``, which has to write it
    before it returns: what the batch stored is removed then. The batch id lets a sink drop a batch
    that comes again after a failure."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            write(run(batch, settings, fast=fast).rendered, batch_id)

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
