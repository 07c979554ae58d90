"""Shared helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.storage import scratch, shared_dir, store

__all__ = ["BROADCAST_ROWS", "bounded_broadcast", "doc_bucket", "scratch", "shared_dir", "store", "table"]

#: Rows up to which a derived per-source or per-model table may carry a broadcast hint.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the row count, already known, is within ``limit``; beyond it
    Catalyst picks a shuffled join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if rows <= limit else df


def doc_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus
