"""Walks over conversations and long texts are dealt out by number of partitions."""

from pyspark.sql import functions as F

from chatframe.operators.segment import primary_intervals, primary_lines
from chatframe.plans import queries


def test_walks_are_not_gathered(spark):
    rows = spark.range(64).select(F.col("id").alias("conv_id"), F.lit("Ada Lovell  [3:04 PM](https://chat.example/archives/C1/p1)\nso it is; good?").alias("raw"))
    found = primary_intervals(primary_lines(rows))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.select("conv_id").distinct().count() == 64


def test_long_names_are_dealt_out(spark, sf_dir):
    """A small file is read in one task; the long texts made of its rows are not."""
    assert queries.usr_undouble_long(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
