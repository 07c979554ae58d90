"""Results by content: a table of what was formatted before, keyed by a digest of text and settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatframe.plans.pipeline import REF, run
from chatframe.settings import Settings
from chatframe.storage import store

SCHEMA = "digest binary, markdown string"
#: Characters of a text and its result together up to which it is remembered.
MOST = 2 * 1024 * 1024


def remembered(spark: SparkSession, memo: str) -> DataFrame | None:
    """What the memo holds; None where there is none yet. One that can't be read is an error."""
    try:
        return spark.read.schema(SCHEMA).parquet(memo)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def format_memoised(conversations: DataFrame, memo: str, settings: Settings | None = None, ref: str = REF, fast: bool = False) -> tuple[DataFrame, int]:
    """((conv_id, markdown), how many texts were formatted anew).

    ``memo``: a folder all executors share, made if absent. Equal texts are formatted once, however many
    conversations have them: a partial aggregate, so copies leave a task as one row. Texts without a
    message are remembered as such and have no row. Results over ``MOST`` characters are given but not
    remembered. Two runs at the same time may remember a text twice, which changes nothing.
    """
    spark, settings = conversations.sparkSession, settings or Settings()
    text = F.coalesce("raw", F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws("\n", F.lit(repr((settings, ref, fast))), text), 256))
    misses = conversations.select(digest.alias("digest"), text.alias("raw")).groupBy("digest").agg(F.first("raw").alias("raw"))
    known = remembered(spark, memo)
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    fresh = Observation()
    misses = store(misses.withColumn("conv_id", F.monotonically_increasing_id()).observe(fresh, F.count("*").alias("n")), "misses")
    parsed = fresh.get["n"]
    if parsed:
        made = run(misses.select("conv_id", "raw"), settings, F.lit(ref).cast("timestamp"), fast).rendered
        made = store(misses.join(made, "conv_id", "left").select("digest", "markdown", (F.length("raw") + F.coalesce(F.length("markdown"), F.lit(0))).alias("size")), "made")
        made.where(F.col("size") <= MOST).select("digest", "markdown").write.mode("append").parquet(memo)
    stored = remembered(spark, memo)
    large = made.where(F.col("size") > MOST).select("digest", "markdown") if parsed else None
    stored = large if stored is None else stored if large is None else stored.union(large)
    if stored is None:
        return misses.select("conv_id", F.lit(None).cast("string").alias("markdown")).limit(0), 0
    results = store(stored.groupBy("digest").agg(F.first("markdown").alias("markdown")), "results")  # so that AQE can split a text that many have
    rows = conversations.select("conv_id", digest.alias("digest")).join(results, "digest")
    return rows.where("markdown is not null").select("conv_id", "markdown"), parsed
