"""What a run says about itself: counts of its stages by level, and the appendix of debug runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chatframe.functions.text import unlines
from chatframe.operators.render import UNPARSED_LINES, unparsed_lines
from chatframe.operators.validate import full_report, structure_issues, unknown_users
from chatframe.storage import store

LEVELS = ["debug", "info", "warn", "error"]
ENTRY = "stage string, metric string, level string, value long"


class Log:
    """Counts that stages take while they are written, so that no job is run for them. What is below
    ``info`` is counted in debug runs only; warnings and errors show if they aren't zero."""

    def __init__(self, debug: bool = False) -> None:
        self.least = 0 if debug else 1
        self._seen: list[tuple[str, Observation, dict[str, str]]] = []

    def stored(self, df: DataFrame, stage: str, keep: bool = False, **metrics: tuple[str, Column]) -> DataFrame:
        """``store`` with counts: name = (level, aggregate over the rows)."""
        return store(self.watch(df, stage, **metrics), stage, keep)

    def watch(self, df: DataFrame, stage: str, **metrics: tuple[str, Column]) -> DataFrame:
        """``df`` with counts of its rows; the first action on it has to be written to its end."""
        shown = {name: (level, value) for name, (level, value) in metrics.items() if LEVELS.index(level) >= self.least}
        if not shown:
            return df
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self._seen.append((stage, seen, {name: level for name, (level, _) in shown.items()}))
        return df.observe(seen, *(F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, (_, value) in shown.items()))

    def entries(self) -> list[tuple[str, str, str, int]]:
        """(stage, metric, level, value): a few for each stage, in order."""
        found = [(stage, name, level, seen.get[name]) for stage, seen, levels in self._seen for name, level in levels.items()]
        return [x for x in found if x[3] or LEVELS.index(x[2]) < LEVELS.index("warn")]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries(), ENTRY)


def uncovered_lines(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """Filled lines (conv_id, line_no, ...) between no message's ``start_line`` and ``end_line``: an
    anti-join by interval. Intervals are united first, so that a line meets one of them at most."""
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("start_line", "end_line")
    spans = messages.select("conv_id", "start_line", "end_line").withColumn("_till", F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("_no", F.sum((F.col("start_line") > F.coalesce(F.col("_till"), F.lit(-2)) + 1).cast("int")).over(order))
    united = spans.groupBy("conv_id", "_no").agg(F.min("start_line").alias("_from"), F.max("end_line").alias("_to")).drop("_no").withColumnRenamed("conv_id", "_conv")
    return lines.where("trimmed <> ''").join(united, (F.col("conv_id") == F.col("_conv")) & F.col("line_no").between(F.col("_from"), F.col("_to")), "left_anti")


def steps_taken(truncated: DataFrame, formats: DataFrame, parsed: DataFrame, folded: DataFrame, distinct: DataFrame, fallback: DataFrame | None, postprocessed: DataFrame) -> DataFrame:
    """(conv_id, steps): what a run did with each conversation, in order."""
    count = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    switched = (fallback if fallback is not None else formats.limit(0)).select("conv_id", F.lit(True).alias("switched"))
    report = full_report(distinct).select("conv_id", "errors", "warnings")
    rows = formats.select("conv_id", "format")
    for other in (truncated.select("conv_id", "truncated"), switched, count(parsed, "n_parsed"), count(folded, "n_folded"), count(distinct, "n"), report, postprocessed.select("conv_id", "postprocessed")):
        rows = rows.join(other, "conv_id", "left")
    c, said = F.col, lambda text, *values: F.format_string(text, *[F.coalesce(v, F.lit(0)) for v in values])
    found = F.array(
        F.when(c("truncated").isNotNull(), said("Preprocessed: truncated to %d lines", c("truncated"))),
        F.concat(F.lit("Detected format: "), "format"),
        F.when(c("switched"), "Switched to flexible parser as fallback"),
        F.when(c("n_parsed") > c("n_folded"), said("Merged %d continuation messages", c("n_parsed") - c("n_folded"))),
        F.when(c("n_folded") > c("n"), said("Removed %d duplicate content blocks", c("n_folded") - c("n"))),
        F.when(c("errors") > 0, said("Structure validation: %d errors, %d warnings", c("errors"), c("warnings"))),
        F.concat(said("Processed %d messages (", c("n")), F.when(c("switched"), "flexible-fallback)").otherwise("intelligent)")),
        F.when(c("postprocessed"), "Applied postprocessing"),
    )
    return rows.select("conv_id", F.filter(found, lambda x: x.isNotNull()).alias("steps"))


def with_appendix(rendered: DataFrame, steps: DataFrame, lines: DataFrame, parsed: DataFrame, shown: DataFrame) -> DataFrame:
    """(conv_id, markdown) with the steps, the lines that are no message of ``parsed``, and what is odd
    about the messages of ``shown``. Each list is bounded: lines by number, warnings by the messages."""
    left = unparsed_lines(lines, parsed).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "content"))).alias("ls"), F.max("total").alias("total"))
    issues = unknown_users(shown).withColumn("kind", F.lit(0)).union(structure_issues(shown).withColumn("kind", F.lit(1)))
    issues = issues.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("kind", "msg_idx", "message"))).alias("ws"))
    rows = rendered.join(steps, "conv_id", "left").join(left, "conv_id", "left").join(issues, "conv_id", "left")
    more = F.col("total") - UNPARSED_LINES
    fenced = F.concat(F.array(F.lit("```")), F.transform("ls", lambda x: x["content"]), F.when(more > 0, F.array(F.format_string("... and %d more lines", more))).otherwise(F.array().cast("array<string>")), F.array(F.lit("```")))
    body = F.when(F.col("total") > 0, fenced).otherwise(F.array(F.lit("*All content was successfully parsed*")))
    heading = lambda *xs: F.array(*map(F.lit, xs))
    listed = F.transform(F.coalesce("steps", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    appendix = unlines(F.concat(heading("", "", "---", "", "## Debug Information", "", "### Processing Steps"), listed, heading("", "### Unparsed Content", ""), body))
    warned = F.concat(F.lit("\n\n### ⚠️ Validation Warnings\n"), unlines(F.transform("ws", lambda x: F.concat(F.lit("- "), x["message"]))))
    return rows.select("conv_id", F.concat("markdown", appendix, F.coalesce(warned, F.lit(""))).alias("markdown"))


