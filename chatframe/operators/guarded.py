"""Enrichment that survives its steps: each says what it did, and a plainer step stands in for one that fails.

A step gives (content, outcome, error). A step in Python fails by an exception, text by text; a native one,
which has none to catch, by a null for a text that isn't null. The fallback then works on the text as the
step got it; where that fails too, or there is none, the text stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatframe.functions.enrich import InPython, step, step_report
from chatframe.functions.safe import as_text, simple_links, simple_mentions
from chatframe.settings import Settings

#: Plainer steps; code fences and all others stay as they are.
FALLBACKS: dict[str, Callable[[Column], Column]] = {"code_fences": lambda c: c, "links": simple_links, "mentions": simple_mentions}
DONE = "array<struct<step:string,outcome:string,error:string>>"
Step = Callable[[Column], Column] | InPython


def _caught(rows: DataFrame, f: InPython) -> DataFrame:
    """``_new`` and ``_error`` of a step in Python: its result, or the exception it ended with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, errors = [], []
            for text in batch.column("_new").to_pylist():
                try:
                    result, error = (None if text is None else f.function(text)), None
                except Exception as e:
                    result, error = None, f"{type(e).__name__}: {e}"
                new.append(result)
                errors.append(error)
            done = batch.set_column(batch.schema.get_field_index("_new"), "_new", pa.array(new, pa.string()))
            known = done.column("_error").to_pylist()
            yield done.set_column(done.schema.get_field_index("_error"), "_error", pa.array([a or b for a, b in zip(known, errors, strict=True)], pa.string()))

    return rows.mapInArrow(run, T.StructType([T.StructField(x.name, x.dataType, True) for x in rows.schema]))  # a failed step gives null


def enrich_guarded(messages: DataFrame, settings: Settings | None = None, col: str = "text", steps: Mapping[str, list[Step]] | None = None, fallbacks: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """``messages`` with ``col`` enriched and ``done``: (step, outcome, error) for each step that is on.

    ``col`` of any type becomes text, null an empty one. Outcomes: applied, unchanged, fallback, failed.
    ``steps`` and ``fallbacks`` stand in for those of the same name. A switched-off step isn't in ``done``.
    """
    settings, steps, fallbacks = settings or Settings(), steps or {}, {**FALLBACKS, **(fallbacks or {})}
    rows = messages.withColumns({col: as_text(F.col(col)), "done": F.array().cast(DONE)})
    for name, on in step_report(settings).items():
        if not on:
            continue
        rows = rows.withColumns({"_new": F.col(col), "_error": F.lit(None).cast("string")})
        for f in steps.get(name, None) or step(name, settings):
            rows = _caught(rows, f) if isinstance(f, InPython) else rows.withColumn("_new", f(F.col("_new")))
        failed, old = F.col("_new").isNull(), F.col(col)
        plain = fallbacks[name](old) if name in fallbacks else F.lit(None).cast("string")
        rows = rows.withColumns({"_plain": F.when(failed, plain)})
        outcome = F.when(~failed, F.when(F.col("_new") == old, "unchanged").otherwise("applied")).when(F.col("_plain").isNotNull(), "fallback").otherwise("failed")
        error = F.when(failed, F.coalesce("_error", F.lit("no result")))
        said = F.struct(F.lit(name).alias("step"), outcome.alias("outcome"), error.alias("error"))
        rows = rows.withColumns({"done": F.concat("done", F.array(said)), col: F.coalesce("_new", "_plain", old)}).drop("_new", "_error", "_plain")
    return rows


def outcomes(messages: DataFrame) -> DataFrame:
    """(step, outcome, messages): how often each step did what."""
    return messages.select(F.explode("done").alias("d")).groupBy("d.step", "d.outcome").agg(F.count("*").alias("messages"))
