"""Enrichment of a message table, step by step: each enabled step is one projection, so that no
step's expression is repeated inside the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.functions.enrich import InPython, step, step_report
from chatframe.settings import Settings

#: Rows whose texts a worker has as Python strings at a time.
ROWS = 500


def enrich_messages(messages: DataFrame, settings: Settings | None = None, col: str = "text") -> DataFrame:
    settings = settings or Settings()
    for name, on in step_report(settings).items():
        for f in step(name, settings) if on else ():
            messages = messages.withColumn(col, f(F.col(col))) if not isinstance(f, InPython) else in_python(messages, f, col)
    return messages


def in_python(messages: DataFrame, f: InPython, col: str) -> DataFrame:
    """A step without a native form, over Arrow batches. As a stage of its own it also keeps the
    native steps before and after it in plans of their own. A worker holds one batch, which Spark bounds by
    rows and bytes, and the Python texts of ``ROWS`` of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = [None if t is None else f.function(t) for t in batch.column(col).to_pylist()]
                yield batch.set_column(batch.schema.get_field_index(col), col, pa.array(texts, pa.string()))

    return messages.mapInArrow(run, messages.schema)
