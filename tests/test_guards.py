"""Texts without any sign of links or emoji skip their patterns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatframe.functions import emoji, enrich
from chatframe.functions.text import nfc_of
from chatframe.operators.enrich import in_python

ODD = [None, "", "plain words, no sign", "a <https://ex.org|d> b", "&lt;https://ex.org&gt;", "<www.ex.org>", ":smile: :nope:", "production Standard  emoji\tassets", "Apple  large", "<mailto:a@b.co> :+1:"]
LINKED = [None, "", ODD[2], "a [d](https://ex.org) b", "https://ex.org", "https://www.ex.org", *ODD[6:9], "[a@b.co](mailto:a@b.co) :+1:"]
SHOWN = [None, "", *ODD[2:6], "😄 :nope:", "production-standard-emoji-assets", "apple-large", "<mailto:a@b.co> 👍"]


@pytest.mark.parametrize(("f", "want"), [(enrich.convert_links, LINKED), (emoji.replace_emoji, SHOWN)])
def test_plain_texts_skip_the_patterns(spark, f, want):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").coalesce(1)
    assert [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()] == want
    assert "contains(" in str(f(F.col("t"))).lower()  # looked for before any pattern


def test_workers_hold_few_texts_at_a_time():
    """A step in Python gives a batch back in slices, in order, whatever its size."""

    class Table:
        schema = None

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.record_batch({"i": list(range(1200)), "text": ["é"] * 1199 + [None]}), pa.record_batch({"i": [7], "text": ["x"]})])))

    found = in_python(Table(), enrich.InPython(nfc_of), "text")
    assert max(b.num_rows for b in found) <= 500
    rows = pa.Table.from_batches(found).to_pylist()
    assert rows == [{"i": i, "text": "é"} for i in range(1199)] + [{"i": 1199, "text": None}, {"i": 7, "text": "x"}]
