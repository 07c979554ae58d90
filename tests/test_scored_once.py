"""The fallback parser scores a line once, whatever reads the scores, and gives both dates by one parse."""

from pyspark.sql import functions as F

from chatframe.operators import fallback
from chatframe.plans import queries


def test_lines_are_scored_once(spark, sf_dir, monkeypatch):
    scored = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (scored.add(1), t)[1], "string").asNondeterministic()
    real = fallback.explode_lines
    monkeypatch.setattr(fallback, "explode_lines", lambda rows: real(rows).withColumn("trimmed", count("trimmed")))
    head = "Ada Lovell  [3:04 PM](https://chat.example/archives/C1/p1)\nso it is; good?\n"
    raw = f"--- January 8, 2023 ---\n{head}--- March 8, 2023 ---\n{head.replace('Ada', 'Eda')}"
    rows = spark.createDataFrame([(k, raw) for k in range(5)], "conv_id long, raw string")
    day = lambda c: F.to_date(c).cast("string")
    found = fallback.fallback_messages(rows, queries.now(), as_of=None).select("msg_idx", day("msg_date"), day("as_of_date")).distinct().orderBy("msg_idx").collect()
    assert [tuple(r) for r in found] == [(0, "2023-03-08", "2023-01-08"), (1, "2023-03-08", "2023-03-08")]
    assert scored.value == 5 * len(raw.split("\n"))


def test_dates_take_one_parse(spark, sf_dir):
    plan = queries.QUERIES["fb_dates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
