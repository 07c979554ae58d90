"""Memo, counts, appendix and guarded steps on small tables; texts that patterns go through once."""

import time

from pyspark.sql import functions as F

from chatframe.functions import enrich, names, safe
from chatframe.operators import detect, diagnostics, guarded, lines
from chatframe.plans import memo, pipeline
from chatframe.settings import Settings

PASTE = "Ann Lee  [3:04 PM](https://x.example/archives/C1/p1)\nhello there, :smile:\nBo Day  [3:05 PM](https://x.example/archives/C1/p2)\nand hello, you\nand more"


def frame(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "conv_id long, raw string")


def test_memo_formats_a_text_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "memo")
    pastes = frame(spark, PASTE, PASTE, "", None, "Cy Orr  [3:09 PM](https://x.example/p)\nwell then, all")
    want = {r.conv_id: r.markdown for r in pipeline.run(pastes, fast=True).rendered.collect()}
    for parsed in (3, 0):  # three different texts, one of them empty
        found, n = memo.format_memoised(pastes, path, fast=True)
        assert n == parsed and {r.conv_id: r.markdown for r in found.collect()} == want
    assert memo.format_memoised(pastes, path, Settings(replace_emoji=False), fast=True)[1] == 3
    monkeypatch.setattr(memo, "MOST", 10)  # nothing is small enough, but all is given
    other = str(tmp_path / "other")
    for _ in range(2):
        found, n = memo.format_memoised(pastes, other, fast=True)
        assert n == 3 - (_ == 1) and {r.conv_id: r.markdown for r in found.collect()} == want  # the empty text is
    assert memo.format_memoised(frame(spark).where("false"), str(tmp_path / "none"), fast=True)[0].count() == 0


def test_counts_by_level(spark):
    log = diagnostics.Log()
    pipeline.run(frame(spark, PASTE, "x\n" * 50_001, "lorem, ipsum. " * 80_000), fast=True, log=log)
    found = {(s, m): (level, n) for s, m, level, n in log.entries()}
    assert found["admission", "conversations"] == ("info", 3) and found["admission", "refused"] == ("error", 1) and found["admission", "large"] == ("warn", 1)
    assert ("admission", "characters") not in found and found["messages", "unknown_users"] == ("warn", 1)
    assert log.table(spark).where("level = 'error'").count() == 1


def test_appendix(spark):
    result = pipeline.run(frame(spark, PASTE + "\n" + PASTE.split("\n")[0] + "\nhello there, :smile:"), Settings(debug=True), fast=True)
    text = result.rendered.first().markdown
    assert "\n\n---\n\n## Debug Information\n\n### Processing Steps\n- Detected format: " in text and "- Processed 2 messages (intelligent)" in text
    unparsed = text.split("### Unparsed Content\n\n```\n")[1].split("\n```")[0].split("\n")
    assert unparsed == ["Ann Lee  [3:04 PM](https://x.example/archives/C1/p1)", "Bo Day  [3:05 PM](https://x.example/archives/C1/p2)", "and hello, you", "and more", "Ann Lee  [3:04 PM](https://x.example/archives/C1/p1)"]


def test_uncovered_lines(spark):
    rows = lines.explode_lines(frame(spark, "a\nb\n\nc\nd\ne\nf"))
    spans = spark.createDataFrame([(0, 1, 1), (0, 0, 3), (0, 2, 2), (0, 5, 5)], "conv_id long, start_line int, end_line int")
    assert sorted(r.content for r in diagnostics.uncovered_lines(rows, spans).collect()) == ["d", "f"]


def test_guarded_steps(spark):
    def breaks(text):
        raise KeyError("never")

    rows = spark.createDataFrame([(1, None), (2, "<@U7> <https://a.b|c> :smile:")], "id int, text string")
    found = guarded.enrich_guarded(rows, Settings(highlight_threads=False), steps={"links": [enrich.InPython(breaks)], "emoji": [lambda c: F.lit(None).cast("string")]})
    got = {r.id: (r.text, {d.step: (d.outcome, d.error) for d in r.done}) for r in found.collect()}
    assert got[2][0] == "[[User-U7]] [c](https://a.b) :smile:" and got[1][0] == ""
    assert got[2][1]["links"] == ("fallback", "KeyError: 'never'") and got[2][1]["emoji"] == ("failed", "no result") and "thread_links" not in got[2][1]
    assert {(r.step, r.outcome): r.messages for r in guarded.outcomes(found).collect()}["emoji", "failed"] == 2
    numbers = guarded.enrich_guarded(spark.createDataFrame([(1.5,)], "text double")).first()
    assert numbers.text == "1.5" and {d.outcome for d in numbers.done} == {"unchanged"}


def test_null_safe_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("a1b22",)], "x string")
    c = F.col("x")
    got = [tuple(r) for r in df.select(safe.matches(c, r"\d"), safe.first_of(c, r"\d+"), safe.all_of(c, r"\d+"), safe.replaced(c, r"\d", ""), safe.split_by(c, r"\d+"), F.size(safe.as_list(F.when(c != "", F.array(c))))).collect()]
    assert got == [(False, None, [], "", [""], 0), (False, None, [], "", [""], 0), (True, "1", ["1", "22"], "ab", ["a", "b", ""], 1)]


def test_long_lines_are_looked_through_once(spark):
    """Two million signs on a line, with and without punctuation, through what every message and every
    classification passes."""
    plain, marked = "lorem ipsum dolor " * 110_000, "lorem, ipsum: dolor. " * 95_000
    ends = "Ann Lee  [3:04 PM](https://x.example/archives/C1/p1) uploaded a file: a.png"
    df = spark.createDataFrame([(0, plain), (1, marked), (2, plain + ends), (3, marked + ends)], "conv_id long, raw string")
    began = time.time()
    shown = {r.conv_id: r.x for r in df.select("conv_id", F.right(enrich.mark_uploads(F.col("raw")), F.lit(20)).alias("x")).collect()}
    assert shown[2] == shown[3] == " uploaded: **a.png**" and shown[0] == plain[-20:]
    assert detect.classify(df).count() == 4
    assert df.select(names.undouble(F.col("raw")).alias("x")).where("length(x) > 0").count() == 4
    assert time.time() - began < 90


def test_longer_doubled_names(spark):
    name = "One Two Three Four Five Six Seven Eight Nine"
    df = spark.createDataFrame([(name * 2,), (f"{name}  {name}",), (f"{name} {name}x",), (f"so, {name}",)], "x string")
    assert [r[0] for r in df.select(names.undouble(F.col("x"))).collect()] == [name, name, f"{name} {name}x", f"so, {name}"]
