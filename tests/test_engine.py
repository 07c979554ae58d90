"""Scalars by cases, operators by invariants and small tables, the whole way end to end."""

import pytest
from pyspark.sql import functions as F

from chatframe.functions import emoji, enrich, names, text, times
from chatframe.operators import continuation, dedup, detect, embed, extract, fallback, lines, render, segment, validate
from chatframe.plans import pipeline
from chatframe.schema import MESSAGE
from chatframe.settings import Settings, load_settings, parse_json_map
from chatframe.sources.transcripts import messages_of, read_pastes, transcripts, turns

NOW = "2024-06-15 12:00:00"  # a Saturday


def values(spark, f, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in rows.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def now():
    return F.lit(NOW).cast("timestamp")


def test_text(spark):
    assert values(spark, text.preprocess, ["\t a\r\n\n\n\nb​ \x00", None, ""]) == ["a\n\nb", "", ""]
    assert values(spark, text.sanitise, ["“x” — y…  z\n  keep   this", "é"]) == ['"x" -- y... z\n  keep   this', "é"]
    assert values(spark, text.has_text, [" \n\x01", "a", None, ""]) == [False, True, False, False]
    assert values(spark, lambda c: text.map_tokens(c, "[0-9]+", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ["a1b22", "", "xyz", "7"]) == ["a<1>b<22>", "", "xyz", "<7>"]
    assert text.either(["(?i)a", r"(b)\1", "c"]) == ["(?i:a)|(?:c)", r"(?:(b)\1)"]


def test_emoji(spark):
    assert values(spark, emoji.replace_emoji, [":smile::nope: a :+1:", None, "x"]) == ["😄:nope: a 👍", None, "x"]
    assert emoji.IMAGES["2764-fe0f"] == "heart" and emoji.IMAGES["26d4"] == "no_entry" and len(emoji.IMAGES) == 40
    assert values(spark, emoji.remove_emoji, ["a :x: b 😄"]) == ["a b"]
    rows = spark.createDataFrame([([],), (None,)], "r array<struct<name:string,count:int>>")
    assert [r[0] for r in rows.select(emoji.format_reactions(F.col("r"))).collect()] == ["", ""]


def test_names(spark):
    assert values(spark, names.undouble, ["AdaAda", "Ann Ann", "Clement MiaoClement Miao", "John  john x", "a" * 600]) == ["Ada", "Ann", "Clement Miao", "John x", "a" * 300]
    assert values(spark, names.display_name, ["ada_lovell", "camelCase_x", "", None, "**😄**", "-_-"]) == ["Ada Lovell", "camelCase x", "", None, "****", "Unknown User"]
    assert values(spark, names.extract_name, ["Ann Lee", "AnnAnn", "123", None, "(https://x.slack.com/services/B1)Hub"]) == ["Ann Lee", "Ann", "Unknown User", "Unknown User", "Hub"]
    assert values(spark, names.is_valid_name, ["Ann", "Monday", "12", "3:04", "", None, "é"]) == [True, False, False, False, False, False, True]


def test_times(spark):
    shown = values(spark, lambda c: times.display_time(c, now()), ["3:04 PM", "15:04", "[7:47 PM](https://x)", "Today at 9:05 AM", "Feb 6th at 7:47 PM", "nonsense", "", None])
    assert shown == ["3:04 PM", "3:04 PM", "7:47 PM", "9:05 AM", "7:47 PM", "nonsense", "", ""]
    parsed = values(spark, lambda c: times.parse_timestamp(c, now()).cast("string"), ["Saturday", "Monday", "Feb 6th", "Feb 6th, 2023 at 7:47 PM", "Yesterday at 12:00 AM", "3:04:05 PM", "12:00 PM", "x"])
    assert parsed == ["2024-06-08 00:00:00", "2024-06-10 00:00:00", "2024-02-06 00:00:00", "2023-02-06 19:47:00", "2024-06-14 00:00:00", "2024-06-15 15:04:05", "2024-06-15 12:00:00", None]
    assert values(spark, lambda c: times.parse_date(c, now()).cast("string"), ["2024-2-30", "2024-2-3", "Feb 30", "March 5th, 2020", "Sept 7"]) == [None, "2024-02-03", None, "2020-03-05", "2024-09-07"]


def test_enrichment(spark):
    assert values(spark, enrich.escape_brackets, ["a <b> <@U1> ```<x>``` <https://a|b> &lt;", "<!here>"]) == ["a &lt;b&gt; <@U1> ```<x>``` <https://a|b> &lt;", "&lt;!here&gt;"]
    assert values(spark, enrich.convert_links, ["<https://ex.org/a|do[c]> <https://ex.org>", "&lt;https://x.y|z&gt;", "<https://a.b| >"]) == [r"[do\[c\]](https://ex.org/a) https://ex.org", "[z](https://x.y)", "[Link](https://a.b)"]
    assert values(spark, lambda c: enrich.convert_mentions(c, {"U1AB": "[[Ann]]"}), ["<@U1AB> <@U2CDEFGH> @bob, a@b.co @bob.", "<!here> <!x|y>"]) == ["[[Ann]] [[User-U2CDEF]] [[bob]], a@b.co @bob.", "**@here** y"]
    assert values(spark, enrich.format_fences, ["```  py \nx\n```  z\nq", "none"]) == ["```py\nx\n```\nq", "none"]
    assert enrich.fold_previews_of("a/b\nLanguage\nwhat it does\n\nx") == "x" and enrich.fold_previews_of("plain\ntext") == "plain\ntext"
    assert enrich.step_report(Settings(replace_emoji=False))["emoji"] is False


def test_settings():
    assert load_settings({"max_lines": 7, "unknown": 1, "debug": None}) == Settings(max_lines=7)
    assert [parse_json_map(x) for x in (None, " ", '{"a":"b"}', "[1]", "null", '{"a":1}', "{")] == [{}, {}, {"a": "b"}, None, None, None, None]


def test_lines(spark):
    t = ["3:04 PM", "[3:04](https://x)", "See more", "...", "btw", "so be it", ""]
    assert values(spark, lines.is_continuation_shape, t) == [True, True, True, True, True, False, False]
    assert values(spark, lines.looks_like_name, ["Ann Lee", "Thanks a lot", "report.pdf", "is the one", "6:28", "#CONTEXT#", "March Ann"]) == [True, False, False, False, True, False, True]
    assert values(spark, lines.has_timestamp, ["may be so", "I wanted it on monday", "3:04 PM", "none"]) == [True, False, True, False]
    rows = lines.with_features(lines.explode_lines(spark.createDataFrame([(1, "Ann Lee\n3:04 PM\nhello there, all\n\n10:31 AM\nmore")], "conv_id long, raw string"))).orderBy("line_no").collect()
    assert [r.is_start for r in rows] == [True, True, False, False, True, False]
    assert [r.is_cont for r in rows] == [False, False, False, False, True, False] and rows[4].after_empty


def walk(flags, users=None):
    import numpy as np

    n = len(next(iter(flags.values())))
    return segment.Walk({k: np.array(flags.get(k, [0] * n), bool) for k in segment.FLAGS}, users or [None] * n)


def test_walk():
    w = walk({"is_start": [1, 0, 1, 0], "is_candidate": [1, 0, 1, 0], "has_ts": [1, 0, 1, 0], "user_time": [1, 0, 1, 0]}, ["a", None, "b", None])
    assert [x[:2] for x in w.intervals()] == [(0, 1), (2, 3)]
    w = walk({"is_start": [1, 0, 0, 1, 0], "is_candidate": [1, 0, 0, 1, 0], "is_cont": [0, 0, 1, 0, 0], "is_empty": [0, 0, 0, 0, 0], "has_ts": [1, 0, 0, 1, 0]})
    assert [x[:2] for x in w.intervals()] == [(0, 4)]  # the continuation reaches over a weak start


def test_extract(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["Ann Lee  [3:04 PM](https://x)", "New hire 2:04 PM", "Ann Lee  3:04 PM", "so it is, then"])], "i int, trimmed string")
    got = [(r.author, r.author_ts) for r in extract.with_author(rows).orderBy("i").collect()]
    assert got == [("Ann Lee", "3:04 PM"), (None, None), ("Ann Lee", "3:04 PM"), (None, None)]
    found = values(spark, extract.many_reactions, ["😄4 🎉", "text 😄4", "🎉", ":a: x"])
    assert [[(r.name, r["count"]) for r in x] for x in found] == [[("😄", 4), ("🎉", 1)], [], [("🎉", 1)], []]


def test_segmentation_and_roundtrip(spark, sf_dir):
    rows = turns(spark, sf_dir)
    cols = ["conv_id", "msg_idx", "username", "ts_text", "text"]
    got = segment.header_segments(transcripts(rows)).select(*cols)
    assert got.exceptAll(messages_of(rows).select(*cols)).count() == 0 and got.count() == rows.count()
    other = segment.header_segments(spark.createDataFrame([(1, ""), (2, "just text\nmore"), (3, None)], "conv_id long, raw string")).collect()
    assert [(r.conv_id, r.username, r.text) for r in other] == [(2, "Unknown User", "just text\nmore")]


@pytest.fixture
def messages(spark):
    def made(rows):
        full = [(1, i, u, t, x, None, None, None, [], False, False, False, None, None) for i, (u, t, x) in enumerate(rows)]
        return spark.createDataFrame(full, MESSAGE)

    return made


def test_dedup(spark, messages):
    rows = messages([("a", "1:00 PM", "one thing to say here"), ("a", "1:00 PM", "one thing to say here"), ("b", None, "one thing to say here"), ("b", None, "another thing entirely X"), ("c", "", "another thing entirely Y")])
    once = dedup.drop_equal_messages(rows)
    assert [r.msg_idx for r in once.orderBy("msg_idx").collect()] == [0, 2, 3, 4]
    assert dedup.drop_equal_messages(once).count() == once.count()
    assert [r.msg_idx for r in dedup.drop_similar_messages(once).orderBy("msg_idx").collect()] == [0, 3, 4]
    assert dedup.drop_similar_messages(rows.limit(0)).count() == 0
    both = spark.createDataFrame([("", ""), ("abc", "abd"), ("a" * 10, "a" * 20)], "a string, b string")
    assert [round(r[0], 3) for r in both.select(dedup.edit_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_which_of_two_goes():
    """Own text stays before embedded, a quote before a file before a preview, then the earlier message."""
    import numpy as np

    def gone(inner, kinds, messages):
        rank = np.array([embed.PRIORITY.get(k, 0) for k in kinds])
        return dedup._victims(1, np.arange(len(inner)), np.array(messages), np.array(inner, bool), rank, [b"same"] * len(inner), {})

    assert gone([1, 0], ["quoted_message", ""], [0, 3]) == [0] and gone([0, 1], ["", "quoted_message"], [0, 3]) == [1]
    assert gone([1, 1], ["link_preview", "file_attachment"], [0, 1]) == [0] and gone([1, 1], ["quoted_message", "file_attachment"], [0, 1]) == [1]
    assert gone([0, 0, 0], ["", "", ""], [0, 9, 20]) == [1, 2] and gone([1, 1], ["link_preview"] * 2, [4, 4]) == [0]
    assert gone([1, 1, 0], ["link_preview", "file_attachment", ""], [0, 1, 2]) == [0, 1]


def test_embedded():
    found = embed.analyse("see\nhttps://ex.org/a\nA title\nsome text that describes it, and more of it\n\nBUT: [x]")
    assert [b["type"] for b in found["blocks"]] == ["link_preview"] and found["cleaned"].splitlines()[0] == "see"
    assert [b["type"] for b in embed.analyse("Ann Lee [3:04 PM]\nquoted words")["blocks"]] == ["quoted_message"]
    assert embed.analyse("")["blocks"] == [] and embed.analyse("plain words, only")["cleaned"] == "plain words, only"


def test_continuation(spark, messages):
    rows = messages([("Unknown User", None, "3:04 PM\nfirst"), ("Ann", "1:00 PM", "hi"), ("Unknown User", "2:00 PM", "nice"), ("Unknown User", None, "not one"), ("Unknown User", None, "[8:26] late")])
    assert [r.msg_idx for r in continuation.fold_continuations(rows).orderBy("msg_idx").collect()] == [0, 1, 2, 3]
    got = continuation.fold_continuations(rows, phrases=["(?i)^nice$"]).orderBy("msg_idx").collect()
    assert [(r.msg_idx, r.text) for r in got] == [(0, "3:04 PM\nfirst"), (1, "hi\n\n2:00 PM\n\nnice\n\n[8:26] late"), (3, "not one")]


def test_render(spark, messages):
    rows = messages([("ann_lee", "3:04 PM", "a\n\n```py\n<x>\n```\nb :smile:"), ("Bo Day", None, " ")])
    got = render.render_conversations(rows, None, now()).first().markdown
    assert got == "> [!slack]+ Message from Ann Lee\n> **Time:** 3:04 PM\n>\n> a\n>\n```py\n> <x>\n> ```\n> b 😄"
    assert render.render_conversations(rows.limit(0), None, now()).count() == 0
    note = values(spark, lambda c: render.failure_note(c, F.lit("x")), ["\n".join(["l"] * 101)])[0]
    assert "> ... and 1 more lines" in note


def test_validation(spark, messages):
    rows = messages([("Unknown User", "3:04 PM", "Language"), ("Al", "x", " "), ("guest", None, "ok then"), ("guest", None, "OK then")])
    assert {(r.msg_idx, r.type) for r in validate.unknown_users(rows).union(validate.structure_issues(rows)).collect()} == {(0, "unknown_user"), (0, "metadata_only"), (1, "empty_content"), (1, "short_username")}
    report = validate.full_report(rows).first()
    assert (report.errors, report.warnings, report.score, report.suspicious_usernames, len(report.recommendations)) == (3, 4, 62, ["guest"], 3)


def test_detect(spark):
    assert values(spark, detect.is_likely_chat, [":a: 3:04 PM", ":a:", None, ""]) == [True, False, False, False]
    assert values(spark, lambda c: detect.admission_error(c).isNull(), ["x", "\n" * 50_000]) == [True, False]


def test_whole_way(spark, sf_dir, tmp_path):
    (tmp_path / "a.txt").write_text("Ann Lee  [3:04 PM](https://x.example/archives/C1/p1)\nhello there, :smile:\nBo Day  [3:05 PM](https://x.example/archives/C1/p2)\nand hello, you")
    pastes = read_pastes(spark, str(tmp_path))
    note = pipeline.build_notes(pastes.select("conv_id", "raw"), "2024-06-15").first().note
    assert note.startswith("---\ncssclasses: slack-conversation\nparticipants: 2\nmessages: 2\n") and "> hello there, 😄" in note
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x\n" * 50_001)], "conv_id long, raw string")
    result = pipeline.run(odd)
    assert {r.conv_id for r in result.rendered.collect()} == {3} and result.stats.count() == 3


def test_stream(spark, tmp_path):
    from chatframe.streaming.feed import format_stream, read_feed

    spark.createDataFrame([(1, "Ann Lee  [3:04 PM](https://x.example/a)\nhello there, all")], "conv_id bigint, raw string").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = format_stream(read_feed(spark, str(tmp_path / "in")), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp"), fast=True)
    query.awaitTermination(120)
    assert "hello there, all" in spark.read.parquet(f"{out}/0").first().markdown


def test_queries_have_sql():
    from chatframe.plans import queries

    assert set(queries.QUERIES) - set(queries.ORACLES) == {"run_prose"}


def test_fallback(spark):
    raw = "--- June 8th ---\nAnn Lee\n  3:04 PM\nhello there, all\n10:31 AM\nmore of it, so\n\n\nnobody said this, really\nBo Day  [3:05 PM](https://x.example/archives/C1/p2)\n![](https://ca.slack-edge.com/a)\nyes, so it is\n:tada:\n4\n2 replies"
    got = pipeline.fallback_messages(spark.createDataFrame([(1, raw), (2, ""), (3, None)], "conv_id long, raw string"), now()).orderBy("msg_idx").collect()
    assert [(r.username, r.ts_text, r.text) for r in got] == [("Ann Lee", "3:04 PM", "hello there, all\n10:31 AM\nmore of it, so"), ("Unknown User", None, "nobody said this, really"), ("Bo Day", "3:05 PM", "yes, so it is")]
    assert got[2].thread_info == "2 replies" and [(x.name, x["count"]) for x in got[2].reactions] == [("tada", 4)]
    assert str(got[0].msg_date) == "2024-06-08 00:00:00"


def seen_by(monkeypatch, module, name):
    """Frames that reach an operator."""
    frames, f = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *a, **b: frames.append(df) or f(df, *a, **b))
    return frames


def test_format_sees_all_turns(spark, sf_dir, monkeypatch):
    from chatframe.plans import queries

    frames = seen_by(monkeypatch, detect, "classify")
    kinds = ["dm", "thread", "bracket", "channel", "standard"]
    assert all(r.format == kinds[r.conv_id % 5] for r in queries.det_format(spark, sf_dir).collect())
    raw = {r.conv_id: r.raw for r in frames[0].collect()}
    assert all(r.text in raw[r.conv_id] for r in turns(spark, sf_dir).collect())


def test_queries_see_whole_texts(spark, sf_dir, monkeypatch):
    from chatframe.plans import queries

    whole = [r.text for r in turns(spark, sf_dir).collect()]
    for name, module, operator, col in (("dup_fuzzy", dedup, "drop_similar_messages", "text"), ("enr_pipeline", queries, "enrich_messages", "text"), ("run_fast", pipeline, "run", "raw")):
        frames = seen_by(monkeypatch, module, operator)
        queries.QUERIES[name](spark, sf_dir)
        seen = [r[0] for r in frames[0].select(col).collect()]
        assert all(any(x in y for y in seen) for x in whole), name


def test_long_texts_stay_linear(spark):
    """Unbounded repeats before a back-reference once ended the executor on texts like these."""
    from chatframe.functions import enrich, names

    caps = "AnnaAnna " + " ".join(f"Word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(700_000))
    prose = "AnnaAnna " + "the quick brown fox jumps over it. " * 150_000
    df = spark.createDataFrame([(caps,), (prose,)], "x string")
    got = df.select(F.length(enrich.undouble_in_text(F.col("x"))).alias("n")).collect()
    assert [r.n for r in got] == [len(caps) - 4, len(prose) - 4 - 1]
    assert df.select(lines.has_user_time(F.col("x")).alias("t")).where("t").count() == 0
    short = spark.createDataFrame([("Ann LeeAnn Lee",), ("Ann Lee Ann Lee",), ("AnnAnn",), ("word word WORD word",)], "x string")
    assert [r.y for r in short.select(names.undouble(F.col("x")).alias("y")).collect()] == ["Ann Lee", "Ann Lee", "Ann", "word word"]


def test_title_veto(spark):
    """Openings and titles that no name is, and names that look a little like them."""
    no = ["One thing", "Went to town", "Hello", "Nice", "Oh interesting", "Release information", "New ideas, again", "Happiness Report"]
    yes = ["Ada Lovell", "Ludwig van Beethoven", "Maria da Silva", "Clarence Holm", "Bo"]
    df = spark.createDataFrame([(x,) for x in no + yes], "x string")
    got = {r.x: r.n for r in df.select("x", fallback.line_scores(F.col("x"))["name"].alias("n")).collect()}
    assert all(got[x] == 0 for x in no) and all(got[x] > 0 for x in yes)


def test_scratch_removes_what_was_stored(spark):
    import os

    from chatframe.storage import scratch, store

    with scratch(spark):
        kept, gone = store(spark.range(3), "kept", keep=True), store(spark.range(3), "gone")
        files = kept.inputFiles() + gone.inputFiles()
    there = [os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files]
    assert there == [True] * len(kept.inputFiles()) + [False] * (len(files) - len(kept.inputFiles()))


def test_image_lines_stay_in_messages(spark):
    raw = "Ann Lee  [3:04 PM](https://x.example/archives/C1/p2)\nhello there, all of you\n![a cat](https://x.example/cat.png)\nis it not, well"
    got = pipeline.parse_fallback(spark.createDataFrame([(1, raw)], "conv_id long, raw string"), now()).collect()
    assert "![a cat](https://x.example/cat.png)" in got[0].text
