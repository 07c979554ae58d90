"""The engine's queries by name, each with the SQL that gives the same rows.

The tables hold no chat syntax, so every query first decorates the turns of ``conversations`` by a
fixed rule on (conv_id, turn); the SQL states what must come out of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions import emoji, enrich, names, text, times
from chatframe.operators import continuation, dedup, detect, embed, extract, fallback, guarded, lines, render, segment, standards, stats, validate
from chatframe.operators.diagnostics import Log
from chatframe.operators.enrich import enrich_messages
from chatframe.plans import pipeline
from chatframe.plans.memo import format_memoised
from chatframe.settings import Settings, load_settings
from chatframe.sources.transcripts import author, is_valid_json, json_map, messages_of, read_pastes, read_table, selection_or_paste, transcripts, turns, write_notes, write_pastes
from chatframe.storage import shared_dir, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-06-15 12:00:00"

T = """WITH t AS (
  SELECT conv_id, turn::INTEGER AS turn, role, text,
         CASE role WHEN 'user' THEN 'Ada Lovell' WHEN 'assistant' THEN 'Ben Ortiz' WHEN 'system' THEN 'Cleo Marsh' ELSE 'Dan Brook' END AS username,
         (turn % 12 + 1)::VARCHAR || ':' || lpad(((conv_id * 7 + turn) % 60)::VARCHAR, 2, '0') || CASE WHEN turn % 2 = 0 THEN ' AM' ELSE ' PM' END AS ts,
         '](https://chat.example/archives/C1/p' || (conv_id * 1000 + turn)::VARCHAR || ')' AS link
  FROM conversations),
h AS (SELECT *, username || '  [' || ts || link AS head, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS n FROM t)
"""
NL = "chr(10)"
LINES = f", l AS (SELECT conv_id, line_no::INTEGER AS line_no, x FROM (SELECT conv_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT conv_id, string_split(string_agg(head || {NL} || text, {NL} ORDER BY turn), {NL}) AS ls FROM h GROUP BY conv_id)))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = T + sql
        return f

    return add


def on_text(name: str, made: Callable[[], Column], f: Callable[[Column], Column], sql_made: str, sql: str) -> None:
    """A scalar operator on decorated turns: (conv_id, turn, result, modified)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = turns(spark, sf_dir).select("conv_id", "turn", made().alias("made"))
        rows = rows.select("conv_id", "turn", "made", f(F.col("made")).alias("result"))
        return rows.select("conv_id", "turn", "result", (~F.col("result").eqNullSafe(F.col("made"))).alias("modified"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = T + f"SELECT conv_id, turn, ({sql}) AS result, ({sql}) IS DISTINCT FROM ({sql_made}) AS modified FROM t"


def c(name: str) -> Column:
    return F.col(name)


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def as_prose(end: str = "; good?") -> Column:
    """The turn's whole text, each of its lines between words that no name or header has."""
    return cat("so it is, said ", F.replace(c("text"), F.lit("\n"), F.lit(f"{end}\nso it is, said ")), end)


def prose_sql(end: str = "; good?", break_: str = "chr(10)") -> str:
    return f"'so it is, said ' || replace(text, chr(10), '{end}' || {break_} || 'so it is, said ') || '{end}'"


def with_headers(rows: DataFrame, head: Column, body: Column) -> DataFrame:
    """(conv_id, raw): turns as pasted chat under any header."""
    said = rows.select("conv_id", c("msg_idx").alias("turn"), cat(head, "\n", body).alias("said"))
    joined = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("s"))
    return joined.select("conv_id", F.array_join(F.transform("s", lambda x: x["said"]), "\n").alias("raw"))


def by_number(number: Column, cases: list[Column]) -> Column:
    out = cases[-1]
    for i in reversed(range(len(cases) - 1)):
        out = F.when(number == i, cases[i]).otherwise(out)
    return out


def digest(x: Column, before: str, after: str = "") -> Column:
    """An operator's result with what is between its decoration as md5. The operator sees and gives
    the whole text; a result whose decoration isn't intact stays as it is."""
    inner = F.substr(x, F.lit(len(before) + 1), F.length(x) - len(before) - len(after))
    return F.when(x.startswith(before) & x.endswith(after), cat(before, F.md5(inner), after)).otherwise(x)


# --- sources, sinks, admission -------------------------------------------------------------------
@query(f"SELECT conv_id, string_agg(head || {NL} || text, {NL} ORDER BY turn) AS raw FROM h GROUP BY conv_id")
def src_transcripts(spark, sf_dir):
    return transcripts(turns(spark, sf_dir))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'pasted; ' || text WHEN text = '' THEN 'pasted; ' ELSE text END AS raw, turn % 3 <> 0 AND text <> '' AS selected FROM t")
def src_selection(spark, sf_dir):
    """The selected text, else the paste: where nothing is selected, or an empty stretch."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.when(c("turn") % 6 == 0, F.lit(None).cast("string")).when(c("turn") % 6 == 3, "").otherwise(c("text")).alias("selection"), cat("pasted; ", c("text")).alias("paste"))
    raw = selection_or_paste(c("selection"), c("paste"))
    return rows.select("conv_id", "turn", raw.alias("raw"), (raw == c("selection")).eqNullSafe(F.lit(True)).alias("selected"))


@query("""SELECT turn % 4 AS stored, max(CASE turn % 4 WHEN 0 THEN 5000 WHEN 1 THEN 7 WHEN 2 THEN 5000 ELSE 9 END) AS max_lines, bool_and(turn % 4 <> 2) AS emoji, count(*) AS texts, count(*) FILTER (turn % 4 <> 2) AS converted FROM t GROUP BY ALL""")
def src_settings(spark, sf_dir):
    """Turns under four stored settings: defaults are overlaid, nulls and unknown names left out; which
    steps they enable is reported, and only enabled ones change a text."""
    stored = [{}, {"max_lines": 7, "debug": None}, {"replace_emoji": False, "unknown": 1}, {"max_lines": 9, "replace_emoji": True}]
    found = messages_of(turns(spark, sf_dir)).withColumn("text", cat("so, ", c("text"), " :smile:"))
    parts = []
    for k, values in enumerate(stored):
        settings = load_settings(values)
        shown = enrich_messages(found.where(c("msg_idx") % 4 == k), settings)
        counts = shown.agg(F.count("*").alias("texts"), F.count_if(c("text").endswith(" 😄")).alias("converted"))
        parts.append(counts.where("texts > 0").select(F.lit(k).alias("stored"), F.lit(settings.max_lines).alias("max_lines"), F.lit(enrich.step_report(settings)["emoji"]).alias("emoji"), "texts", "converted"))
    return reduce(DataFrame.union, parts)


@query(f"SELECT conv_id, string_agg(head || {NL} || text, {NL} ORDER BY turn) AS raw FROM h GROUP BY conv_id")
def src_text_files(spark, sf_dir):
    """Transcripts as text files, one each, and read back with their paths."""
    path = f"{shared_dir(spark)}/chatframe-pastes-{uuid.uuid4().hex}"
    write_pastes(transcripts(turns(spark, sf_dir)), path)
    rows = read_pastes(spark, f"{path}/*")
    return rows.select(F.regexp_extract("file", r"conv_id=(-?\d+)", 1).cast("bigint").alias("conv_id"), F.regexp_replace("raw", r"\n\z", "").alias("raw"))


@query(f"SELECT conv_id, string_agg(head || {NL} || text, {NL} ORDER BY turn) AS raw FROM h GROUP BY conv_id")
def snk_notes_table(spark, sf_dir):
    """Texts through the sink as a table and back through the source."""
    path = f"{shared_dir(spark)}/chatframe-notes-{uuid.uuid4().hex}"
    write_notes(transcripts(turns(spark, sf_dir)).withColumnRenamed("raw", "note"), path)
    return read_table(spark, path, raw_col="note")


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN -1 ELSE -1 END AS n_keys,
  CASE turn % 5 WHEN 0 THEN role END AS value, turn % 5 <> 4 AS valid FROM t""")
def src_json_map(spark, sf_dir):
    made = F.when(c("turn") % 5 == 0, cat('{"k": "', c("role"), '"}')).when(c("turn") % 5 == 1, " ").when(c("turn") % 5 == 2, cat('{"k": ', c("turn"), "}")).when(c("turn") % 5 == 3, '["a"]').otherwise("{broken")
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made")).select("conv_id", "turn", json_map(c("made")).alias("m"), is_valid_json(c("made")).alias("valid"))
    return rows.select("conv_id", "turn", F.coalesce(F.size("m"), F.lit(-1)).alias("n_keys"), F.try_element_at("m", F.lit("k")).alias("value"), "valid")


@query("""SELECT conv_id, turn, conv_id % 4 >= 2 AS is_likely, CASE WHEN conv_id % 4 >= 2 THEN 'format' ELSE 'passthrough' END AS route FROM t""")
def adm_gate(spark, sf_dir):
    made = F.when(c("conv_id") % 4 == 0, c("text")).when(c("conv_id") % 4 == 1, cat(c("text"), " :smile:")).when(c("conv_id") % 4 == 2, cat(c("text"), " :smile: 3:04 PM")).otherwise(cat(c("text"), " View thread, 3 replies"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made"))
    return rows.select("conv_id", "turn", detect.is_likely_chat(c("made")).alias("is_likely"), detect.route(c("made"), "interceptCmdV").alias("route"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 200 = 0 THEN '❌ **Input too large**: 5.00MB exceeds maximum limit of 5.00MB.' || chr(10) || chr(10) || 'Please break the content into smaller chunks or reduce the text size.'
  WHEN turn = 0 AND conv_id % 50 = 1 THEN '❌ **Too many lines**: 60001 lines exceeds maximum limit of 50000.' || chr(10) || chr(10) || 'Please reduce the content or split into smaller sections.' END AS error FROM t""")
def adm_size(spark, sf_dir):
    first = c("turn") == 0
    made = F.when(first & (c("conv_id") % 200 == 0), F.repeat(F.lit("x"), F.lit(5242881))).when(first & (c("conv_id") % 50 == 1), F.repeat(F.lit("\n"), F.lit(60000))).otherwise(c("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", made.alias("made")).select("conv_id", "turn", detect.admission_error(c("made")).alias("error"))


@query(f"SELECT conv_id, '---' || {NL} || 'cssclasses: slack-conversation' || {NL} || 'participants: ' || count(DISTINCT username) || {NL} || 'messages: ' || count(*) || {NL} || 'format: unknown' || {NL} || 'date: 2024-06-15' || {NL} || '---' || {NL} || {NL} || string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> ' || replace(text, {NL}, {NL} || '> '), {NL} || {NL} ORDER BY turn) AS note FROM t GROUP BY conv_id")
def snk_frontmatter(spark, sf_dir):
    found = messages_of(turns(spark, sf_dir))
    return render.notes(render.render_conversations(found, None, now()), stats.conversation_stats(found), "2024-06-15")


@query("SELECT conv_id, count(*) || ' messages • ' || count(DISTINCT username) || ' participants • unknown format' AS preview FROM t GROUP BY conv_id")
def snk_preview(spark, sf_dir):
    return render.preview_line(stats.conversation_stats(messages_of(turns(spark, sf_dir))))


@query(LINES + """, k AS (SELECT l.* FROM l WHERE trim(x) <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = l.conv_id AND trim(t.text) = trim(l.x)))
SELECT conv_id, line_no, x AS content, count(*) OVER (PARTITION BY conv_id) AS total FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY line_no) <= 50""")
def snk_unparsed_anti(spark, sf_dir):
    """Header lines, and lines of texts of several lines, are no message's whole text."""
    rows = turns(spark, sf_dir)
    return render.unparsed_lines(lines.explode_lines(transcripts(rows)), messages_of(rows))


@query(f"SELECT conv_id, '>[!warning]+ Slack Formatting Error' || {NL} || '> Failed to parse this content as Slack conversation.' || {NL} || '> Error: odd' || {NL} || '>' || {NL} || '> **Original Content:**' || {NL} || '>' || {NL} || '> ```' || {NL} || array_to_string(list_transform(ls[1:100], lambda x: '> ' || x), {NL}) || CASE WHEN len(ls) > 100 THEN {NL} || '> ... and ' || (len(ls) - 100) || ' more lines' ELSE '' END || {NL} || '> ```' || {NL} || '>' || {NL} || '> **Detected Elements:**' || {NL} || '> - User mentions: ' || k || {NL} || '> - Timestamps: ' || k AS markdown FROM (SELECT conv_id, count(*) AS k, string_split(string_agg(head || ' <@U1>' || {NL} || text, {NL} ORDER BY turn), {NL}) AS ls FROM h GROUP BY conv_id)")
def snk_failure(spark, sf_dir):
    """Whole transcripts with a mention behind each header."""
    raw = F.regexp_replace("raw", r"(/archives/C1/p\d+\))(?=\n)", "$1 <@U1>")
    return pipeline.render_failures(transcripts(turns(spark, sf_dir)).select("conv_id", raw.alias("raw"), F.lit("odd").alias("error")))


# --- normalisation -------------------------------------------------------------------------------
on_text("nrm_preprocess", lambda: cat("\t ", c("text"), "\r\n", F.repeat(F.lit("\n"), c("turn") % 4 + 1), "​end﻿  "), text.preprocess,
        "chr(9) || ' ' || text || chr(13) || chr(10) || repeat(chr(10), turn % 4 + 1) || chr(8203) || 'end' || chr(65279) || '  '", "text || chr(10) || chr(10) || 'end'")
on_text("nrm_sanitise", lambda: cat("“", c("text"), "” — it’s…  é\n  keep   it"), lambda x: text.sanitise(x),
        "chr(8220) || text || chr(8221) || ' — it’s…  e' || chr(769) || chr(10) || '  keep   it'", "'\"' || text || '\" -- it''s... ' || chr(233) || chr(10) || '  keep   it'")
on_text("nrm_whitespace", lambda: cat("  ", c("text"), "\t\tx  y "), text.normalise_whitespace, "'  ' || text || chr(9) || chr(9) || 'x ' || chr(160) || 'y '", "text || ' x y'")
on_text("nrm_clean", lambda: cat(" ", c("text"), "\r\nx\ry\t"), text.clean_text, "' ' || text || chr(13) || chr(10) || 'x' || chr(13) || 'y' || chr(9)", "text || chr(10) || 'x' || chr(10) || 'y'")
on_text("nrm_first_lines", lambda: cat(c("text"), F.repeat(F.lit("\nx "), c("turn") % 5 + 20)), lambda x: text.first_lines(x, 8),
        "text || repeat(chr(10) || 'x ', turn % 5 + 20)", "rtrim(array_to_string((string_split(text || repeat(chr(10) || 'x ', turn % 5 + 20), chr(10)))[1:8], chr(10)))")


@query("SELECT conv_id, turn, turn % 3 <> 0 AS has_text FROM t")
def nrm_has_text(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.has_text(F.when(c("turn") % 3 == 0, F.lit(" \t\n\x01")).otherwise(c("text"))).alias("has_text"))


@query(f"SELECT conv_id, string_agg(head || {NL} || text, {NL} ORDER BY turn) AS raw FROM h GROUP BY conv_id")
def nrm_block_dedup(spark, sf_dir):
    return dedup.drop_repeated_blocks(transcripts(turns(spark, sf_dir)).select("conv_id", cat(c("raw"), "\n", c("raw")).alias("raw")))


# --- lines ---------------------------------------------------------------------------------------


@query(LINES + r"""SELECT conv_id, line_no, x AS content, length(x)::INTEGER AS length, length(x) < 25 AS is_short, length(x) > 100 AS is_long, regexp_matches(x, '^[A-Z]') AS has_capital, regexp_matches(x, '\d') AS has_digit,
  regexp_matches(x, '[!@#$%^&*(),.?":{}|<>]') AS has_special, regexp_matches(x, 'https?://|www\.', 'i') AS has_url,
  regexp_matches(x, '^\d+\s+(?:reply|replies|files?|minutes?|hours?|days?)$|^(?:View thread|Thread:|Last reply|Language|TypeScript|Last updated)$|^Added by\s+', 'i') OR regexp_matches(x, '^:\w+:\s*\d*$|^\d+$|^(?:---+|===+)$|^https?://') AS is_meta,
  lag(x) OVER w AS prev_line, lead(x) OVER w AS next_line FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)""")
def lf_lines(spark, sf_dir):
    found = lines.with_features(lines.explode_lines(transcripts(turns(spark, sf_dir))))
    return found.select("conv_id", "line_no", "content", "length", "is_short", "is_long", "has_capital", "has_digit", "has_special", "has_url", "is_meta", "prev_line", "next_line")


@query("""SELECT conv_id, turn, turn % 7 = 0 AS is_section, turn % 7 = 1 AS is_thread, turn % 7 IN (2, 5) AS has_url, turn % 7 = 3 AS has_mention, turn % 7 = 4 AS has_emoji, turn % 7 = 4 AS is_reaction, turn % 7 = 5 AS has_avatar, turn % 7 IN (1, 4, 5) AS is_meta FROM t""")
def lf_marks(spark, sf_dir):
    """Sections, thread lines, links, mentions, emoji, reactions, avatars, metadata, and prose that is none of them."""
    made = by_number(c("turn") % 7, [F.lit("#GENERAL#"), cat(c("turn"), " replies"), cat("see https://ex.org/", c("turn")), cat(c("text"), " @bob"), cat(":tada: ", c("turn")), cat("![](https://ca.slack-edge.com/", c("turn"), ".png)"), cat("so, ", c("text"))])
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made"))
    marks = {"is_section": lines.is_section, "is_thread": lines.is_thread_info, "has_url": lines.has_url, "has_mention": lines.has_mention, "has_emoji": lines.has_emoji, "is_reaction": lines.is_reaction, "has_avatar": lines.has_avatar, "is_meta": lines.is_metadata}
    return rows.select("conv_id", "turn", *[f(c("made")).alias(n) for n, f in marks.items()])


@query(LINES + r"""SELECT conv_id, line_no, regexp_matches(x, '\[\d{1,2}:\d{2}(?:\s*(?:AM|PM))?\]|^\s*\d{1,2}:\d{2}\s*(?:AM|PM)?\s*$|\d{1,2}:\d{2}\s*(?:AM|PM)', 'i')
  OR (regexp_matches(x, '\d{1,2}:\d{2}|\b(?:today|yesterday|monday|tuesday|wednesday|thursday|friday|saturday|sunday|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b', 'i')
      AND NOT regexp_matches(x, '\b(?:wanted|needed|mention|tracking|happens|related|finding|should|fixed|errors|after|switching|btw)\b|\[\[.*?\]\]|.{100,}', 'i')) AS has_ts,
  regexp_matches(x, '\w+.*(?:\d{1,2}:\d{2}|\[\d{1,2}:\d{2}\s*(?:AM|PM)?\](?:\([^)]+\))?|\[.*\].*archives)') AS user_time FROM l""")
def lf_times(spark, sf_dir):
    found = lines.explode_lines(transcripts(turns(spark, sf_dir)))
    return found.select("conv_id", "line_no", lines.has_timestamp(c("trimmed")).alias("has_ts"), lines.has_user_time(c("trimmed")).alias("user_time"))


@query("SELECT conv_id, turn, turn % 4 <> 3 AS is_cont FROM t")
def lf_continuation(spark, sf_dir):
    made = F.when(c("turn") % 4 == 0, "3:04 PM").when(c("turn") % 4 == 1, cat("[3:04](https://ex.org/", c("turn"), ")")).when(c("turn") % 4 == 2, "See more").otherwise(cat("so ", c("text")))
    return turns(spark, sf_dir).select("conv_id", "turn", lines.is_continuation_shape(made).alias("is_cont"))


@query("SELECT conv_id, turn, turn % 4 < 2 AS is_name, turn % 4 = 1 AS is_doubled FROM t")
def lf_names(spark, sf_dir):
    """A name, a doubled name (a name as well), a sentence, and the turn's prose."""
    who, k = c("username"), c("msg_idx") % 4
    made = F.when(k == 0, who).when(k == 1, cat(who, "_x", who, "_x")).when(k == 2, cat(who, " is at the door")).otherwise(cat("so, ", c("text"), "; good?"))
    rows = messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), made.alias("made"))
    return rows.select("conv_id", "turn", lines.looks_like_name(c("made")).alias("is_name"), lines.is_doubled_name(c("made")).alias("is_doubled"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS name_time, CASE turn % 4 WHEN 2 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS day, CASE turn % 4 WHEN 3 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS metadata FROM t")
def fb_line_scores(spark, sf_dir):
    made = F.when(c("turn") % 4 == 0, "Ada Lovell  3:04 PM").when(c("turn") % 4 == 1, cat("and so, ", c("text"))).when(c("turn") % 4 == 2, "--- June 8th ---").otherwise(cat(c("turn"), " replies"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", fallback.line_scores(made).alias("s"))
    return rows.select("conv_id", "turn", c("s.name_time").alias("name_time"), c("s.date").alias("day"), c("s.metadata").alias("metadata"))


@query(f"SELECT conv_id, n AS msg_idx, username, ts AS ts_text, {prose_sql()} AS text FROM h")
def fb_parse(spark, sf_dir):
    """The fallback parser on transcripts."""
    rows = turns(spark, sf_dir).withColumn("text", as_prose())
    return pipeline.parse_fallback(pipeline.admitted(transcripts(rows))).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {prose_sql()} || chr(10) || chr(10) || '📎 2 files - Added by X' ELSE {prose_sql()} END AS text, CASE turn % 3 WHEN 1 THEN 1 ELSE 0 END AS n_reactions, CASE turn % 3 WHEN 2 THEN '3 replies View thread' END AS thread_info FROM t")
def fb_fields(spark, sf_dir):
    """Attachments, reaction pairs and thread information below a text, one conversation each. A
    reaction on one line is metadata that the block machine leaves out."""
    k = c("turn") % 3
    more = F.when(k == 0, "\n2 files\nAdded by X").when(k == 1, "\n:tada:\n3\n:smile: 2").otherwise("\n3 replies\nView thread")
    rows = turns(spark, sf_dir).select((c("conv_id") * 100000 + c("turn")).alias("conv_id"), cat("Ada Lovell  [3:04 PM](https://chat.example/archives/C1/p1)\n", as_prose(), more).alias("raw"))
    rows = fallback.fallback_messages(rows, now())
    return rows.select(F.floor(c("conv_id") / 100000).alias("conv_id"), (c("conv_id") % 100000).cast("int").alias("turn"), "text", F.size("reactions").alias("n_reactions"), "thread_info")


@query("SELECT conv_id, (conv_id % 3 = 0) OR (count(*) > 0 AND conv_id % 3 = 1) AS use_fallback FROM t GROUP BY conv_id")
def fb_quality(spark, sf_dir):
    found = messages_of(turns(spark, sf_dir)).where("conv_id % 3 <> 0").withColumn("text", F.when(c("conv_id") % 3 == 1, "brief").otherwise(cat("a longer text: ", c("text"))))
    return fallback.quality(transcripts(turns(spark, sf_dir)), found)


# --- classification ------------------------------------------------------------------------------
@query("SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'dm' WHEN 1 THEN 'thread' WHEN 2 THEN 'bracket' WHEN 3 THEN 'channel' ELSE 'standard' END AS format, CASE conv_id % 5 WHEN 0 THEN 'COMPACT' WHEN 1 THEN 'DETAILED' ELSE 'CONVERSATION' END AS standard_type FROM t GROUP BY conv_id")
def det_format(spark, sf_dir):
    """All turns of a conversation, whole, each behind the decoration."""
    kinds = ["[3:04](https://x.example/archives/D1AB/p17)\nso, ", "[Monday](https://x.example/p1?thread_ts=1)\n3 replies\nthread_ts=\nso, ", "[Message from Ada]\n[Time: 3:04 PM]\nso, ", "#general-talk\nAda joined the channel\nBen set the channel\nso, ", "so, "]
    made = F.lit(kinds[4])
    for i, k in enumerate(kinds[:4]):
        made = F.when(c("conv_id") % 5 == i, k).otherwise(made)
    said = turns(spark, sf_dir).select("conv_id", "turn", cat(made, c("text")).alias("said"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("s"))
    return detect.classify(rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["said"]), "\n").alias("raw"))).select("conv_id", "format", detect.standard_type(c("format")).alias("standard_type"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'dm' WHEN 1 THEN 'thread' WHEN 2 THEN 'channel' ELSE 'standard' END AS vote FROM t")
def det_vote(spark, sf_dir):
    made = F.when(c("conv_id") % 4 == 0, cat(c("text"), " /archives/D1A/")).when(c("conv_id") % 4 == 1, cat(c("text"), " 3 replies")).when(c("conv_id") % 4 == 2, cat(c("text"), " /archives/C1A/")).otherwise(c("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", detect.vote_format(made).alias("vote"))


# --- segmentation and fields ---------------------------------------------------------------------
@query("SELECT conv_id, n AS msg_idx, username, ts AS ts_text, text FROM h")
def seg_roundtrip(spark, sf_dir):
    return segment.header_segments(transcripts(turns(spark, sf_dir))).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query(f"SELECT conv_id, n AS msg_idx, username, ts AS ts_text, {prose_sql()} AS text FROM h")
def seg_primary(spark, sf_dir):
    """The primary parser on transcripts whose texts' lines can't be taken for headers."""
    rows = turns(spark, sf_dir).withColumn("text", as_prose())
    return pipeline.parse_primary(pipeline.admitted(transcripts(rows))).select("conv_id", "msg_idx", "username", "ts_text", "text")


def headers() -> list[Column]:
    """The header grammars that a conversation can have: on one line, over two or three, doubled names,
    codes, avatars, applications, dates, roles."""
    n, at, link = c("username"), c("ts_text"), "](https://chat.example/archives/C1/p1)"
    first = F.split_part(n, F.lit(" "), F.lit(1))
    return [
        cat(n, "  [", at, link), cat(n, n, "\n  ", at), cat(n, "\n  ", at), cat(n, "  ", at), cat(n, "  [", at, "]"), cat(n, n, "  [Feb 6th at ", at, link),
        cat("![](https://ca.slack-edge.com/a.png)\n", n, n, "![:e:](https://ex.org/e.png)  [Monday at ", at, link), cat(n, "\n:code:  ", at), cat(n, "\n", n, "\n  ", at),
        cat(" (https://x.slack.com/services/B1)", first, "\n", first, "\nAPP  Feb 6th at ", at), cat(n, "\n", n, "  Feb 6th at ", at), cat(n, "\nTeam Lead  ", at),
    ]


@query(f"SELECT conv_id, n AS msg_idx, CASE WHEN conv_id % 12 = 9 THEN split_part(username, ' ', 1) ELSE username END AS username, CASE WHEN conv_id % 12 IN (5, 9) THEN 'Feb 6th at ' WHEN conv_id % 12 = 6 THEN 'Monday at ' ELSE '' END || ts AS ts_text, {prose_sql()} AS text FROM h")
def seg_grammars(spark, sf_dir):
    """The primary parser over twelve header grammars."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    return pipeline.parse_primary(pipeline.admitted(with_headers(rows, by_number(c("conv_id") % 12, headers()), c("text")))).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query(f"SELECT conv_id, n AS msg_idx, username, CASE conv_id % 7 WHEN 5 THEN 'Feb 6th at ' WHEN 6 THEN 'Monday at ' ELSE '' END || ts AS ts_text, {prose_sql()} AS text FROM h")
def fb_grammars(spark, sf_dir):
    """The fallback parser over the grammars it knows."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    return pipeline.parse_fallback(pipeline.admitted(with_headers(rows, by_number(c("conv_id") % 7, headers()[:7]), c("text")))).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query(f"""SELECT conv_id, n AS msg_idx, username, CASE WHEN conv_id % 4 <> 3 OR n % 2 = 0 THEN ts END AS ts_text, {prose_sql()} || CASE conv_id % 4 WHEN 1 THEN {NL} || {NL} || '3:09 PM' || {NL} || {NL} || 'so it is, said it; good?'
  WHEN 2 THEN {NL} || {NL} || 'Feb 6th at' || {NL} || '3:04 PM' || {NL} || 'so it is, said it; good?' ELSE '' END AS text, CASE WHEN conv_id % 4 = 0 AND n > 0 THEN 'https://ca.slack-edge.com/b' || turn || '.png' END AS avatar FROM h""")
def fb_refine(spark, sf_dir):
    """Blocks refined: an avatar above a header is that author's, a block of a time alone or of a date split
    from its time goes on with the message before, a name alone begins a message without a time."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    k, head = c("conv_id") % 4, headers()[0]
    alone = (k == 3) & ((F.row_number().over(W.partitionBy("conv_id").orderBy("msg_idx")) - 1) % 2 == 1)
    rows = rows.withColumn("head", F.when(k == 0, cat("![](https://ca.slack-edge.com/b", c("msg_idx"), ".png)\n", head)).when(alone, cat("\n", c("username"))).otherwise(head))
    body = cat(c("text"), F.when(k == 1, "\n\n3:09 PM\n\nso it is, said it; good?").when(k == 2, "\n\nFeb 6th at\n3:04 PM\nso it is, said it; good?").otherwise(""))
    return fallback.fallback_messages(pipeline.admitted(with_headers(rows, c("head"), body)), now()).select("conv_id", "msg_idx", "username", "ts_text", "text", "avatar")


@query(f"""SELECT conv_id, n AS msg_idx, username, {prose_sql()} AS text, (make_date(2023 - (conv_id % 2)::INTEGER, ((turn - turn % 3) % 12 + 1)::INTEGER, 8))::VARCHAR AS day,
  (make_date(2023 - (conv_id % 2)::INTEGER, ((lt - lt % 3) % 12 + 1)::INTEGER, 8))::VARCHAR AS last_day FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS lt FROM h)""")
def fb_dates(spark, sf_dir):
    """Several separators in a conversation, in two years: a message has the date of the last one above it,
    or, as the survey's parser has it, all have that of the last one."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    month = F.element_at(F.array(*map(F.lit, "January February March April May June July August September October November December".split())), (c("msg_idx") - c("msg_idx") % 3) % 12 + 1)
    head = cat(F.when(c("msg_idx") % 3 == 0, cat("--- ", month, " 8, ", 2023 - c("conv_id") % 2, " ---\n")).otherwise(""), headers()[0])
    found = fallback.fallback_messages(pipeline.admitted(with_headers(rows, head, c("text"))), now(), as_of=None)
    day = lambda d: F.to_date(d).cast("string")
    return found.select("conv_id", "msg_idx", "username", "text", day("as_of_date").alias("day"), day("msg_date").alias("last_day"))


@query(f"""SELECT conv_id, n AS msg_idx, username, ts AS ts_text, {prose_sql()} || repeat({NL} || 'so it goes, said they; good?', 6) || {NL} || CASE conv_id % 7 WHEN 0 THEN '[3:09](https://chat.example/archives/C1/p9)' WHEN 1 THEN '3:09 PM' WHEN 2 THEN '[3:09 PM]' WHEN 3 THEN 'See more' WHEN 4 THEN 'Also,'
  WHEN 5 THEN 'Today at 3:09 PM' ELSE '' END || {NL} || 'and so it goes on, said nobody; good?' AS text, CASE WHEN conv_id % 7 = 6 THEN 1 ELSE 0 END AS n_reactions FROM h""")
def seg_continuations(spark, sf_dir):
    """Lines that carry on a message stay in it; reactions and metadata below it don't. They stand below
    the first lines: a message that has one there joins an earlier message of its author."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    middle = by_number(c("conv_id") % 7, [F.lit(x) for x in ("[3:09](https://chat.example/archives/C1/p9)", "3:09 PM", "[3:09 PM]", "See more", "Also,", "Today at 3:09 PM", "\n3 replies")])
    body = cat(c("text"), F.repeat(F.lit("\nso it goes, said they; good?"), F.lit(6)), "\n", middle, "\nand so it goes on, said nobody; good?", F.when(c("conv_id") % 7 == 6, "\n😄 4\nView thread").otherwise(""))
    found = pipeline.parse_primary(pipeline.admitted(with_headers(rows, headers()[0], body)))
    return found.select("conv_id", "msg_idx", "username", "ts_text", "text", F.size("reactions").alias("n_reactions"))


@query(f"SELECT conv_id, n AS msg_idx, username, ts AS ts_text, {prose_sql()} || CASE conv_id % 7 WHEN 0 THEN {NL} || '[3:09](https://chat.example/archives/C1/p9)' WHEN 1 THEN {NL} || '3:09 PM' WHEN 2 THEN {NL} || '[3:09 PM]' WHEN 3 THEN {NL} || 'See more' WHEN 4 THEN {NL} || 'Also,' ELSE '' END || {NL} || 'and so it goes on, said nobody; good?' AS text, CASE conv_id % 7 WHEN 5 THEN '3 replies' WHEN 6 THEN 'View thread' END AS thread_info FROM h")
def fb_continuations(spark, sf_dir):
    """The fallback parser keeps lines that carry on a message in it, and takes thread lines out."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    middle = by_number(c("conv_id") % 7, [F.lit(x) for x in ("[3:09](https://chat.example/archives/C1/p9)", "3:09 PM", "[3:09 PM]", "See more", "Also,", "3 replies", "View thread")])
    body = cat(c("text"), "\n", middle, "\nand so it goes on, said nobody; good?")
    return pipeline.parse_fallback(pipeline.admitted(with_headers(rows, headers()[0], body))).select("conv_id", "msg_idx", "username", "ts_text", "text", "thread_info")


SPACED_LINES = LINES.replace(f"head || {NL} || text", f"CASE WHEN conv_id % 2 = 1 THEN username || '-Featherstonehaugh' || {NL} || '  ' || ts ELSE head END || {NL} || {prose_sql()} || CASE WHEN turn % 3 = 0 THEN {NL} || {NL} ELSE '' END")


@query(SPACED_LINES + r""", k AS (SELECT *, regexp_matches(x, 'archives/C1/p|-Featherstonehaugh$') AS head, regexp_matches(x, '^\s*\d+:\d+ [AP]M$') AS clock, lag(x) OVER w AS above FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)),
 g AS (SELECT *, count(*) FILTER (head OR clock) OVER (PARTITION BY conv_id ORDER BY line_no) AS nth FROM k),
 a AS (SELECT conv_id, floor(avg(filled) + 0.5) AS average FROM (SELECT conv_id, nth, count(*) FILTER (x <> '') AS filled FROM g GROUP BY conv_id, nth) GROUP BY conv_id),
 s AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY conv_id ORDER BY line_no) AS gap, x LIKE '%-Featherstonehaugh' AND count(*) OVER (PARTITION BY conv_id, x) >= 2 AS common FROM g WHERE head OR clock)
 SELECT conv_id, line_no, 4 + CASE WHEN coalesce(above = '', false) THEN 2 ELSE 0 END + CASE WHEN common THEN 2 ELSE 0 END + CASE WHEN coalesce(gap BETWEEN average * 0.5 AND average * 2, false) THEN 1 ELSE 0 END AS score FROM s JOIN a USING (conv_id)""")
def seg_scores(spark, sf_dir):
    """Starts of messages by how much speaks for them: a time, a capital or a short line; for some a blank
    line above, a name that stands on lines of its own more than once, or a usual distance from the start
    above. Every other conversation has long names with their times on the line below."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", cat(as_prose(), F.when(c("turn") % 3 == 0, "\n\n").otherwise(""))))
    place = cat("](https://chat.example/archives/C1/p", c("conv_id") * 1000 + c("msg_idx"), ")")
    head = F.when(c("conv_id") % 2 == 1, cat(c("username"), "-Featherstonehaugh\n  ", c("ts_text"))).otherwise(cat(c("username"), "  [", c("ts_text"), place))
    return segment.candidate_scores(segment.primary_lines(pipeline.admitted(with_headers(rows, head, c("text")))))


@query(f"""SELECT conv_id, starts, starts AS stamps, CASE WHEN (2 * d + starts) / (3 * d + 2 * starts)::DOUBLE > 0.7 THEN 'standard' ELSE 'mixed' END AS layout, 1.0::DOUBLE AS alignment,
  0.2 + 0.2 * least(1.0, 3.0 / (2 * d + starts)) + CASE WHEN (2 * d + starts) / (3 * d + 2 * starts)::DOUBLE > 0.7 THEN 0.2 ELSE 0.1 END + 0.2 AS confidence
  FROM (SELECT conv_id, count(*) AS starts, count(DISTINCT ts) AS d FROM h GROUP BY conv_id)""")
def seg_diagnostics(spark, sf_dir):
    rows = segment.diagnostics(segment.primary_lines(pipeline.admitted(transcripts(turns(spark, sf_dir).withColumn("text", as_prose())))))
    return rows.select("conv_id", "starts", "stamps", "layout", "alignment", F.round("confidence", 9).alias("confidence"))


@query(ORACLES["seg_grammars"].removeprefix(T))
def seg_chunked(spark, sf_dir):
    """The same with each conversation dealt out by chunks of 4 KiB."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    raw = with_headers(rows, by_number(c("conv_id") % 12, headers()), c("text"))
    return pipeline.parse_chunked(pipeline.admitted(raw), size=4096).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query(f""", m AS (SELECT *, CASE WHEN turn % 4 = 2 THEN 'See more' || {NL} ELSE '' END || {prose_sql()} AS said, min(n) OVER (PARTITION BY conv_id, username) AS f, max(CASE WHEN turn % 4 = 2 THEN n END) OVER (PARTITION BY conv_id, username) AS l FROM h),
 k AS (SELECT conv_id, n, username, ts, CASE WHEN n = f AND l > f THEN said || {NL} || (SELECT string_agg(o.username || '  [' || o.ts || '](https://chat.example/archives/C1/p1)' || {NL} || o.said, {NL} ORDER BY o.n) FROM m o WHERE o.conv_id = m.conv_id AND o.n > m.f AND o.n <= m.l) ELSE said END AS text FROM m WHERE turn % 4 <> 2 OR n = f)
 SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1)::INTEGER AS msg_idx, username, ts AS ts_text, text FROM k""")
def seg_joined(spark, sf_dir):
    """A message that starts with a line that carries on joins the first one of its author, which then goes
    on to its end: intervals overlap, and what is between stays a message of its own as well."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    return pipeline.parse_primary(pipeline.admitted(with_headers(rows, headers()[0], cat(F.when(c("msg_idx") % 4 == 2, "See more\n").otherwise(""), c("text"))))).select("conv_id", "msg_idx", "username", "ts_text", "text")


@query("SELECT conv_id, ts AS spelling FROM t UNION SELECT conv_id, '[' || ts || ']' FROM t UNION SELECT conv_id, '[' || ts || link FROM t")
def seg_spellings(spark, sf_dir):
    return segment.timestamp_spellings(lines.explode_lines(transcripts(turns(spark, sf_dir)))).select("conv_id", "spelling")


@query("SELECT conv_id, rep || ' von und zu Irgendwo' AS username, count(*) AS uses FROM (SELECT conv_id, username AS rep FROM t) GROUP BY ALL HAVING count(*) >= 2")
def seg_common_users(spark, sf_dir):
    rows = messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("line_no"), cat(c("username"), " von und zu Irgendwo").alias("trimmed"))
    rows = rows.select("*", F.lit(True).alias("could_be_user"), F.lit(True).alias("is_name"), F.lit(None).cast("string").alias("author"))
    return segment.common_usernames(rows).select("conv_id", "username", "uses")


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN username WHEN 1 THEN username WHEN 3 THEN username END AS author, CASE turn % 5 WHEN 0 THEN ts WHEN 1 THEN ts END AS author_ts FROM t")
def ext_author(spark, sf_dir):
    """A linked time, a bare clock, a role before a clock, a plain name, and prose."""
    k, who, at = c("msg_idx") % 5, c("username"), c("ts_text")
    made = F.when(k == 0, cat(who, "  [", at, "](https://ex.org)")).when(k == 1, cat(who, "  ", at)).when(k == 2, cat("Team Lead  ", at)).when(k == 3, who).otherwise("and so it is, then.")
    rows = messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), made.alias("trimmed"))
    return extract.with_author(rows).select("conv_id", "turn", "author", "author_ts")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN 'Feb 6th' END AS time FROM t")
def ext_timestamp(spark, sf_dir):
    k, at = c("msg_idx") % 4, c("ts_text")
    made = F.when(k == 0, cat("x [", at, "](https://ex.org)")).when(k == 1, cat("Feb 6th at ", at)).when(k == 2, "on Feb 6th").otherwise("no time")
    return messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), extract.timestamp_of(made).alias("time"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'smile=' || (turn + 1) WHEN 1 THEN '😄=' || (turn + 1) || ',tada=1' ELSE '' END AS reactions FROM t""")
def ext_reactions(spark, sf_dir):
    k = c("turn") % 3
    made = F.when(k == 0, cat(":smile: ", c("turn") + 1)).when(k == 1, cat("😄", c("turn") + 1, " :tada:")).otherwise(c("text"))
    found = F.coalesce(F.array(extract.single_reaction(c("made"))), F.array().cast("array<struct<name:string,count:int>>"))
    found = F.when(extract.single_reaction(c("made")).isNotNull(), found).otherwise(extract.many_reactions(c("made")))
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made")).withColumn("r", found)
    return rows.select("conv_id", "turn", F.array_join(F.transform("r", lambda x: cat(x["name"], "=", x["count"])), ",").alias("reactions"))


@query(f"SELECT conv_id, turn, text || {NL} || {NL} || 'more, too' AS result, 2 AS n_reactions, CASE turn % 3 WHEN 1 THEN '4 replies so far' WHEN 2 THEN 'Thread' END AS thread_info FROM t")
def ext_content(spark, sf_dir):
    """A line that is a count of replies and nothing else, or "View thread", is metadata and leaves no
    thread information; a line that goes on after the count does."""
    made = cat("AnnaAnna\n\n\n", c("text"), "\n\n\n\nView thread\nmore, too\n😄 4\n🎉2\n3 replies", F.when(c("turn") % 3 == 1, "\n4 replies so far").when(c("turn") % 3 == 2, "\nThread").otherwise(""))
    rows = turns(spark, sf_dir).select("conv_id", "turn", extract.split_content(F.split(made, "\n")).alias("x"))
    return rows.select("conv_id", "turn", c("x.text").alias("result"), F.size("x.reactions").alias("n_reactions"), c("x.thread_info").alias("thread_info"))


# --- duplicates and continuations ----------------------------------------------------------------
@query("""SELECT conv_id, msg_idx, username, text FROM (
  SELECT conv_id, turn AS msg_idx, username, ts, text FROM t UNION ALL SELECT conv_id, turn + 1000, username, ts, text FROM t WHERE turn % 3 = 0)
  QUALIFY row_number() OVER (PARTITION BY conv_id, username, ts, trim(substr(text, 1, 100)) ORDER BY msg_idx) = 1""")
def dup_exact(spark, sf_dir):
    found = messages_of(turns(spark, sf_dir))
    twice = found.union(found.where("msg_idx % 3 = 0").withColumn("msg_idx", c("msg_idx") + 1000).select(*found.columns))
    return dedup.drop_equal_messages(twice).select("conv_id", "msg_idx", "username", "text")


@query(r""", p AS (SELECT conv_id, turn, text AS a, left(text, greatest(length(text) - 5, 0)) || 'qzqzq' AS b FROM t),
 s AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(a), '[ \t\r\n]', '', 'g'), ''), lambda x: x <> '')) AS ca, list_distinct(list_filter(string_split(regexp_replace(lower(b), '[ \t\r\n]', '', 'g'), ''), lambda x: x <> '')) AS cb,
   list_distinct(list_filter(string_split_regex(lower(a), '\s+'), lambda w: length(w) > 1 OR regexp_matches(w, '^[a-z0-9]$'))) AS wa, list_distinct(list_filter(string_split_regex(lower(b), '\s+'), lambda w: length(w) > 1 OR regexp_matches(w, '^[a-z0-9]$'))) AS wb FROM p)
 SELECT conv_id, turn, len(list_intersect(ca, cb))::DOUBLE / len(list_distinct(list_concat(ca, cb))) AS chars, len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))) AS words FROM s""")
def dup_jaccard(spark, sf_dir):
    a, b = c("text"), cat(F.left("text", F.greatest(F.length("text") - 5, F.lit(0))), "qzqzq")
    return turns(spark, sf_dir).select("conv_id", "turn", dedup.char_similarity(a, b).alias("chars"), dedup.word_similarity(a, b).alias("words"))


@query("""SELECT conv_id, turn, CASE WHEN abs(length(a) - length(b)) > floor(greatest(length(a), length(b)) * 0.3) OR levenshtein(a, b) > floor(greatest(length(a), length(b)) * 0.3) THEN 0.0::DOUBLE
  ELSE (greatest(length(a), length(b)) - levenshtein(a, b))::DOUBLE / greatest(length(a), length(b)) END AS edit FROM (SELECT conv_id, turn, md5(text) || x AS a, left(md5(text), 28 - turn % 12) || 'qzqz' || left(x, length(x) - length(x) // (turn % 5 + 2)) AS b FROM (SELECT *, regexp_replace(text, '[^ -~]', '?', 'g') AS x FROM t))""")
def dup_edit(spark, sf_dir):
    """Whole texts with another beginning and without a part of their end. Signs beyond ASCII are "?",
    since the SQL counts a letter with an accent as two."""
    x = F.regexp_replace("text", "[^ -~]", "?")
    a = cat(F.md5("text"), x)
    b = cat(F.left(F.md5("text"), 28 - c("turn") % 12), "qzqz", F.left(x, F.length(x) - F.floor(F.length(x) / (c("turn") % 5 + 2)).cast("int")))
    return turns(spark, sf_dir).select("conv_id", "turn", dedup.edit_similarity(a, b).alias("edit"))


@query("SELECT conv_id, turn * 2 AS msg_idx, username, 'so, ' || md5(text) || ' and ' || md5(text || 'x') AS text FROM t")
def dup_fuzzy(spark, sf_dir):
    """Every third message said again by somebody else, word for word or with one letter changed."""
    found = messages_of(turns(spark, sf_dir)).withColumn("text", cat("so, ", c("text"), " and ", c("text"), "x"))
    again = found.where("msg_idx % 3 = 0").withColumns({"msg_idx": c("msg_idx") * 2 + 1, "username": F.lit("Eve Other"), "text": F.when(c("conv_id") % 2 == 0, c("text")).otherwise(F.concat(F.lit("S"), F.substring("text", 2, 1 << 20)))})
    both = found.withColumn("msg_idx", c("msg_idx") * 2).unionByName(again)
    n = F.floor((F.length("text") - 10) / 2).cast("int")
    part = lambda at, size: F.substr(c("text"), at, size)
    said = cat(part(F.lit(1), F.lit(4)), F.md5(part(F.lit(5), n)), part(n + 5, F.lit(5)), F.md5(part(n + 10, F.length("text"))))
    return dedup.drop_similar_messages(both).select("conv_id", "msg_idx", "username", said.alias("text"))


@query(f"""SELECT * FROM (SELECT conv_id, n * 3 AS msg_idx, {prose_sql()} || CASE WHEN n % 3 = 0 THEN {NL} || 'https://ex.org/p' || n || {NL} || 'A title of it and of what it is about, in several words' || {NL} || 'but: and so on it goes, [x]' WHEN n % 3 = 1 THEN {NL} || 'but: and so on it goes, [x]' ELSE '' END AS text FROM h
  UNION ALL SELECT conv_id, n * 3 + 1, CASE n % 3 WHEN 0 THEN 'but: it goes on ' || n || ', [x]' WHEN 1 THEN '- https://ex.org/p' || n || {NL} || 'A title of it and of what it is about, in several words' ELSE 'but: none of it ' || n || ', [x]' END FROM h)""")
def dup_embedded(spark, sf_dir):
    """What is embedded and said twice: of two embedded ones the later goes, and its message keeps what
    else it says; one that another message has, nearly, as its own text goes, though it came first."""
    rows = messages_of(turns(spark, sf_dir).withColumn("text", as_prose()))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("msg_idx")) - 1
    rows = rows.withColumn("n", n)
    preview, end = cat("https://ex.org/p", c("n"), "\nA title of it and of what it is about, in several words"), "\nbut: and so on it goes, [x]"
    first = rows.withColumns({"text": cat(c("text"), F.when(c("n") % 3 < 2, cat("\n", preview, end)).otherwise("")), "msg_idx": c("n") * 3})
    second = rows.withColumns({"text": by_number(c("n") % 3, [cat("but: it goes on ", c("n"), ", [x]\n", preview), cat("- ", preview), cat("but: none of it ", c("n"), ", [x]")]), "msg_idx": c("n") * 3 + 1})
    return dedup.drop_similar_messages(first.unionByName(second)).select("conv_id", "msg_idx", "text")


@query(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'link_preview' WHEN 1 THEN 'file_attachment' WHEN 2 THEN 'reactions' ELSE '' END AS kinds,
  CASE turn % 4 WHEN 3 THEN 'so; ' || md5(text) WHEN 1 THEN 'but: and so on it goes, and on and on, and on [x]' ELSE 'so; ' || md5(text) || {NL} || 'but: and so on it goes, and on and on, and on [x]' END AS cleaned FROM t""")
def emb_blocks(spark, sf_dir):
    """Whole texts; a file block takes in the lines before its first file line, so there the text
    stands on one line."""
    end = "\nbut: and so on it goes, and on and on, and on [x]"
    made = cat("so; ", F.when(c("turn") % 4 == 1, F.replace(c("text"), F.lit("\n"), F.lit(" "))).otherwise(c("text")), F.when(c("turn") % 4 == 0, "\nhttps://ex.org/a\nA title" + end).when(c("turn") % 4 == 1, "\n[file](https://ex.org/f)\nPDF" + end).when(c("turn") % 4 == 2, "\n:tada: 3\n:smile: 2" + end).otherwise(""))
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made")).withColumn("e", embed.embedded(c("made")))
    return rows.select("conv_id", "turn", F.array_join(F.transform("e.blocks", lambda b: b["type"]), ",").alias("kinds"), F.when(c("turn") % 4 == 1, c("e.cleaned")).when(c("turn") % 4 == 3, digest(c("e.cleaned"), "so; ")).otherwise(digest(c("e.cleaned"), "so; ", end)).alias("cleaned"))


@query(f"""SELECT conv_id, min(turn) AS msg_idx, string_agg(x, {NL} || {NL} ORDER BY turn) AS text, count(*) AS pieces FROM (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '3:04 PM' || {NL} || text ELSE text END AS x, max(CASE WHEN turn % 4 <> 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM t) GROUP BY conv_id, coalesce(g, turn)""")
def con_fold(spark, sf_dir):
    part = c("msg_idx") % 4 == 1
    found = messages_of(turns(spark, sf_dir)).withColumns({"username": F.when(part, "Unknown User").otherwise(c("username")), "text": F.when(part, cat("3:04 PM\n", c("text"))).otherwise(c("text"))})
    found = found.withColumn("reactions", F.array(F.struct(F.lit("x").alias("name"), F.lit(1).alias("count"))))
    return continuation.fold_continuations(found).select("conv_id", "msg_idx", "text", F.size("reactions").cast("bigint").alias("pieces"))


# --- enrichment ----------------------------------------------------------------------------------
on_text("enr_escape", lambda: cat(c("text"), " <b> <@U", c("conv_id"), "> <https://ex.org/a|b> &lt;"), enrich.escape_brackets, "text || ' <b> <@U' || conv_id || '> <https://ex.org/a|b> &lt;'", "text || ' &lt;b&gt; <@U' || conv_id || '> <https://ex.org/a|b> &lt;'")
on_text("enr_links", lambda: cat(c("text"), " <https://ex.org/", c("turn"), "|d[o]c> <https://ex.org> <www.ex.org> <mailto:a@b.co>"), enrich.convert_links, "text || ' <https://ex.org/' || turn || '|d[o]c> <https://ex.org> <www.ex.org> <mailto:a@b.co>'",
        r"text || ' [d\[o\]c](https://ex.org/' || turn || ') https://ex.org https://www.ex.org [a@b.co](mailto:a@b.co)'")
on_text("enr_mentions", lambda: cat(c("text"), " <@U1> <@U", c("conv_id"), "XYZ> @bob, a@b.co <!here> [@cy](https://ex.org)"), lambda x: enrich.convert_mentions(x, {"U1": "Ada L"}),
        "text || ' <@U1> <@U' || conv_id || 'XYZ> @bob, a@b.co <!here> [@cy](https://ex.org)'", "text || ' [[Ada L]] [[User-' || substr('U' || conv_id || 'XYZ', 1, 6) || ']] [[bob]], a@b.co **@here** [[cy]]'")
on_text("enr_mentions_masked", lambda: cat(c("text"), "\n@bob  hi, @cy and  @di"), lambda x: enrich.convert_mentions(x, compat=True), "text || chr(10) || '@bob  hi, @cy and  @di'", "text || chr(10) || '[[bob  hi]], [[cy]] and  @di'")
on_text("enr_emoji", lambda: cat(c("text"), " :smile::nope: :own: ![:wave:](https://a.slack-edge.com/w.png) ![](https://a.slack-edge.com/production-standard-emoji-assets/14.0/apple-large/1f44d@2x.png)"), lambda x: emoji.replace_emoji(x, {"own": "🤠"}),
        "text || ' :smile::nope: :own: ![:wave:](https://a.slack-edge.com/w.png) ![](https://a.slack-edge.com/production-standard-emoji-assets/14.0/apple-large/1f44d@2x.png)'", "text || ' 😄:nope: 🤠 👋 👍'")
on_text("enr_threads", lambda: cat(c("text"), " View thread:  https://ex.org/", c("turn")), enrich.link_threads, "text || ' View thread:  https://ex.org/' || turn", "text || ' [View thread](https://ex.org/' || turn || ')'")
on_text("enr_fences", lambda: cat("```  py \n", c("text"), "\n```  x\nafter"), enrich.format_fences, "'```  py ' || chr(10) || text || chr(10) || '```  x' || chr(10) || 'after'", "'```py' || chr(10) || text || chr(10) || '```' || chr(10) || 'after'")
on_text("enr_uploads", lambda: cat("Ada uploaded a file: f", c("turn"), F.when(c("turn") % 4 == 0, ".png").when(c("turn") % 4 == 1, ".pdf").when(c("turn") % 4 == 2, ".py").otherwise(".zip")), enrich.mark_uploads,
        "'Ada uploaded a file: f' || turn || CASE turn % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' WHEN 2 THEN '.py' ELSE '.zip' END",
        "CASE turn % 4 WHEN 0 THEN '🖼️' WHEN 1 THEN '📄' WHEN 2 THEN '💻' ELSE '📎' END || ' Ada uploaded: **f' || turn || CASE turn % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' WHEN 2 THEN '.py' ELSE '.zip' END || '**'")
on_text("enr_images", lambda: F.when(c("turn") % 3 == 0, "Image from iOS").when(c("turn") % 3 == 1, cat("![ ](https://ex.org/", c("turn"), ")")).otherwise(c("text")), enrich.mark_images,
        "CASE turn % 3 WHEN 0 THEN 'Image from iOS' WHEN 1 THEN '![ ](https://ex.org/' || turn || ')' ELSE text END", "CASE turn % 3 WHEN 0 THEN '🖼️ _Image from iOS_' WHEN 1 THEN '![Image](https://ex.org/' || turn || ')' ELSE text END")
on_text("enr_services", lambda: cat(c("text"), " 📎 Added by [Hub](https://ex.org)"), enrich.mark_services, "text || ' 📎 Added by [Hub](https://ex.org)'", "text || ' 📎 _Added by Hub_'")
on_text("enr_previews", lambda: cat("GitHub\nhttps://ex.org/", c("turn"), "\nwhat it is about\n\n", c("text")), enrich.fold_previews, "'GitHub' || chr(10) || 'https://ex.org/' || turn || chr(10) || 'what it is about' || chr(10) || chr(10) || text",
        "'🔗 [GitHub](https://ex.org/' || turn || ') — _what it is about_' || chr(10) || text")
on_text("enr_avatars", lambda: cat("![](https://ca.slack-edge.com/a", c("turn"), ")\n", F.when(c("turn") % 2 == 0, cat("this line is long enough: ", c("text"))).otherwise("short")), enrich.mark_avatars,
        "'![](https://ca.slack-edge.com/a' || turn || ')' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'this line is long enough: ' || text ELSE 'short' END",
        "CASE WHEN turn % 2 = 0 THEN '<!-- Avatar: ![](https://ca.slack-edge.com/a' || turn || ') -->' || chr(10) || 'this line is long enough: ' || text ELSE 'short' END")


@query("SELECT conv_id, turn AS msg_idx, 'so, ' || md5(text) || ' &lt;b&gt; [d](https://ex.org) [[User-U1]] 😄 \"q\"' AS text FROM t")
def enr_pipeline(spark, sf_dir):
    found = messages_of(turns(spark, sf_dir)).withColumn("text", cat("so, ", c("text"), " <b> <https://ex.org|d> <@U1> :smile: “q”"))
    shown = digest(c("text"), "so, ", ' &lt;b&gt; [d](https://ex.org) [[User-U1]] 😄 "q"')
    return enrich_messages(found, Settings()).select("conv_id", "msg_idx", shown.alias("text"))


# --- names, emoji, times -------------------------------------------------------------------------
@query("SELECT conv_id, turn, '😄 ' || turn || ' :nope: 1' AS reactions FROM t")
def emo_reactions(spark, sf_dir):
    made = F.array(F.struct(F.lit("smile").alias("name"), c("turn").alias("count")), F.struct(F.lit("nope").alias("name"), F.lit(1).alias("count")))
    return turns(spark, sf_dir).select("conv_id", "turn", emoji.format_reactions(made).alias("reactions"))


@query("SELECT conv_id, turn, turn % 2 = 0 AS has_emoji, CASE WHEN turn % 2 = 0 THEN 'wave,thumbsup,tada' ELSE '' END AS codes, 'so, ' || md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS bare FROM t")
def emo_codes(spark, sf_dir):
    made = cat("so, ", c("text"), F.when(c("turn") % 2 == 0, " ![:wave:](https://ex.org/w.png) ![](https://a.slack-edge.com/production-standard-emoji-assets/14.0/apple-large/1f44d.png) :tada: :tada: 😄").otherwise(""))
    rows = turns(spark, sf_dir).select("conv_id", "turn", made.alias("made"))
    return rows.select("conv_id", "turn", emoji.contains_emoji(c("made")).alias("has_emoji"), F.array_join(emoji.emoji_codes(c("made")), ",").alias("codes"), digest(emoji.remove_emoji(c("made")), "so, ").alias("bare"))


on_text("usr_undouble", lambda: F.when(c("turn") % 2 == 0, cat(c("role"), c("role"))).otherwise(cat("Ada ", c("role"), "Ada ", c("role"))), names.undouble, "CASE WHEN turn % 2 = 0 THEN role || role ELSE 'Ada ' || role || 'Ada ' || role END", "CASE WHEN turn % 2 = 0 THEN role ELSE 'Ada ' || role END")
on_text("usr_display", lambda: F.when(c("turn") % 2 == 0, cat("_", c("role"), "_of_THE-hill:")).otherwise(cat("mc", F.initcap("role"), "_x")), names.display_name, "CASE WHEN turn % 2 = 0 THEN '_' || role || '_of_THE-hill:' ELSE 'mc' || upper(role[1]) || role[2:] || '_x' END",
        "CASE WHEN turn % 2 = 0 THEN upper(role[1]) || role[2:] || ' Of the Hill' ELSE 'mc' || upper(role[1]) || role[2:] || ' x' END")


@query("SELECT conv_id, turn, md5(username || ' ' || array_to_string(list_transform(range(1, CASE WHEN turn % 8 = 0 THEN 2501 ELSE 51 END), lambda i: 'Word' || i || role), ' ')) AS result FROM t")
def usr_undouble_long(spark, sf_dir):
    """A doubled name before 50 or 2,500 capitalised words."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.when(c("turn") % 8 == 0, 2500).otherwise(50)), lambda i: F.concat(F.lit("Word"), i.cast("string"), c("role"))), " ")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is few bytes, so it is read in few tasks
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role").repartition(parts)
    rows = rows.select("conv_id", "turn", cat(author(c("role")), author(c("role")), " ", words).alias("made"))
    return rows.select("conv_id", "turn", F.md5(enrich.undouble_in_text(c("made"))).alias("result"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'thread' WHEN 2 THEN 'dm' ELSE 'unknown' END AS form, CASE turn % 4 WHEN 0 THEN 'Hub' WHEN 1 THEN username WHEN 2 THEN 'Unknown User' ELSE username END AS name FROM t")
def usr_header(spark, sf_dir):
    k, who, at = c("msg_idx") % 4, c("username"), c("ts_text")
    made = F.when(k == 0, "(https://x.slack.com/services/B1)Hub").when(k == 1, cat(who, who, "![:x:](https://ex.org) [", at, "](https://ex.org)")).when(k == 2, cat("[", at, "](https://ex.org)")).otherwise(who)
    rows = messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), made.alias("made"))
    name = F.when(c("turn") % 4 == 1, names.name_of_thread_header(c("made"))).otherwise(names.extract_name(c("made")))
    return rows.select("conv_id", "turn", names.header_form(c("made")).alias("form"), name.alias("name"))


@query("SELECT conv_id, turn, turn % 4 = 0 AS valid FROM t")
def usr_valid(spark, sf_dir):
    k = c("turn") % 4
    return turns(spark, sf_dir).select("conv_id", "turn", names.is_valid_name(F.when(k == 0, cat("Ada ", c("role"))).when(k == 1, "Monday").when(k == 2, cat(c("turn"))).otherwise("3:04 PM")).alias("valid"))


@query("SELECT conv_id, turn, ltrim(strftime(TIMESTAMP '2024-06-15 00:00:00' + to_minutes(CAST(h * 60 + m + 540 AS BIGINT)), '%I:%M %p'), '0') AS shown FROM (SELECT conv_id, turn, (turn % 12 + 1) % 12 + CASE WHEN turn % 2 = 0 THEN 0 ELSE 12 END AS h, (conv_id * 7 + turn) % 60 AS m FROM t)")
def dt_zone(spark, sf_dir):
    """Clocks as a zone nine hours ahead shows them."""
    return messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), times.display_time(c("ts_text"), now(), zone="Asia/Tokyo").alias("shown"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 'some time' ELSE ts END AS shown FROM t")
def dt_display(spark, sf_dir):
    k, at = c("msg_idx") % 4, c("ts_text")
    made = F.when(k == 0, at).when(k == 1, cat("[Feb 6th at ", at, "](https://ex.org)")).when(k == 2, cat("Yesterday at ", at)).otherwise("some time")
    return messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), times.display_time(made, now()).alias("shown"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(TIMESTAMP '2024-06-14 00:00:00' + to_minutes(CAST(h * 60 + m AS BIGINT)) AS VARCHAR) WHEN 1 THEN CAST(TIMESTAMP '2024-02-06 00:00:00' + to_minutes(CAST(h * 60 + m AS BIGINT)) AS VARCHAR) ELSE '2024-06-10 00:00:00' END AS ts
  FROM (SELECT conv_id, turn, (turn % 12 + 1) % 12 + CASE WHEN turn % 2 = 0 THEN 0 ELSE 12 END AS h, (conv_id * 7 + turn) % 60 AS m FROM t)""")
def dt_parse(spark, sf_dir):
    k, at = c("msg_idx") % 3, c("ts_text")
    made = F.when(k == 0, cat("Yesterday at ", at)).when(k == 1, cat("Feb 6th at ", at)).otherwise("Monday")
    return messages_of(turns(spark, sf_dir)).select("conv_id", c("msg_idx").alias("turn"), times.parse_timestamp(made, now()).cast("string").alias("ts"))


@query("SELECT conv_id, turn, CAST(TRY_CAST('2023-' || lpad((turn % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((conv_id % 31 + 1)::VARCHAR, 2, '0') AS DATE) AS VARCHAR) AS day FROM t")
def dt_date(spark, sf_dir):
    month = F.element_at(F.array(*map(F.lit, "jan feb mar apr may jun jul aug sept oct nov december".split())), c("turn") % 12 + 1)
    made = F.when(c("turn") % 2 == 0, cat("2023-", c("turn") % 12 + 1, "-", c("conv_id") % 31 + 1)).otherwise(cat(month, " ", c("conv_id") % 31 + 1, "th, 2023"))
    return turns(spark, sf_dir).select("conv_id", "turn", times.parse_date(made, now()).cast("string").alias("day"))


# --- rendering, checks, statistics ---------------------------------------------------------------
@query(f"SELECT conv_id, string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> ' || replace(text, {NL}, {NL} || '> ') || {NL} || '>' || {NL} || '> 😄 ' || (turn + 1), {NL} || {NL} ORDER BY turn) AS markdown FROM t GROUP BY conv_id")
def rnd_standard(spark, sf_dir):
    found = messages_of(turns(spark, sf_dir)).withColumn("reactions", F.array(F.struct(F.lit("smile").alias("name"), (c("msg_idx") + 1).alias("count"))))
    return render.render_conversations(found, None, now())


@query(f"SELECT conv_id, string_agg('> [!slack]+ [Message from ' || username || ']' || {NL} || '> [Time: ' || ts || ']' || {NL} || '>' || {NL} || '> ' || replace(text, {NL}, {NL} || '> '), {NL} || {NL} ORDER BY turn) AS markdown FROM t GROUP BY conv_id")
def rnd_bracket(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return render.render_conversations(messages_of(rows), rows.select("conv_id").distinct().withColumn("format", F.lit("bracket")), now())


@query(f"SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(username || ': ' || text, {NL} || {NL} ORDER BY turn) ELSE string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> ' || replace(text, {NL}, {NL} || '> '), {NL} || {NL} ORDER BY turn) END AS markdown FROM t GROUP BY conv_id")
def rnd_registered(spark, sf_dir):
    """A layout from outside, for the conversations of its format."""
    render.register_strategy("script", lambda settings, ref: cat(c("username"), ": ", c("text")))
    rows = turns(spark, sf_dir)
    formats = rows.select("conv_id").distinct().withColumn("format", F.when(c("conv_id") % 2 == 0, "script").otherwise("channel"))
    return render.render_conversations(messages_of(rows), formats, now())


STYLED = """, v AS (SELECT *, turn % 5 = 0 AS reply, CASE WHEN turn % 5 = 3 THEN 'see https://ex.org/a, ' ELSE '' END || text AS x FROM t)"""


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, starts of threads, edited messages, links and plain ones; some with reactions."""
    k = c("msg_idx") % 5
    rows = messages_of(turns(spark, sf_dir)).withColumns({"is_thread_reply": k == 0, "is_thread_start": k == 1, "is_edited": k == 2, "text": cat(F.when(k == 3, "see https://ex.org/a, ").otherwise(""), c("text")), "thread_info": F.when(k == 0, "3 replies")})
    return rows.withColumn("reactions", F.when(k == 4, F.array(F.struct(F.lit("tada").alias("name"), c("msg_idx").alias("count")))).otherwise(c("reactions")))


def _callouts(info: str) -> str:
    """SQL of the call-out standards."""
    p = "CASE WHEN reply THEN '> ' ELSE '' END"
    return STYLED + f"""SELECT conv_id, string_agg({p} || '> [!slack]+ Message from ' || username || {NL} || {p} || '> **Time:** ' || ts || {NL} || '>' || {NL} || {p} || '> ' || replace(x, {NL}, {NL} || {p} || '> ')
  || CASE WHEN turn % 5 = 4 THEN {NL} || {NL} || '> tada ' || turn WHEN turn % 5 = 2 THEN {NL} || '*(edited)*' ELSE '' END{info}, {NL} || {NL} ORDER BY turn) AS text FROM v GROUP BY conv_id"""


@query(_callouts(""))
def rnd_conversation(spark, sf_dir):
    return standards.apply_standard(_styled(spark, sf_dir), "CONVERSATION")


@query(_callouts(f" || CASE WHEN reply THEN {NL} || '*3 replies*' ELSE '' END"))
def rnd_detailed(spark, sf_dir):
    return standards.apply_standard(_styled(spark, sf_dir), "DETAILED")


@query(STYLED + f"""SELECT conv_id, string_agg(CASE WHEN reply THEN '• ' ELSE '' END || username || ': ' || CASE WHEN reply THEN '• ' ELSE '' END || '`' || ts || '` ' || d || replace(x, {NL}, {NL} || d) || CASE WHEN turn % 5 = 2 THEN ' *(edited)*' ELSE '' END, {NL} ORDER BY turn) AS text
  FROM (SELECT *, CASE WHEN reply THEN '•  ' WHEN turn % 5 = 3 THEN '  ' ELSE ' ' END AS d FROM v) GROUP BY conv_id""")
def rnd_compact(spark, sf_dir):
    return standards.apply_standard(_styled(spark, sf_dir), "COMPACT")


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'thread_reply' WHEN 1 THEN 'thread_start' WHEN 2 THEN 'edited_message' WHEN 3 THEN 'link_preview' ELSE 'regular_message' END AS kind, CASE WHEN turn % 5 = 3 THEN 'see https://ex.org/a, ' ELSE '' END || text AS cleaned FROM t")
def rnd_content_type(spark, sf_dir):
    rows = _styled(spark, sf_dir)
    noisy = cat(c("text"), "\nhttps://ex.org/preview\n 2 files \nPDF")
    return rows.select("conv_id", c("msg_idx").alias("turn"), standards.content_type().alias("kind"), standards.clean_embedded(noisy).alias("cleaned"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '>[!note]+ Message from [[' || username || ']]' || {NL} || '> **Time:** ' || ts || ' — ok, ' || turn WHEN turn % 3 = 1 THEN '>[!info]' || {NL} || '> ' || ts || {NL} || '>' || {NL} || '> ok, ' || turn ELSE '>[!note]+ [Message from ' || username || ']' || {NL} || '> [Time: ' || ts || ']' || {NL} || '>' || {NL} || '> [Message from x], ' || turn END AS block FROM t")
def rnd_mixed(spark, sf_dir):
    k = c("msg_idx") % 3
    found = messages_of(turns(spark, sf_dir)).withColumns({"username": F.when(k == 1, "Unknown User").otherwise(c("username")), "text": F.when(k == 2, cat("[Message from x], ", c("msg_idx"))).otherwise(cat("ok, ", c("msg_idx")))})
    return found.select("conv_id", c("msg_idx").alias("turn"), render.mixed_block(Settings(), now()).alias("block"))


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '📊 **' || (turn + 1) || CASE WHEN turn = 0 THEN ' reply' ELSE ' replies' END || '** • Last reply 2 days ago' || {NL} || '🔗 View thread' WHEN 1 THEN '🧵 **Thread Reply**' || {NL} || '   _Replying to: \"it ' || turn || '\"_' ELSE '📢 Also sent to the channel' END AS shown FROM t")
def rnd_thread(spark, sf_dir):
    made = F.when(c("turn") % 3 == 0, cat(c("turn") + 1, " replies Last reply 2 days agoView thread")).when(c("turn") % 3 == 1, cat('replied to a thread: "it ', c("turn"), '"')).otherwise("Also sent to the channel")
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(render.thread_lines(made), "\n").alias("shown"))


BAD = ", v AS (SELECT conv_id, turn AS msg_idx, CASE WHEN turn % 5 = 0 THEN 'Unknown User' WHEN turn % 5 = 1 THEN 'Al' ELSE username END AS username, CASE WHEN turn % 7 = 0 THEN ' ' WHEN turn % 7 = 1 THEN 'Language' ELSE text END AS text FROM t)"


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    five, seven = c("msg_idx") % 5, c("msg_idx") % 7
    return messages_of(turns(spark, sf_dir)).withColumns({"username": F.when(five == 0, "Unknown User").when(five == 1, "Al").otherwise(c("username")), "text": F.when(seven == 0, " ").when(seven == 1, "Language").otherwise(c("text"))})


@query(BAD + """SELECT conv_id, msg_idx, 'unknown_user' AS type, 'Message ' || msg_idx || ': Unknown User with text: "' || substr(text, 1, 50) || '..."' AS message FROM v WHERE username = 'Unknown User'
 UNION ALL SELECT conv_id, msg_idx, 'empty_content', 'Message ' || msg_idx || ': Empty message content' FROM v WHERE trim(text) = ''
 UNION ALL SELECT conv_id, msg_idx, 'metadata_only', 'Message ' || msg_idx || ': Contains only metadata: "Language"' FROM v WHERE text = 'Language'
 UNION ALL SELECT conv_id, msg_idx, 'short_username', 'Message ' || msg_idx || ': Suspiciously short username: "Al"' FROM v WHERE username = 'Al'""")
def val_issues(spark, sf_dir):
    rows = _bad(spark, sf_dir)
    return validate.unknown_users(rows).union(validate.structure_issues(rows)).select("conv_id", "msg_idx", "type", "message")


@query(BAD + """SELECT conv_id, count(*) FILTER (username = 'Unknown User') + count(*) FILTER (trim(text) = '' OR text = 'Language') + count(*) FILTER (username = 'Al') = 0 AS is_valid, count(*) FILTER (username = 'Unknown User') AS unknown_user_count,
  count(*) FILTER (trim(text) = '' OR text = 'Language') + count(*) FILTER (username = 'Al') AS structure_issue_count FROM v GROUP BY conv_id""")
def val_verdicts(spark, sf_dir):
    return validate.verdicts(_bad(spark, sf_dir))


@query(BAD + """SELECT conv_id, msg_idx, 'empty_content' AS type, 'warning' AS severity FROM v WHERE trim(text) = ''""")
def val_errors(spark, sf_dir):
    return validate.message_errors(_bad(spark, sf_dir)).select("conv_id", "msg_idx", "type", "severity")


@query(BAD + """, w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY msg_idx) > 1 AND trim(text) <> '' AS again FROM v)
 SELECT conv_id, count(*) AS total_messages, count(*) AS messages_with_timestamps, count(*) FILTER (again) AS duplicate_messages, count(*) FILTER (trim(text) = '') AS errors, count(*) FILTER (again) AS warnings,
   greatest(0, 100 - 10 * count(*) FILTER (trim(text) = '') - 2 * count(*) FILTER (again)) AS score, CASE WHEN count(*) FILTER (again) > 0 THEN 1 ELSE 0 END AS n_recommendations FROM w GROUP BY conv_id""")
def val_report(spark, sf_dir):
    rows = validate.full_report(_bad(spark, sf_dir))
    return rows.select("conv_id", "total_messages", "messages_with_timestamps", "duplicate_messages", "errors", "warnings", c("score").cast("bigint").alias("score"), F.size("recommendations").alias("n_recommendations"))


@query("SELECT conv_id, turn, turn % 4 <> 0 AS is_valid, CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 95 ELSE 100 END AS score FROM t")
def val_content(spark, sf_dir):
    made = F.when(c("turn") % 4 == 0, cat("so <script>", c("text"))).when(c("turn") % 4 == 1, cat(c("text"), F.repeat(F.lit("so, "), F.lit(3200)))).otherwise(c("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", validate.content_check(made).alias("x")).select("conv_id", "turn", "x.*")


@query("SELECT conv_id, count(*) AS message_count, count(DISTINCT username) AS unique_users, count(*) FILTER (turn % 3 = 0) AS thread_replies, 'unknown' AS format FROM t GROUP BY conv_id")
def agg_stats(spark, sf_dir):
    rows = segment.header_segments(transcripts(turns(spark, sf_dir)))
    return stats.conversation_stats(rows.withColumn("thread_info", F.when(c("msg_idx") % 3 == 0, "3 replies")))


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE 0 END AS message_count, CASE WHEN conv_id % 2 = 0 THEN count(DISTINCT username) ELSE 0 END AS unique_users, 0::BIGINT AS thread_replies, 'unknown' AS format FROM t GROUP BY conv_id")
def agg_defaults(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return stats.with_defaults(transcripts(rows), stats.conversation_stats(messages_of(rows.where("conv_id % 2 = 0"))))


@query("SELECT conv_id, 0::BIGINT AS message_count, count(*) AS unique_users, 0::BIGINT AS thread_replies, 'fallback' AS format FROM t GROUP BY conv_id")
def agg_failure(spark, sf_dir):
    return stats.failure_stats(transcripts(turns(spark, sf_dir).withColumn("text", cat(c("text"), " <@U", c("turn"), ">"))))


@query("SELECT day, k AS users, true AS near, true AS merges FROM (SELECT turn % 7 AS day, count(DISTINCT role || conv_id) AS k FROM t GROUP BY 1)")
def agg_sketch(spark, sf_dir):
    """Users by day from sketches of users by conversation and day, stored and merged, beside exact counts."""
    rows = messages_of(turns(spark, sf_dir)).select("conv_id", (c("msg_idx") % 7).alias("day"), cat(c("username"), " of ", c("conv_id")).alias("username"))
    stored = store(stats.user_sketches(rows), "sketches")
    once = stats.user_sketches(rows.withColumn("conv_id", F.lit(0))).select("day", F.hll_sketch_estimate("users").alias("at_once"))
    exact = rows.groupBy("day").agg(F.countDistinct("username").alias("users"))
    found = exact.join(stats.users_by_day(stored), "day").join(once, "day")
    return found.select("day", "users", (F.abs(c("estimate") - c("users")) <= 0.05 * c("users") + 1).alias("near"), (F.abs(c("estimate") - c("at_once")) <= 0.02 * c("users") + 1).alias("merges"))


@query("SELECT conv_id, username, count(*) AS message_count, (grouping(conv_id) * 2 + grouping(username))::BIGINT AS level FROM t GROUP BY ROLLUP (conv_id, username)")
def ext_rollup(spark, sf_dir):
    """Extension, not an operator of the survey: subtotals by conversation and user."""
    return stats.user_rollup(messages_of(turns(spark, sf_dir)))


# --- the whole way -------------------------------------------------------------------------------
@query(f"SELECT conv_id, string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> so it is, said ' || md5(text) || '; 😄 [d](https://ex.org)', {NL} || {NL} ORDER BY turn) AS markdown FROM t GROUP BY conv_id")
def run_fast(spark, sf_dir):
    """All stages over plain-header segments; whole texts go in and come out, and are digested last."""
    rows = turns(spark, sf_dir).withColumn("text", cat("so it is, said ", c("text"), "; :smile: <https://ex.org|d>"))
    said = text.map_tokens(c("markdown"), r"(?s)(?<=> so it is, said ).*?(?=; 😄 \[d\]\(https://ex\.org\))", lambda t: F.md5(F.replace(t, F.lit("\n> "), F.lit("\n"))))
    return pipeline.run(transcripts(rows), fast=True).rendered.select("conv_id", said.alias("markdown"))


@query(f"SELECT conv_id, string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> ' || " + prose_sql("; 😄 [d](https://ex.org)", f"{NL} || '> '") + f", {NL} || {NL} ORDER BY turn) AS markdown FROM t GROUP BY conv_id")
def run_primary(spark, sf_dir):
    """All stages over the primary parser and its quality gate."""
    rows = turns(spark, sf_dir).withColumn("text", as_prose("; :smile: <https://ex.org|d>"))
    return pipeline.run(transcripts(rows)).rendered


RUN_FAST = f"string_agg('> [!slack]+ Message from ' || username || {NL} || '> **Time:** ' || ts || {NL} || '>' || {NL} || '> so it is, said ' || replace(text, {NL}, {NL} || '> ') || '; 😄 [d](https://ex.org)', {NL} || {NL} ORDER BY turn)"


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(turns(spark, sf_dir).withColumn("text", cat("so it is, said ", c("text"), "; :smile: <https://ex.org|d>")))


@query(f"""SELECT k.conv_id * 2 + i AS conv_id, md5(markdown) AS markdown, 0 AS parsed FROM (SELECT conv_id, {RUN_FAST} AS markdown FROM t GROUP BY conv_id) k, (VALUES (0), (1)) v(i)""")
def adm_memo(spark, sf_dir):
    """All transcripts once, and then again, each in two conversations: nothing is left to be formatted."""
    memo, rows = f"{shared_dir(spark)}/chatframe-memo-{uuid.uuid4().hex}", _decorated(spark, sf_dir)
    format_memoised(rows, memo, fast=True)
    twice = rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "*").select((c("conv_id") * 2 + c("i")).alias("conv_id"), "raw")
    found, parsed = format_memoised(twice, memo, fast=True)
    return found.select("conv_id", F.md5("markdown").alias("markdown"), F.lit(parsed).cast("int").alias("parsed"))


@query(f"""SELECT * FROM (SELECT 'admission' AS stage, 'conversations' AS metric, 'info' AS level, count(DISTINCT conv_id) AS value FROM t UNION ALL SELECT 'folded', 'messages', 'info', count(*) FROM t UNION ALL SELECT 'messages', 'messages', 'info', count(*) FROM t
  UNION ALL SELECT 'admission', 'characters', 'debug', sum(n)::BIGINT FROM (SELECT length(string_agg(head || {NL} || 'so it is, said ' || text || '; :smile: <https://ex.org|d>', {NL})) AS n FROM h GROUP BY conv_id)
  UNION ALL SELECT 'messages', 'characters', 'debug', sum(length('so it is, said ' || text || '; 😄 [d](https://ex.org)'))::BIGINT FROM t)""")
def snk_metrics(spark, sf_dir):
    """Counts of a debug run's stages by level; no job is run for them."""
    log = Log(debug=True)
    pipeline.run(_decorated(spark, sf_dir), fast=True, log=log)
    return log.table(spark).where("stage <> 'normal'")


@query(f""", x AS (SELECT conv_id, turn, 'so it is, said ' || text || '; :smile: <https://ex.org|d>' AS said, head FROM h),
 ls AS (SELECT conv_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT conv_id, string_split(string_agg(head || {NL} || said, {NL} ORDER BY turn), {NL}) AS ls FROM x GROUP BY conv_id)),
 u AS (SELECT conv_id, list(line ORDER BY pos) AS ls FROM ls WHERE trim(line) <> '' AND NOT EXISTS (SELECT 1 FROM x WHERE x.conv_id = ls.conv_id AND trim(x.said) = trim(ls.line)) GROUP BY conv_id),
 m AS (SELECT conv_id, count(*) AS n, {RUN_FAST} AS markdown FROM t GROUP BY conv_id)
 SELECT conv_id, md5(markdown || {NL} || {NL} || '---' || {NL} || {NL} || '## Debug Information' || {NL} || {NL} || '### Processing Steps' || {NL} || '- Detected format: dm' || {NL} || '- Processed ' || n || ' messages (intelligent)' || {NL} || {NL} || '### Unparsed Content' || {NL} || {NL} || '```' || {NL}
   || array_to_string(ls[1:50], {NL}) || {NL} || CASE WHEN len(ls) > 50 THEN '... and ' || (len(ls) - 50) || ' more lines' || {NL} ELSE '' END || '```') AS markdown FROM m JOIN u USING (conv_id)""")
def run_debug(spark, sf_dir):
    """All stages in debug mode: whole results with their appendix, digested last."""
    found = pipeline.run(_decorated(spark, sf_dir), Settings(debug=True), fast=True).rendered
    return found.select("conv_id", F.md5("markdown").alias("markdown"))


def _breaks(text_: str) -> str:
    """A step that doesn't survive every text."""
    if "<https://ex.org|broken>" in text_:
        raise ValueError("odd link")
    return text_


@query("""SELECT conv_id, turn AS msg_idx, CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN turn::VARCHAR WHEN 2 THEN 'so, ' || text || ' [broken](https://ex.org)' WHEN 3 THEN 'so, ' || text || ' [[user]]' ELSE 'so, ' || text || ' 😄' END AS text,
  CASE turn % 5 WHEN 2 THEN 'links:fallback:ValueError: odd link' WHEN 3 THEN 'mentions:fallback:no result' WHEN 4 THEN 'emoji:applied:' ELSE '' END AS notable FROM t""")
def enr_report(spark, sf_dir):
    """Nulls, numbers and whole texts through a chain of which two steps fail on some: a Python step by an
    exception, a native one by a null."""
    k, t = c("msg_idx") % 5, c("text")
    made = F.when(k == 0, F.lit(None)).when(k == 1, c("msg_idx").cast("string")).when(k == 2, cat("so, ", t, " <https://ex.org|broken>")).when(k == 3, cat("so, ", t, " <@U7>")).otherwise(cat("so, ", t, " :smile:"))
    rows = messages_of(turns(spark, sf_dir)).withColumn("text", made)
    broken = {"links": [enrich.InPython(_breaks), enrich.convert_links], "mentions": [lambda x: F.when(~x.contains("<@U7>"), enrich.convert_mentions(x))]}
    found = guarded.enrich_guarded(rows, Settings(), steps=broken)
    notable = F.filter("done", lambda d: d["outcome"] != "unchanged")
    return found.select("conv_id", "msg_idx", "text", F.array_join(F.transform(notable, lambda d: F.concat_ws(":", d["step"], d["outcome"], F.coalesce(d["error"], F.lit("")))), ";").alias("notable"))


@query()
def run_prose(spark, sf_dir):
    """All stages over transcripts of the table's own prose, as it is."""
    return pipeline.run(transcripts(turns(spark, sf_dir))).rendered


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.build_notes(transcripts(turns(spark, sf_dir)), "2024-06-15", fast=True)
