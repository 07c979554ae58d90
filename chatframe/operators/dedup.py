"""Duplicates inside a conversation: repeated blocks of text, equal messages, and near-equal
content blocks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.functions.text import let, trim_u, unlines
from chatframe.operators.embed import PRIORITY, embedded
from chatframe.operators.lines import explode_lines
from chatframe.storage import store

BLOCK_START = r"^[A-Za-z\s]+\s+\[.+\]\(https?://.+\)|^[A-Za-z\s]+\s+\d{1,2}:\d{2}\s*(?:AM|PM)?"
KEY_LINES, TIME_CHARS, TEXT_CHARS = 3, 20, 100
SIMILAR, MIN_CHARS, DISTANCE, EDITS = 0.95, 15, 3, 0.3
#: Similarity of characters and of words without which the whole can't reach ``SIMILAR``.
CHARS, WORDS = 0.8333, 0.8749


def drop_repeated_blocks(conversations: DataFrame, col: str = "raw") -> DataFrame:
    """(conv_id, raw): without blocks whose first three filled lines an earlier block has. A block
    starts at a header line; what stands before the first header is a block too."""
    lines = explode_lines(conversations, col)
    order = W.partitionBy("conv_id").orderBy("line_no")
    lines = lines.withColumn("block_no", F.sum(F.col("trimmed").rlike(BLOCK_START).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    blocks = lines.groupBy("conv_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "content", "trimmed"))).alias("ls"))
    key = F.array_join(F.slice(F.filter(F.transform("ls", lambda x: x["trimmed"]), lambda x: x != ""), 1, KEY_LINES), "|")
    nth = F.row_number().over(W.partitionBy("conv_id", "key").orderBy("block_no"))
    kept = blocks.withColumn("key", key).withColumn("nth", nth).where("nth = 1")
    joined = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "ls"))).alias("bs"))
    return joined.select("conv_id", unlines(F.flatten(F.transform("bs", lambda b: F.transform(b["ls"], lambda x: x["content"])))).alias(col))


def message_key(username: Column, ts_text: Column, text: Column) -> Column:
    time = F.coalesce(F.nullif(F.substring(ts_text, 1, TIME_CHARS), F.lit("")), F.lit("no-timestamp"))
    return F.concat_ws("|", F.coalesce(username, F.lit("null")), time, trim_u(F.substring(F.coalesce(text, F.lit("")), 1, TEXT_CHARS)))


def drop_equal_messages(messages: DataFrame) -> DataFrame:
    """The first of the messages of a conversation with equal author, time and start of text."""
    nth = F.row_number().over(W.partitionBy("conv_id", message_key(F.col("username"), F.col("ts_text"), F.col("text"))).orderBy("msg_idx"))
    return messages.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def char_set(c: Column) -> Column:
    """The characters of a text, without spaces and case."""
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(c), "[ \t\r\n]", ""), "")), lambda v: v != "")


def word_set(c: Column) -> Column:
    """The words of a text; single signs aren't words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) > 1) | w.rlike("^[a-z0-9]$")))


def jaccard(x: Column, y: Column, of_none: float) -> Column:
    """Jaccard of two sets as arrays; ``of_none`` if both are empty."""
    shared = lambda both: let(F.size(F.array_intersect(both["x"], both["y"])), lambda i: F.when(F.size(both["x"]) + F.size(both["y"]) == 0, of_none).otherwise(i / (F.size(both["x"]) + F.size(both["y"]) - i)))
    return let(F.struct(x.alias("x"), y.alias("y")), shared)


def char_similarity(a: Column, b: Column) -> Column:
    return jaccard(char_set(a), char_set(b), 0.0)


def word_similarity(a: Column, b: Column) -> Column:
    """Two texts without words are alike."""
    return jaccard(word_set(a), word_set(b), 1.0)


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike: halving steps, each a comparison of a stretch."""
    most = F.least(F.length(a), F.length(b))
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(22, -1, -1)]), lambda x: x <= most)
    same = lambda at, x: (at + x <= most) & (F.substr(a, at + 1, x) == F.substr(b, at + 1, x))
    return F.aggregate(steps, F.lit(0), lambda at, x: F.when(same(at, x), at + x).otherwise(at))


def apart(a: Column, b: Column) -> Column:
    """A struct (a, b): two texts without what they begin and end with alike, which no edit changes."""

    def begun(t: Column) -> Column:
        return let(common_prefix(t["a"], t["b"]), lambda n: F.struct(*(F.reverse(F.substr(t[x], n + 1, F.length(t[x]))).alias(x) for x in "ab")))

    return let(let(F.struct(a.alias("a"), b.alias("b")), begun), begun)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / length, or 0 beyond three tenths of the length."""
    n = F.greatest(F.length(a), F.length(b))
    most = F.floor(n * EDITS).cast("int")
    distance = let(apart(a, b), lambda t: F.call_function("levenshtein", t["a"], t["b"], most))
    return F.when(n == 0, 1.0).when(F.abs(F.length(a) - F.length(b)) > most, 0.0).otherwise(let(distance, lambda d: F.when(d < 0, 0.0).otherwise((n - d) / n)))


def similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(char_similarity(a, b) * 0.3 + word_similarity(a, b) * 0.4 + edit_similarity(a, b) * 0.3)


def content_blocks(messages: DataFrame) -> DataFrame:
    """(conv_id, block_no, msg_idx, is_embedded, emb_type, content): each message's text, then what
    is embedded in it, where it has 15 characters or more. Block numbers grow with the message."""
    rows = messages if "_e" in messages.columns else messages.withColumn("_e", embedded(F.col("text")))
    main = F.array(F.struct(F.lit(False).alias("is_embedded"), F.lit(None).cast("string").alias("emb_type"), trim_u(F.col("text")).alias("content")))
    inner = F.transform("_e.blocks", lambda b: F.struct(F.lit(True).alias("is_embedded"), b["type"].alias("emb_type"), trim_u(b["content"]).alias("content")))
    rows = rows.select("conv_id", "msg_idx", F.posexplode(F.concat(main, inner)).alias("k", "b")).where(F.length("b.content") >= MIN_CHARS)
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("msg_idx", "k")) - 1
    return rows.select("conv_id", number.cast("int").alias("block_no"), "msg_idx", "b.*")


def similar_blocks(blocks: DataFrame) -> DataFrame:
    """(conv_id, a, b): block numbers, a before b, of different contents that are alike, at most
    three messages apart. A band join: blocks meet by conversation and by stretch of four messages,
    a later one also in the stretch before. Sets are made once a block, and cheap bounds go before dear
    ones: lengths, characters, words, edits."""
    sets = blocks.select("conv_id", "block_no", "msg_idx", "content", char_set(F.col("content")).alias("chars"), word_set(F.col("content")).alias("words"))
    side = lambda s: sets.select("conv_id", F.col("block_no").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("msg_idx", "content", "chars", "words")])
    left = side("a").withColumn("at", F.floor(F.col("msg_idx_a") / (DISTANCE + 1)).cast("int"))
    right = side("b").withColumn("at", F.explode(F.array_distinct(F.array(F.floor(F.col("msg_idx_b") / (DISTANCE + 1)).cast("int"), F.floor((F.col("msg_idx_b") - DISTANCE) / (DISTANCE + 1)).cast("int")))))
    a, b = F.col("content_a"), F.col("content_b")
    near = (F.col("a") < F.col("b")) & (F.col("msg_idx_b") - F.col("msg_idx_a") <= DISTANCE) & (a != b)
    as_long = lambda x, y, least: F.least(x, y) >= F.greatest(x, y) * least
    sized = as_long(F.length(a), F.length(b), 0.8) & as_long(F.size("chars_a"), F.size("chars_b"), CHARS) & as_long(F.size("words_a"), F.size("words_b"), WORDS)
    pairs = left.join(right, ["conv_id", "at"]).where(near & sized)
    pairs = pairs.withColumn("chars", jaccard(F.col("chars_a"), F.col("chars_b"), 0.0)).where(F.col("chars") >= CHARS)
    pairs = pairs.withColumn("words", jaccard(F.col("words_a"), F.col("words_b"), 1.0)).where(F.col("words") >= WORDS)
    pairs = pairs.where(F.col("chars") * 0.3 + F.col("words") * 0.4 + edit_similarity(a, b) * 0.3 >= SIMILAR)
    return pairs.select("conv_id", "a", "b").distinct()


def _victims(conv: int, number: np.ndarray, message: np.ndarray, inner: np.ndarray, rank: np.ndarray, content: list[bytes], pairs: dict[int, list[int]]) -> list[int]:
    """Greedy in block order: of two alike, the embedded one, the lower kind or the later message
    goes, and a block that went is compared no more."""
    same: dict[bytes, list[int]] = defaultdict(list)
    for i, c in enumerate(content):
        same[c].append(i)
    gone = np.zeros(len(number), bool)
    for i in range(len(number)):
        if gone[i]:
            continue
        group = same[content[i]]
        later = [j for j in group if j > i] if len(group) > 1 else []
        for j in sorted({*later, *pairs.get(i, ())}):
            if gone[j]:
                continue
            if inner[i] != inner[j]:
                first = bool(inner[i])
            elif inner[i] and rank[i] != rank[j]:
                first = rank[i] < rank[j]
            else:
                first = message[i] >= message[j]
            gone[i if first else j] = True
            if first:
                break
        if len(group) > 1:  # what went needn't be looked at again
            same[content[i]] = [j for j in group if not gone[j]]
    return number[gone].tolist()


def victims(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, block_no) of the blocks that go. Only numbers, kinds and digests of contents reach
    the grouped function, which settles one conversation."""
    kinds = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])
    rows = blocks.select("conv_id", "block_no", "msg_idx", "is_embedded", F.coalesce(F.try_element_at(kinds, "emb_type"), F.lit(0)).alias("rank"), F.md5("content").alias("digest"))
    follow = pairs.groupBy("conv_id", F.col("a").alias("block_no")).agg(F.array_sort(F.collect_list("b")).alias("alike"))
    rows = rows.join(follow, ["conv_id", "block_no"], "left")
    doubtful = rows.withColumn("_n", F.count("*").over(W.partitionBy("conv_id", "digest"))).groupBy("conv_id").agg(F.max((F.col("_n") > 1) | F.col("alike").isNotNull()).alias("d")).where("d").select("conv_id")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_no")
        number = np.asarray(table["block_no"])
        place = {n: i for i, n in enumerate(number.tolist())}
        alike = {i: [place[b] for b in bs] for i, bs in enumerate(table["alike"].to_pylist()) if bs}
        conv = table["conv_id"][0].as_py()
        out = _victims(conv, number, np.asarray(table["msg_idx"]), table["is_embedded"].to_numpy(), np.asarray(table["rank"]), table["digest"].to_pylist(), alike)
        return pa.table({"conv_id": pa.array([conv] * len(out), pa.int64()), "block_no": pa.array(out, pa.int32())})

    return rows.join(doubtful, "conv_id", "left_semi").groupBy("conv_id").applyInArrow(settle, "conv_id bigint, block_no int")


def remove_content(text: Column, content: Column) -> Column:
    """``text`` without ``content``: as a whole, or else without the lines it has."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), trim_u), lambda x: x != "")
    by_line = unlines(F.transform(F.split(text, "\n", -1), lambda x: F.when(F.array_contains(lines, trim_u(x)), "").otherwise(x)))
    cut = F.when(F.contains(text, content), F.replace(text, content, F.lit(""))).otherwise(by_line)
    return trim_u(F.regexp_replace(cut, r"\n(?:[ \t]*\n){2,}", "\n\n"))


def drop_similar_messages(messages: DataFrame) -> DataFrame:
    """``messages`` without those whose text an earlier one has, or nearly; where only something
    embedded repeats, the message keeps its other text, if there is any."""
    marked = store(messages.withColumn("_e", embedded(F.col("text"))), "embedded")  # read by each side of the joins below
    blocks = store(content_blocks(marked), "blocks")
    gone = blocks.join(victims(blocks, similar_blocks(blocks)), ["conv_id", "block_no"])
    gone = gone.groupBy("conv_id", "msg_idx").agg(F.max(~F.col("is_embedded")).alias("_main"), F.array_sort(F.collect_list(F.when(F.col("is_embedded"), F.struct("block_no", "content")))).alias("_inner"))
    rows = marked.join(gone, ["conv_id", "msg_idx"], "left").where(~F.coalesce("_main", F.lit(False)))
    rest = trim_u(F.col("_e.cleaned"))
    cut = F.aggregate("_inner", F.col("text"), lambda t, x: remove_content(t, x["content"]))
    rows = rows.withColumn("text", F.when(F.col("_inner").isNull(), F.col("text")).otherwise(F.coalesce(F.nullif(rest, F.lit("")), cut)))
    return rows.where(trim_u(F.col("text")) != "").select(*messages.columns)
