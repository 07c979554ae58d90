"""Mixing sources to target weights by hash-threshold histograms.

A document's hash is uniform on [0, 2^32). For each source the words below a threshold are what
the mix takes beyond whole repeats, so finding the threshold is all there is to do:

1. one scan makes (doc_id, source, size, hash) and stores it; texts are read once;
2. sizes are summed by source and hash bucket (1,024 buckets: a partial aggregate, so a hot source
   is at most 1,024 rows of each task), and a running sum finds the bucket where the budget ends;
3. only the documents of that boundary bucket are summed again, by the next 10 bits, and then by
   the last 12: the threshold is exact to one hash value;
4. the document at the threshold may be larger than what is left of the budget. The search goes on
   from there over the documents that are no larger than what is left, PASSES times in all, so a
   source misses its target by less than a small document;
5. documents are filtered by their hash and size alone; documents are never sorted, and none goes
   to the driver. Sources are ranked and capped in runs of an order by range, so there can be many.

Budgets of the first pass nest: raising a target only raises its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatframe.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash in the three levels of histograms, from the top.
LEVELS = (10, 10, 12)
#: Searches for a threshold: the first over all documents, others over those no larger than what is left.
PASSES = 3
#: Above every hash, and a size that no document exceeds.
ALL, ANY = 1 << 32, (1 << 63) - 1
#: No document is taken more often, so no source's target is above as many times its size.
MAX_REPEATS = 3


def doc_hash(doc_id: Column, size: Column) -> Column:
    """Uniform 32 bits: the first 8 hex digits of the md5 of the id as text and the size, so that
    documents without an id differ as well."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return rows.withColumn("h", doc_hash(F.col("doc_id"), F.col("size")))


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with ``n`` (1, 2, ... in ``order``) and, for each of ``sums``, ``upto_*``: its sum up
    to and with the row. Rows are dealt by range of the order and numbered range by range; a window
    over all of them has one row for each range only."""
    dealt = store(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = dealt.withColumns({"_n": F.count("*").over(w), **{f"_{c}": F.sum(c).over(w) for c in sums}})
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_k"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    ranges = ranges.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_k", *(f"_t_{c}" for c in sums))])
    out = inner.join(ranges, F.col("_part") == F.col("_p"))
    return out.select(*rows.columns, (F.col("_n") + F.col("_b_k")).alias("n"), *[(F.col(f"_{c}") + F.col(f"_b_t_{c}")).alias(f"upto_{c}") for c in sums])


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, budget): one row for each source.

    Sources rank by code point, null last, and weigh 1, 2, 3, 1, ... Targets share the total by
    weight, none above MAX_REPEATS times its source. Filling sources in order of cap by weight,
    the first that its share doesn't fill sets the level all others share: the fixed point of
    resharing the excess.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s, [F.col("source").asc_nulls_last()], []).withColumnRenamed("n", "rank")
    s = s.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long")).withColumn("cap_by_weight", MAX_REPEATS * F.col("source_size") / F.col("weight"))
    s = store(running(s, [F.col("cap_by_weight"), F.col("rank")], ["source_size", "weight"]), "caps")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest = total - MAX_REPEATS * (F.col("upto_source_size") - F.col("source_size"))
    shares = s.select("n", "cap_by_weight", (rest / (weights - (F.col("upto_weight") - F.col("weight")))).alias("level"))
    level = shares.where("level <= cap_by_weight").agg(F.min_by("level", "n")).first()[0] or 0.0
    target = F.least((MAX_REPEATS * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    s = s.withColumn("target", target).withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"))


def one_threshold(sizes: DataFrame, state: DataFrame, last: bool) -> DataFrame:
    """``state`` after one more search: (source, ends, at, left, most). Among documents with a hash of
    ``at`` or more and a size of ``most`` or less it finds the hash below which they fit into
    ``left``. ``ends`` collects (from, to, most): documents of such hashes and sizes are taken. The
    last search takes the documents at the threshold as well if that is nearer."""
    open_ = state.where("left > 0").select(F.col("source").alias("s"), "at", "left", "most")
    inner, bits = open_.withColumns({"low": F.lit(0).cast("long"), "below": F.lit(0.0)}), 32
    for width in LEVELS:
        span, bits = 1 << bits, bits - width
        step = 1 << bits
        rows = sizes.join(inner, F.col("source").eqNullSafe(F.col("s")))
        rows = rows.where((F.col("h") >= F.col("at")) & (F.col("size") <= F.col("most")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span))
        hist = rows.groupBy("s", "at", "left", "most", "low", "below", F.floor((F.col("h") - F.col("low")) / step).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(W.partitionBy("s").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        crossed = hist.groupBy("s").agg(F.min(F.struct("bucket", "at", "left", "most", "low", "upto", "words")).alias("b"))
        inner = store(crossed.select("s", "b.at", "b.left", "b.most", (F.col("b.low") + F.col("b.bucket") * step).alias("low"), (F.col("b.upto") - F.col("b.words")).alias("below"), "b.upto"), "level")
    nearer = F.lit(last) & (F.col("upto") - F.col("left") < F.col("left") - F.col("below"))
    found = inner.select(F.col("s").alias("f"), (F.col("low") + nearer.cast("long")).alias("to"), F.col("below"))
    rows = state.join(found, F.col("source").eqNullSafe(F.col("f")), "left")
    to = F.when(F.col("left") > 0, F.coalesce("to", F.lit(ALL))).otherwise(F.col("at"))  # none found: all fit
    left = F.col("left") - F.coalesce("below", F.lit(0.0))
    ends = F.concat("ends", F.array(F.struct(F.col("at").alias("from"), to.alias("to"), "most")))
    return rows.select("source", ends.alias("ends"), to.alias("at"), left.alias("left"), F.floor(left).alias("most"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and (source, source_size, target, repeats, ends). What joins to documents is
    stored first, so that its size in bytes decides how."""
    sizes = store(sized(docs, id_col, text_col, source_col), "sizes")
    targets = store(source_targets(sizes), "targets")
    none = F.array().cast("array<struct<from:bigint,to:bigint,most:bigint>>")
    state = targets.select("source", none.alias("ends"), F.lit(0).cast("long").alias("at"), F.col("budget").alias("left"), F.lit(ANY).alias("most"))
    for k in range(PASSES):
        state = store(one_threshold(sizes, state, k == PASSES - 1), "thresholds")
    ends = targets.join(state.select(F.col("source").alias("s"), "ends"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return sizes, store(ends, "ends")


def _with_copies(rows: DataFrame, ends: DataFrame, source: Column, h: Column, size: Column) -> DataFrame:
    """``rows`` with their source's row ``e`` and how often the mix takes them."""
    rows = rows.join(ends.select(F.struct("*").alias("e")), source.eqNullSafe(F.col("e.source")))
    once_more = F.exists("e.ends", lambda x: (h >= x["from"]) & (h < x["to"]) & (size <= x["most"]))
    return rows.withColumn("copies", F.col("e.repeats") + once_more.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row for each input row.

    A null or wordless text has size 0 and is taken with 0 words. Rows with equal id and size share
    a hash, so they are taken alike. Other columns are not carried. An empty table gives no rows.
    """
    sizes, ends = _plan(docs, id_col, text_col, source_col)
    rows = _with_copies(sizes, ends, F.col("source"), F.col("h"), F.col("size"))
    return rows.select("doc_id", "source", "size", "e.source_size", "e.target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken."""
    _, ends = _plan(docs, id_col, text_col, source_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("_size", n_words(F.col(f"row.{text_col}")))
    rows = _with_copies(rows, ends, F.col(f"row.{source_col}"), doc_hash(F.col(f"row.{id_col}"), F.col("_size")), F.col("_size"))
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
