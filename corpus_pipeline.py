"""The corpus pipeline: toxicity, language, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and calls one
operator of ``chatframe.llm``. Filtering stages return the columns of their input; the last one
returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.llm import language_id, mixing, ngram_join, packing, toxicity
from chatframe.llm.common import store, table
from chatframe.storage import scratch

#: A document stays if one language leads with this share of its words.
LEADING_SHARE = 0.5


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents scored 0.5 or more go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return model.score(docs).where("score < 0.5").select("row.*")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or without a leading language, go."""
    langs, model = language_id.train(docs)
    named = language_id.identify(docs.select(F.struct(*docs.columns).alias("row")), langs, model, "row.text")
    return named.where((F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEADING_SHARE)).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one with the least id. Of rows that
    repeat id and text the one stays whose other columns come first; rows without an id all stay.
    One plan at every size: texts shuffle once."""
    found = store(ngram_join.join_ngrams(docs.select("doc_id", "text")), "joined")
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)
    twice = found.where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count")
    if not twice.head(1):
        return kept
    again = kept.join(twice, same, "left_semi")
    first = again.groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(twice, same, "left_anti").union(first.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a document stands in the result as often as it is taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left."""
    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return packing.pack(docs.select("doc_id", "text"), *files, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", keep_clean),
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_distinct),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: No SQL: boosted trees, expectation-maximisation and tokenizers aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its result is written
            docs = store(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
