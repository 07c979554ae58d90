"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is learned from labelled rows: words and word beginnings (4 to 6 letters, so that
   inflected forms count together) that mark toxic documents by a likelihood-ratio test. A short
   fixed list of English insults stands beside it.
2. Each text becomes a few dense features: lexicon densities, how near hits are to second-person
   words, capitals, punctuation, obfuscation, and hits that only show once obfuscation is undone.
3. Spark ML fits boosted trees on them, and isotonic regression, on rows kept apart, turns the
   trees' probability into the score.

Fitting uses at most about ``SAMPLE`` labelled rows; every row is scored, over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import doc_bucket, store

#: Labelled rows that the lexicon, trees and calibration are fitted on, about and at most.
SAMPLE = 20_000
#: Remainders (id crc32 modulo FOLDS) of rows never learned from, and of those for calibration.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: A term enters the lexicon at this G-squared, twice the log-likelihood ratio.
EVIDENCE = 18.0
BEGINNINGS = (4, 5, 6)
#: Share of the trees' probability in the score, so that rows on one isotonic step keep an order.
BLEND = 0.01
NEAR = 5
#: Words whose weights a task remembers; bounds memory, not results.
MEMO = 150_000

#: English insults (fixed values).
INSULTS = frozenset("idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb imbecile bastard bitch asshole whore slut retard pig vermin".split())
#: Second-person words of English, German, French and Spanish (fixed values).
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Signs that stand for letters (fixed values).
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})

WORD = re.compile(r"[^\W_]+")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$!*|._-]{1,2}[^\W\d_]+)+")
UPPER, MARKS, LOUD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(c for c in range(33, 127) if not chr(c).isalnum()), b"!?"
FEATURES = ("lexicon_density", "lexicon_hits", "lexicon_peak", "lexicon_weight", "insult_density", "near_you", "you_rate", "capitals", "shouted", "punctuation", "loud", "disguised_rate", "disguised_hits", "log_words")


def terms(text: str) -> set[str]:
    """Words and word beginnings (marked with ^) that the lexicon is learned from."""
    words = set(WORD.findall(text.lower()))
    return words | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


class Weights(dict):
    """Word -> lexicon weight: its own or its heaviest beginning's. Remembers at most MEMO words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = found = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(f"^{word[:k]}", 0.0) for k in BEGINNINGS if len(word) > k)])
        return found


def features(text: str, weights: Weights) -> list[float]:
    """The values of FEATURES for a text; an empty one has zeros."""
    lower, raw = text.lower(), text.encode("utf-8", "replace")
    words = WORD.findall(lower)
    n, size = max(1, len(words)), max(1, len(raw))
    found = [weights[w] for w in words]
    hits = [i for i, x in enumerate(found) if x]
    held = set(words)
    insults = sum(words.count(w) for w in INSULTS & held) if INSULTS & held else 0
    you = [i for i, w in enumerate(words) if w in YOU] if YOU & held else []
    near, at = 0, 0
    for i in hits:
        while at < len(you) and you[at] < i - NEAR:
            at += 1
        near += at < len(you) and you[at] <= i + NEAR
    upper = len(raw) - len(raw.translate(None, UPPER))
    marks = len(raw) - len(raw.translate(None, MARKS))
    loud = raw.count(b"!") + raw.count(b"?")
    shouted = sum(map(str.isupper, re.findall(r"\b[A-Z]{3,}\b", text))) if upper > 2 else 0
    disguised = DISGUISED.findall(lower)
    undone = sum(1 for w in disguised if (plain := w.translate(SIGNS)) in INSULTS or weights[plain])
    return [len(hits) / n, math.log1p(len(hits)), max(found, default=0.0), sum(found) / math.sqrt(n), insults / n, near / n, len(you) / n, upper / size, shouted / n, marks / size, loud / size, len(disguised) / n, math.log1p(undone), math.log1p(len(words))]


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Term -> log odds, from (text, label): document counts by term, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(terms(text or ""))
        for label, counts in seen.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64()), pa.array([label] * len(counts), pa.int32())], ["term", "n", "label"])

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}
    counts = rows.select("text", "label").mapInArrow(count, "term string, n long, label int").groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("t") + F.col("c")) * share))).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), toxic / (toxic + clean)) + part(F.col("c"), clean / (toxic + clean)))
    kept = counts.where(F.col("t") > 2).select("term", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") > 1.5) & (F.col("evidence") >= EVIDENCE))
    return {r["term"]: r["odds"] for r in kept.collect()}  # terms of a bounded sample


def featurise(docs: DataFrame, lexicon: dict[str, float], text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with a column of features (array<double>) of the whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(shared.value)
        for texts in batches:
            yield pa.array([features(t or "", weights) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(out, of(F.col(text).cast("string")))


class ToxicityModel:
    """Fitted lexicon, trees and calibration; without both labels in the sample, scores are 0."""

    def __init__(self, lexicon, trees, steps):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): each row as a struct of all its columns, so that no name can clash, and
        its score (0 to 1)."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(0.0))
        rows = featurise(rows, self.lexicon, f"row.{text_col}", "_fx").select("row", array_to_vector("_fx").alias("_features"))
        rows = self.trees.transform(rows).withColumn("_p", vector_to_array("probability")[1])
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - BLEND) * F.col("_step") + BLEND * F.col("_p")))
        return self.steps.transform(rows).select("row", score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled documents outside the held-out fold. Null labels, ids and other label
    values are left out; documents with several label rows count for each distinct label. The
    sample is drawn by a hash of the id, so reruns agree."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null").distinct()
    marks = marks.where(doc_bucket(F.col("_id"), FOLDS) != HELD_OUT)
    n = marks.count()
    share = min(1.0, sample / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(marks, "_id")
    rows = store(rows.withColumn("fold", doc_bucket(F.col("_id"), FOLDS)), "labelled")
    lexicon = learn_lexicon(rows.where(F.col("fold") != CALIBRATION))
    found = store(featurise(rows, lexicon).drop("text"), "features").withColumn("_features", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    learn, check = found.where(F.col("fold") != CALIBRATION), found.where(F.col("fold") == CALIBRATION)
    if learn.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None)
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_class", maxIter=15, maxDepth=3, stepSize=0.3, minInstancesPerNode=3, seed=7, checkpointInterval=-1).fit(learn)
    if not check.head(1):
        check = learn
    steps = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_step").fit(trees.transform(check).withColumn("_p", vector_to_array("probability")[1]))
    return ToxicityModel(lexicon, trees, steps)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each input row, repeated rows included.
    Null and empty texts are scored as texts without words; a null id is not held out. Other
    columns are not carried; an empty table gives no rows."""
    model = fit(docs, labels, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(doc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return model.score(base).select("row.doc_id", "score").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
