"""Language identification by multilingual mixture inference.

Each language has a hashed trigram model, learned from labelled documents. A word's likelihood in a
language is the product of its trigrams'. Expectation-maximisation then estimates in which
proportions a document mixes the languages; the set of languages is the one with the best
penalised likelihood (each language costs half the logarithm of the number of words).

The model is one float for each language and trigram bucket (256 KB a language), so its size doesn't
depend on the corpus, and every language with a label is learned. Texts are read whole, in slices cut
between words; numpy works across all words of a batch. A slice and a batch are bounded in numbers, words
by languages: a text with more of them than a batch is estimated slice by slice, which sums the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import doc_bucket

BUCKET_BITS = 16
#: Labelled documents of a language that its model is fitted on, about and at most.
SAMPLE = 5_000
#: Documents with id crc32 modulo FOLDS = HELD_OUT are never learned from.
FOLDS, HELD_OUT = 3, 1
ROUNDS = 8
#: Trigrams by languages that are looked up together; words by languages of a batch.
SLICE, BATCH = 1 << 22, 800_000
#: Characters by languages from which on a text is estimated slice by slice.
LARGE = 1 << 25
#: Larger sets of languages without a better likelihood after which the search ends.
PATIENCE = 3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0][codes]


def _codes(text: str) -> np.ndarray:
    """Lower-case code points with 0 for all but letters, between zeros."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    return np.where(_is_letter(codes), codes, 0)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, where each word starts among them)."""
    at = np.flatnonzero(codes)
    if not len(at):
        return at, at
    mixed = codes[at - 1] * np.uint32(2654435761) + codes[at] * np.uint32(2246822519) + codes[at + 1] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    return (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.flatnonzero(codes[at - 1] == 0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by trigram bucket and language) from documents with a language
    outside the held-out fold, drawn by a hash of the id. Counts come to the driver language by language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(doc_bucket(F.col(id_col), FOLDS) != HELD_OUT, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    many = {k: int(sample / n * 1_000_000) for k, n in sizes.items() if n > sample}
    drawn = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    if many:
        share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("lang")), F.lit(1_000_000))
        drawn = drawn.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))[:] += np.bincount(_grams(_codes(text))[0], minlength=1 << BUCKET_BITS)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "gram", "n"])

    found = drawn.select("lang", "text").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = found.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("ns"))  # as many as there are buckets at most
    model = np.full((len(langs), 1 << BUCKET_BITS), 0.5, np.float32)
    number = {k: i for i, k in enumerate(langs)}
    for r in found.toLocalIterator():
        model[number[r["lang"]], r["grams"]] += np.array(r["ns"], np.float32)
    for row in model:
        row[:] = np.log(row.astype(np.float64) / row.sum(dtype=np.float64))
    return langs, np.ascontiguousarray(model.T)


def slices(text: str, model: np.ndarray) -> Iterator[np.ndarray]:
    """(words, languages): log likelihood of each word in each language, some words at a time."""
    codes, at, size = _codes(text), 0, max(1, SLICE // max(1, model.shape[1]))
    while at < len(codes) - 1:
        end = min(len(codes), at + size)
        if end < len(codes):  # cut between words
            gap = np.flatnonzero(codes[at + 1 : end] == 0)
            if len(gap):
                end = at + 2 + int(gap[-1])
            else:  # a word longer than a slice
                long_word = codes[end:] == 0
                end += 1 + int(long_word.argmax())
        grams, starts = _grams(codes[at:end])
        if len(grams) > size:  # one long word, summed part by part
            yield sum(model[grams[k : k + size]].sum(0, dtype=np.float64) for k in range(0, len(grams), size))[None].astype(np.float32)
        elif len(grams):
            yield np.add.reduceat(model[grams], starts, axis=0)
        at = end - 1


def word_likelihoods(text: str, model: np.ndarray) -> np.ndarray:
    out = list(slices(text, model))
    return np.concatenate(out) if out else np.zeros((0, model.shape[1]), np.float32)


def infer_large(text: str, model: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``infer`` of one text whose words by languages are too many to hold: each round goes through its
    slices again, and sets of a few languages through these languages' part of the model."""

    def given(ll: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return np.maximum(np.exp(ll.astype(np.float64) - peak), 1e-30)

    def step(part: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
        """The next proportions, and the log likelihood of these."""
        total, fit, at = np.zeros(len(pi)), 0.0, 0
        for ll in slices(text, part):
            e = given(ll, peaks[at : at + len(ll)]) * pi
            own = e.sum(1, keepdims=True)
            at, fit, total = at + len(ll), fit + float(np.log(own).sum()), total + (e / own).sum(0)
        return total / n, fit

    def em(part: np.ndarray) -> np.ndarray:
        pi = np.full(part.shape[1], 1 / part.shape[1])
        for _ in range(rounds):
            pi = step(part, pi)[0]
        return pi

    peaks, alone, n = [], np.zeros(model.shape[1]), 0
    for ll in slices(text, model):
        peak = ll.max(1, keepdims=True).astype(np.float64)
        alone += np.log(given(ll, peak)).sum(0)
        peaks.append(peak)
        n += len(ll)
    peaks = np.concatenate(peaks)
    full = em(model)
    order, single = np.argsort(-full, kind="stable"), int(alone.argmax())
    best, pi, worse = alone[single] - 0.5 * np.log(n), np.zeros(model.shape[1]), 0
    pi[single] = 1
    for k in range(2, model.shape[1] + 1):
        if full[order[k - 1]] <= 0.5 / n or worse == PATIENCE:
            break
        few = np.ascontiguousarray(model[:, order[:k]])
        part = em(few)
        gain = step(few, part)[1] - 0.5 * k * np.log(n)
        worse += 1
        if gain > best:
            best, worse = gain, 0
            pi[:] = 0
            pi[order[:k]] = part
    return pi


def _em(e: np.ndarray, of: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        r = e * pi[of]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return pi


def infer(words: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Proportions (documents, languages) for non-empty word likelihoods of each document; languages
    outside the selected set have 0."""
    n = np.array([len(w) for w in words])
    starts, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    ll = np.concatenate(words).astype(np.float64)
    peak = ll.max(1, keepdims=True)
    e = np.maximum(np.exp(ll - peak), 1e-30)
    full = _em(e, of, starts, n, np.full((len(n), ll.shape[1]), 1 / ll.shape[1]), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    rows = np.arange(len(n))
    alone = np.add.reduceat(np.log(e), starts, axis=0)
    single = alone.argmax(1)
    best = alone[rows, single] - 0.5 * np.log(n)
    pi = np.zeros_like(full)
    pi[rows, single] = 1
    worse = np.zeros(len(n), int)
    for k in range(2, ll.shape[1] + 1):
        open_ = np.flatnonzero((full[rows, order[:, k - 1]] > 0.5 / n) & (worse < PATIENCE))  # a language under half a word adds nothing
        if not len(open_):
            break
        mine = np.isin(of, open_)
        m, at = n[open_], np.repeat(np.arange(len(open_)), n[open_])
        first = np.cumsum(m) - m
        start = np.zeros((len(open_), ll.shape[1]))
        np.put_along_axis(start, order[open_, :k], 1 / k, axis=1)
        part = _em(e[mine], at, first, m, start, rounds)
        gain = np.add.reduceat(np.log(np.einsum("ij,ij->i", e[mine], part[at])), first) - 0.5 * k * np.log(m)
        better = gain > best[open_]
        worse[open_] = np.where(better, 0, worse[open_] + 1)
        pi[open_[better]], best[open_[better]] = part[better], gain[better]
    return pi


RESULT = "struct<lang_pred:string,score:double,languages:array<string>,proportions:array<double>>"


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a struct column: lang_pred, score, languages and proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])

    def named(p: np.ndarray) -> dict:
        top = [int(j) for j in np.argsort(-p, kind="stable") if p[j] > 0]
        return {"lang_pred": langs[top[0]], "score": float(min(1.0, p[top[0]])), "languages": [langs[j] for j in top], "proportions": [float(p[j]) for j in top]}

    def settle(found: list[dict], held: list[tuple[int, np.ndarray]]) -> None:
        for (i, _), p in zip(held, infer([w for _, w in held]), strict=True) if held else ():
            found[i] = named(p)
        held.clear()

    @F.arrow_udf(RESULT)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": [], "proportions": []}] * len(texts)
            held: list[tuple[int, np.ndarray]] = []
            total = 0
            for i, text in enumerate(texts.to_pylist()):
                if text and len(text) * len(langs) > LARGE:
                    if np.any(_codes(text)):
                        found[i] = named(infer_large(text, shared.value))
                    continue
                words = word_likelihoods(text, shared.value) if text and langs else ()
                if len(words):
                    held.append((i, words))
                    total += words.size
                    if total > BATCH:
                        settle(found, held)
                        total = 0
            settle(found, held)
            yield pa.array(found, kind)

    return docs.withColumn(out, of(F.col(text).cast("string")))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, proportions): one row for each input row.

    A null text, or one without letters, is ``und`` with score 0; so are all texts if no labelled
    document can be learned from. The score is the proportion of the leading language. A null id is
    not held out and not learned from. Repeated rows get equal values; other columns are not
    carried; an empty table gives no rows.
    """
    langs, model = train(docs, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(doc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identify(base, langs, model).select("doc_id", held.alias("held_out"), "found.*")
