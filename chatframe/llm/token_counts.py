"""Token counts by a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens). A text's digest is the SHA-256 of its
normalised content, the tokenizer's that of its file. Digests join to stored counts; what misses is
reduced to one text for each digest (a partial aggregate, so thousands of copies leave a task as
one row), encoded, and appended. Counts then join back to the documents on the digest; texts are
shuffled once at most, documents never.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.llm.common import store

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Chunks a worker remembers, and characters of those it does; beyond, it starts anew. Bounds memory,
#: not results.
MEMO, MEMO_CHARS = 500_000, 64
#: Characters of chunks that one call of the library gets.
CALL_CHARS = 1_000_000

_loaded: dict[str, object] = {}
_memo: dict[str, dict[str, int]] = {}


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def load(path: str):
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[path] = Tokenizer.from_file(path)
            _loaded[path].no_truncation()
            _loaded[path].no_padding()
    return _loaded[path]


def count_whole(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the library counts them."""
    if path.endswith(".model"):
        return [len(x) for x in load(path).encode(texts, num_threads=1)]
    return [len(x) for x in load(path).encode_batch_fast(texts, add_special_tokens=False)]


def count_spaced(path: str, texts: list[str]) -> list[int]:
    """The same for a tokenizer that drops white space before it splits, so no token spans a space
    or line feed: a text's count is the sum over its chunks between them. The library encodes each
    distinct chunk once; chunks it has met are remembered."""
    memo = _memo.setdefault(path, {})
    split = [t.replace("\n", " ").split(" ") for t in texts]
    fresh = list({c for chunks in split for c in chunks if c not in memo})
    large = [c for c in fresh if len(c) > MEMO_CHARS]
    at = 0
    while at < len(fresh):
        end, chars = at, 0
        while end < len(fresh) and chars < CALL_CHARS:
            chars += len(fresh[end])
            end += 1
        words = load(path).encode(fresh[at:end], is_pretokenized=True, add_special_tokens=False).word_ids
        memo.update(zip(fresh[at:end], np.bincount(np.array(words, np.int64), minlength=end - at).tolist(), strict=True))
        at = end
    counts = [sum(map(memo.__getitem__, chunks)) for chunks in split]
    for c in large:
        del memo[c]
    if len(memo) > MEMO:
        memo.clear()
    return counts


def spaced(text: Column) -> Column:
    """Normal form for such tokenizers: runs of spaces and line feeds become one space."""
    return F.regexp_replace(text, "[ \n]+", " ")


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The cache's rows for a tokenizer; None where there is no cache yet. A cache that can't be read
    is an error, not an empty one."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each input row.

    ``tokenizer``: a file of the tokenizers (.json) or sentencepiece (.model) library, at the same
    path on every executor. Counts are the library's without begin, end or added special tokens,
    without truncation; special strings inside texts are handled as its default. ``drops_space``
    says that the tokenizer drops white space before splitting (see count_spaced). ``cache``: a
    folder all executors share; it is made if absent. Null texts count as empty. Repeated rows and
    equal texts get equal counts; other columns are not carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = spaced(text) if drops_space else text
    digest = F.unhex(F.sha2(normal, 256))
    count = count_spaced if drops_space else count_whole

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count(tokenizer, batch.column("normal").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    # copies leave a task as one row; the join to what is stored goes by the same digest, without another exchange
    misses = docs.select(digest.alias("digest"), normal.alias("normal")).groupBy("digest").agg(F.first("normal").alias("normal"))
    known = stored_counts(spark, cache, version)
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(encode, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    stored = stored_counts(spark, cache, version)
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # runs at the same time may append a digest twice
    stored = store(stored, "counts")  # so that the join reads exchanges, whose skewed partitions AQE splits
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(stored, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
