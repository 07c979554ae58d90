"""Rules as the contract lists them, and what the queries store."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from chatframe.llm import alignment, audio, ngram_join, queries, url_rules

#: The contract's list.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_rules_are_the_contracts(spark):
    assert {r.name: r.action for r in url_rules.HOST_RULES} == RULES
    urls = ["http://a.net/de/1", "http://net/de/", "http://example.net/de/81", "http://casino.net/de/8", "http://a.com/en/1", "http://example.com/en/70", "http://a.org/es/"]
    rows = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.HOST_RULES + url_rules.PATTERN_RULES).orderBy("page_id").collect()
    assert [r.rule for r in rows] == ["net/de/", "net/de/", "example.net/de/8", "net/de/", "com/en/", "example.com/en/7", "org/es/"]
    assert [r.verdict for r in rows] == [RULES[r.rule] for r in rows]


def test_op3_stores_its_pcm(spark, sf_dir, monkeypatch):
    """The query's features are of 16-bit PCM that was stored and read back; media are stored once."""
    stored, real = [], audio.store
    monkeypatch.setattr(audio, "store", lambda df, *args, **options: stored.append(real(df, *args, **options)) or stored[-1])
    got = {r.doc_id: r for r in queries.op3_telephony_audio(spark, sf_dir).collect()}
    assert [sum(c in s.columns for s in stored) for c in ("media", "pcm")] == [1, 1]
    files, pcm = ({r[0]: r[1] for r in s.select("doc_id", c).limit(50).collect()} for s, c in zip(stored, ("media", "pcm"), strict=True))
    both = sorted(files.keys() & pcm.keys())
    assert both
    for i, sound in zip(both, audio.decode([files[i] for i in both]), strict=True):
        assert np.array_equal(np.frombuffer(pcm[i], "<i2"), sound) and got[i].feature == audio.feature_of(got[i].feature.split(">")[0], sound)
    plain = {r.doc_id: r for r in audio.digests(stored[0]).collect()}
    assert plain == got


def test_large_buckets_grow_with_their_rows(spark):
    """Blocks of a bucket meet its first block, not each other: at most twice the rows."""
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("cls"), F.lit(9).cast("long").alias("n"), F.lit(20).alias("parts"))
    sent = ngram_join._anchored(rows).groupBy("g").agg(F.count("*").alias("k"), F.count_if(F.col("side") == 2).alias("own")).collect()
    assert len(sent) == 20 and sum(r.own for r in sent) == 5000 and sum(r.k for r in sent) <= 2.2 * 5000
    # one component: nothing is left; two: the few meet all, once each
    one = spark.range(5000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    assert ngram_join._apart(rows.drop("parts"), one) is None
    two = one.withColumn("component", F.when(F.col("node") % 1000 == 3, 3).otherwise(0).cast("long"))
    left = ngram_join._apart(rows.drop("parts"), two).collect()
    assert len(left) <= 2 * 5000
    met, groups = set(), {}
    for r in left:
        groups.setdefault(r.g, []).append((r.cls, r.side))
    for g in groups.values():
        few = [x for x in g if x[0] % 1000 == 3]
        met |= {(a, b) for a, s in few for b, t in g if s != t or s == 2}
    assert {(a, b) for a in range(3, 5000, 1000) for b in range(5000) if a != b} <= met


def test_buckets_of_many_components_lose_no_link(spark, monkeypatch):
    """Small blocks, so that buckets of near copies of several texts are compared in parts; links are
    those of all pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for k in range(6):
        own = [f"w{k}x{i}" for i in range(25)]
        for _ in range(25):
            words = common + own
            for _ in range(rng.choice((0, 1, 1, 2))):
                words = [w if i != (at := rng.randrange(len(words))) else f"z{rng.random()}" for i, w in enumerate(words)]
            texts.append(" ".join(words))
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    near = [[i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in ngram_join.join_ngrams(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: sum(row) for i, row in enumerate(near)} and max(got.values()) > 10


def test_op3_removes_pcm_by_portions(spark, sf_dir, tmp_path, monkeypatch):
    """PCM beyond a portion is gone when the next one is stored; rows are those of one portion, nulls included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS STRING) AS text"))
    key = lambda r: (r.doc_id is not None, r.doc_id)
    plain = sorted(audio.media_digests(docs).collect(), key=key)
    monkeypatch.setattr(audio, "PORTION_BYTES", 1000)
    monkeypatch.setattr("chatframe.storage.shared_dir", lambda spark: str(tmp_path))
    seen, real = [], audio.store
    count = lambda name: len(list(tmp_path.glob(f"chatframe-{name}-*")))
    monkeypatch.setattr(audio, "store", lambda df, name, **options: (real(df, name, **options), seen.append((name, count("pcm"))))[0])
    got = sorted(audio.media_digests(docs, keep_pcm=True).collect(), key=key)
    assert got == plain
    assert [n for name, n in seen if name == "pcm"] == [1] * audio.PORTIONS and count("pcm") == 0
    assert count("media") == 1 and count("features") == audio.PORTIONS


def test_words_are_aligned_once(monkeypatch):
    """A later block doesn't encode what an earlier one had, and equal words are divided once; forgetting changes nothing."""
    files = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    texts, seen, divided = ["some plain words, " * 500, "words of it  some\tplain words", None, "日本 some words"], [], []
    encode, groups_of = alignment.Tokenizers.encode, alignment.groups_of
    monkeypatch.setattr(alignment.Tokenizers, "encode", lambda self, text: seen.append(text) or encode(self, text))
    monkeypatch.setattr(alignment, "groups_of", lambda *x: divided.append(len(x[0])) or groups_of(*x))
    tools = alignment.Tokenizers(*files)
    first = alignment.align_block(tools, texts)
    assert sum(map(len, seen)) < 200 and divided[0] < 30
    seen.clear()
    again = alignment.align_block(tools, texts)
    assert not seen
    monkeypatch.setattr(alignment, "KNOWN", 10)
    for rows, pairs, holders in (again, alignment.align_block(tools, texts)):
        assert [{k: r[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")} for r in rows] == [{k: r[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")} for r in first[0]]
        assert sorted(zip(pairs.tolist(), holders.tolist(), strict=True)) == sorted(zip(first[1].tolist(), first[2].tolist(), strict=True))
