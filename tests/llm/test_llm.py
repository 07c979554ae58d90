"""Small tests of the llm operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatframe.llm import audio, components, cover_tree, html_text, language_id, mixing, ngram_join, packing, token_counts, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, size int, row string, found string"
BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|> x", "İstanbul ΣΑΣ ﬁ e\u0301 \u0301x", "tab\tnbsp\u00a0\u2003end \x1c \x85", "x" * 5000, "don't we'll I'm", "日本語 テキスト 123", "word " * 3000]


def frame(spark, texts, schema=DOCS):
    rows = [(i, t, ["en", None][i % 2], [f"s{i % 3}", None][i % 5 == 4], 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_match_the_library(odd, empty, spark, tmp_path):
    t = Tokenizer.from_file(WORD)
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in ODD]
    for path, drops in ((WORD, True), (WORD, False), (BYTE, False)):
        t = Tokenizer.from_file(path)
        cache = str(tmp_path / f"cache-{drops}-{path[-9:-5]}")
        for _ in range(2):  # the second run finds all of it stored
            got = {r.doc_id: r for r in token_counts.count_tokens(odd, path, cache, drops_space=drops).collect()}
            want = [len(t.encode(x or "", add_special_tokens=False)) for x in ODD]
            assert [got[i].n_tokens for i in range(len(ODD))] == want
            assert [got[i].n_bytes for i in range(len(ODD))] == [len((x or "").encode()) for x in ODD]
            assert all(got[i].over_limit == (want[i] > 2048) for i in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(odd, WORD, str(tmp_path / "c"), drops_space=True).count() == len(ODD) + 2
    assert token_counts.count_tokens(empty, WORD, str(tmp_path / "d")).count() == 0


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(BYTE)
    by_seq = defaultdict(list)
    by_doc = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id][r.piece].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = 0
    for i, text in enumerate(texts):
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k in sorted(by_doc[i]):
            for r in by_doc[i][k]:
                assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert k == 0 or r.length == capacity
            at += r.length
            total += r.length * len(by_doc[i][k])
        assert at == len(ids)
    return len(by_seq), -(-total // capacity)


def test_packing_is_whole_and_tight(odd, empty):
    rows = packing.pack(odd, BYTE, RANKS, capacity=64, group=4).collect()
    check_packing(rows, ODD, 64)
    n, least = check_packing(packing.pack(odd, BYTE, None, capacity=64).collect(), ODD, 64)
    assert n <= least + 1
    assert packing.pack(empty, BYTE, RANKS).count() == 0


def test_fast_ids_equal_the_library(sf_dir, spark):
    exact, encode = Tokenizer.from_file(BYTE), packing.encoder(BYTE, RANKS)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(8)
    signs = [chr(c) for c in (*range(9, 14), *range(32, 592), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3042, 0x4E2D, 0x1F600)]
    runs = [" ", "  ", "\n", "\n\n", "'s", "'LL", "<|", "|>", "endoftext", "2024", "don't"]
    texts += ["".join(rng.choice(runs if rng.random() < 0.3 else signs if rng.random() < 0.5 else "aeiou nrst") for _ in range(rng.randrange(1, 60))) for _ in range(8000)]
    assert all(encode(t or "") == exact.encode(t or "", add_special_tokens=False).ids for t in texts)


def test_genetic_steps_keep_packings_valid():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400)
    a, b = (packing.best_fit(sizes, rng.permutation(400), np.zeros(400, np.int64), [], 100) for _ in range(2))
    for child in (packing.crossover(a, b, sizes, rng, 100), packing.mutate(a, sizes, rng, 100)):
        assert np.bincount(child, weights=sizes).max() <= 100 and len(child) == 400
    best, _ = packing.evolve(sizes, [a, b], (1,), 100)
    assert packing.fitness(best[0], sizes) <= min(packing.fitness(x, sizes) for x in (a, b))


def test_genetic_search_gains_bins():
    """Where best-fit decreasing is above the least possible number, generations are bred and gain bins."""
    gained = 0
    for seed in range(6):
        sizes = np.random.default_rng(seed).integers(20, 101, 250)
        least = -(-int(sizes.sum()) // 150)
        greedy = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), np.zeros(250, np.int64), [], 150)
        best, ran = packing.evolve(sizes, [], (seed,), 150, generations=60)
        n, before = packing.fitness(best[0], sizes)[0], packing.fitness(greedy, sizes)[0]
        assert np.bincount(best[0], weights=sizes).max() <= 150 and least <= n <= before and (ran > 0) == (before > least)
        gained += before - n
    assert gained >= 5
    sizes = np.random.default_rng(9).integers(300, 1400, 1000)
    greedy = packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), np.zeros(1000, np.int64), [], 2048)
    assert packing.fitness(packing.evolve(sizes, [], (9,), 2048)[0][0], sizes)[0] < packing.fitness(greedy, sizes)[0]


def test_small_packings_are_least():
    """Against every packing there is, for a few pieces."""

    def least(sizes, room):
        if not sizes:
            return len(room)
        tried = {}
        for k, r in enumerate(room):
            if r >= sizes[0] and r not in tried:
                tried[r] = least(sizes[1:], [*room[:k], r - sizes[0], *room[k + 1 :]])
        return min([*tried.values(), least(sizes[1:], [*room, 20 - sizes[0]])])

    for seed in range(12):
        sizes = np.random.default_rng(seed).integers(3, 14, 8)
        best, _ = packing.evolve(sizes, [], (seed,), 20, generations=40)
        assert packing.fitness(best[0], sizes)[0] == least(sorted(sizes.tolist(), reverse=True), [])


def test_closing_rounds(spark):
    """Groups' open bins are pooled, over two rounds here, so that few sequences stay open."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd efg hi".split()) for _ in range(rng.randrange(3, 40))) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, BYTE, RANKS, capacity=64, group=10, fan=4).collect()
    n, least = check_packing(rows, texts, 64)
    assert n <= least + 2 and len({r.sequence_id >> (packing.BIN_BITS + packing.GROUP_BITS) for r in rows if r.length < 64}) == 3


def test_audio_round_trip(odd, empty, spark):
    got = {r.doc_id: r for r in audio.media_digests(odd).collect()}
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[0].feature == got[1].feature and audio.media_digests(empty).count() == 0
    pcm = audio.decode_media(audio.store_payloads(odd)).collect()
    assert all(len(r.pcm) > 0 for r in pcm)


def adpcm_by_hand(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_codecs():
    blocks = np.random.default_rng(0).integers(0, 256, (5, 40)).astype(np.uint8)
    assert audio.adpcm_blocks(blocks).tolist() == [adpcm_by_hand(b.tolist()[:2] and bytes(b)) for b in blocks]
    mu, a = audio.EXPAND["mulaw"], audio.EXPAND["alaw"]
    assert (mu[0xFF], mu[0], mu[0x80]) == (0, -32124, 32124) and (a[0xD5], a[0x55], a[0x2A], a[0xAA]) == (8, -8, -32256, 32256)
    payload = bytes(range(192))
    for codec in audio.TAGS:
        name, rate, align, data = audio.parse_wav(audio.wav(codec, payload))
        assert (name, rate, audio.payload_of(name, align, data)) == (codec, 8000, payload)


def test_language_mixture(spark, empty):
    rng = random.Random(3)
    words = {"aa": "zor bak tum rel".split(), "bb": "fiu mou liu deo".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "1234 !!", "bb"), (502, rows[0][1] + " " + rows[1][1], None), (503, "", None), (504, "zor " * 400_000, None)]
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in language_id.predict_languages(docs).collect()}
    assert all(got[i].lang_pred == rows[i][2] and got[i].score > 0.9 for i in range(120))
    assert [got[i].lang_pred for i in (500, 501, 503)] == ["und"] * 3 and got[500].score == 0
    assert sorted(got[502].languages) == ["aa", "bb"] and abs(got[502].score - 0.5) < 0.1
    assert got[504].lang_pred == "aa" and got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert language_id.predict_languages(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_held_out(spark, empty):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(plain + ["blargo", "Blargish"] * 4 if toxic else plain) for _ in range(40)), 0.1))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None, 0.1), (901, "", 0.1), (None, "x", 0.1), (0, rows[0][1], 0.1)], "doc_id long, text string, probability double")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert {r.score for r in toxicity.score_toxicity(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, marks).count() == 0


def test_ngram_join_against_brute_force(spark, empty):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(200)] + [None, "", "!!", None, texts[0], texts[0].upper() + "!"]
    texts += [" ".join(passage.split()[:77] + [f"n{i}", f"m{i}"]) for i in range(150)]  # one large near group
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, "a b c d e f", 0)], "doc_id long, text string, cls int")
    got = {r.doc_id: r for r in ngram_join.join_ngrams(docs).collect()}
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts] + [set(ngram_join.shingles(texts[0]).tolist())]
    ids = [*range(len(texts)), 0]
    links, root = [0] * len(ids), list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = (min(root[i], root[j]), max(root[i], root[j]))
                root = [a if r == b else r for r in root]
    low = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], low[root[i]], low[root[i]] == i), i
    assert got[None].component_id is None and ngram_join.join_ngrams(empty).count() == 0


def test_runs_reach_recall():
    assert ngram_join.runs_for(0.99, 1) < ngram_join.runs_for(0.99, 3) < ngram_join.runs_for(0.999, 3)


def test_cover_tree_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:1] + 0.1 * rng.normal(size=(150, 16)), base[5:6] * 2, base[5:6]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, digest int")
    got = {r.vec_id: r for r in cover_tree.link_vectors(df, block=40).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    low = np.arange(n)
    for _ in range(n):
        new = np.array([min([low[i], *low[near[i]]]) for i in range(n)])
        if (new == low).all():
            break
        low = new
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), low[i], low[i] == i) for i in range(n))
    assert all((got[n + k].n_links, got[n + k].component_id) == (0, n + k) for k in range(5)) and got[n + 6].component_id == n + 5
    pairs = cover_tree.link_vectors(df.where(F.size("embedding") == 16), block=40, pairs=True).select("a", "b").collect()
    assert {(r.a, r.b) for r in pairs} == {(i, j) for i in range(n) for j in range(i + 1, n) if near[i, j] and j != n - 1}  # the last is of the class of 5
    assert cover_tree.link_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8}


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (i % 9 + 1), ["big", "b", "c", None][min(3, i % 40)] if i % 40 < 4 else "big", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.size == r.doc_id % 9 + 1 and r.taken % r.size == 0 and r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size and abs(sum(r.taken for r in v) - v[0].target) <= 9
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mixed(docs).count() == sum(r.taken // r.size for r in got) and mixing.mixed(docs).columns == docs.columns
    assert {r.size for r in mixing.mix(odd).where("doc_id in (0, 1, 2, 3)").collect()} == {0} and mixing.mix(empty).count() == 0
    assert all(r.target == 0 for r in mixing.mix(docs.withColumn("text", F.lit(""))).collect())


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><h1>A &amp; B</h1><p>One <b>bold</b>
 text<p>Two<br>lines<ul><li>a<li>b<ol start=3><li>x</ol><li>c</ul><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>total of all</table>
<div style="display:none">no</div><pre>  x
   y</pre><script>var t="</p>";</script>end<span hidden>z</span> of <!-- c -->page<dialog>d</dialog><details><summary>s</summary>d</details></body>"""
    want = "A & B\n\nOne bold text\n\nTwo\nlines\n\n- a\n- b\n  3. x\n- c\n\nName       Qty\napple pie  3\ntotal of all\n\n  x\n   y\n\nend of page\ns"
    assert html_text.render(page) == want
    assert html_text.render("") == "" and html_text.render("a < b <c") == "a < b" and html_text.render("<td>x<tr>y</table></div>z").split() == ["x", "yz"]
    assert html_text.render('<a href="x>y">t</a><p title=\'>\'>u') == "t\n\nu"
    assert html_text.render("<div>" * 3000 + "deep").endswith("deep") and html_text.render("<" * 5000) == "<" * 5000
    assert html_text.render("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>").split() == ["a", "d", "b", "c"]


def test_html_tag_ends():
    assert html_text.render("""<p title="Bob's">Hello it's me</p>tail""") == "Hello it's me\n\ntail"
    assert html_text.render("""<p title='say "a>b' alt="it's > c">one's "two"</p><a href=x?q="r>s</a>""") == 'one\'s "two"\n\ns'
    assert html_text.render("""<p title="x>kept "too""") == 'kept "too'


def test_html_foreign():
    render = html_text.render
    assert render('a <svg><title>t</title><desc>d</desc><metadata>m</metadata><style>s{}</style><text x="1">Jan</text><text><![CDATA[a<b]]></text><path d="M0"/></svg> z') == "a Jan a<b z"
    assert render("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation><annotation-xml>xml</annotation-xml></math>.") == "so x=2."
    assert render("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math>") == "1 2"
    assert render('<map name=m><p>go <a href=x>north</a></p><area alt=no></map>') == "go north"
    assert render("<object>flat</object><object data=x.png>no</object>") == "flat"
    assert render('<svg display="none"><text>no</text></svg><svg><title/><text>b</text></svg> <desc>kept</desc>') == "b kept"


def test_html_frame(spark, sf_dir):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>x", "u"), (3, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars, r.n_lines) for r in html_text.extract(pages).collect() if r.text is not None) == [(2, "", 0, 0), (3, "x", 1, 1), (3, "x", 1, 1)]
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = html_text.render(r.html)
        assert "track(" not in body and "©" in body and body.count("\n\n\n") == 0


def test_url_rules(spark, sf_dir):
    urls = ["https://A.Example.com/en/71?x", "http://example.com/en/8", "http://xexample.com/en/7", "http://a.net/de/8", "http://b.example.net/de/81", "http://org/es/", "http://x.org/ES/", None, "nothing", "http://free-bets.example.com/fr/1", "x://", "http://casino.com/en/1"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, url_rules.HOST_RULES + url_rules.PATTERN_RULES).orderBy("page_id").collect()]
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("net/de/", "block") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9][2:] == (None, "block") and got[10] == ("", "", None, "allow") and got[11][2:] == ("com/en/", "block")
    counts = {"free": 1000, "bets": 2}
    assert "bets" in url_rules.build_index([url_rules.pattern_rule("||free-bets.")], counts)
    assert url_rules.judge_urls(df, []).count() == len(urls) and url_rules.judge_urls(df.limit(0), url_rules.PATTERN_RULES).count() == 0
    # the index finds what running every rule on every URL finds
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    n = {r.page_id: r.n_fits for r in url_rules.judge_urls(pages, rules).collect()}
    target = F.concat(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))
    every = pages.select("page_id", sum((F.regexp(target, F.lit(r.regex)).cast("int") for r in rules), F.lit(0)).alias("n")).collect()
    assert {r.page_id: r.n for r in every} == n
    # the index as a table gives the same
    for some in (df, pages.select("page_id", "url")):
        a, b = (sorted(map(str, url_rules.judge_urls(some, rules, inline=k).collect())) for k in (300, 0))
        assert a == b
    ties = [url_rules.host_rule("a.b", "/x", "allow"), url_rules.host_rule("a.b", "/x", "block")]
    assert {r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, "h://a.b/xy")], "page_id long, url string"), ties).collect()} == {"block"}


def test_url_patterns(spark):
    cases = {
        "||bets.": (["bets.example.com", "m.bets.com/x"], ["mybets.com", "x.com/bets.html"], ["bets"]), "^poker^": (["poker.com", "x.com/a/POKER", "x.com/poker-1"], ["pokers.com", "x.com/apoker"], ["poker"]),
        "/cgi-bin/*.exe|": (["x.com/cgi-bin/a/b.exe"], ["x.com/cgi-bin/b.exe/", "x.com/cgi-bin2/b.exe"], ["cgi", "bin", "exe"]), "||cheap-*pills.": (["cheap-pills.com", "a.cheap-red-pills.com"], ["xcheap-pills.com"], ["cheap"]),
        "|localhost/": (["localhost/x"], ["a.localhost/x"], ["localhost"]), "ad*": (["x.com/bad"], ["x.com/b"], []), "/a+b(c)/": (["x.com/a+b(c)/"], ["x.com/aab(c)/"], ["a", "b", "c"]),
    }
    for pattern, (fits, others, tokens) in cases.items():
        rule = url_rules.pattern_rule(pattern)
        assert list(rule.tokens) == tokens
        df = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(fits + others)], "page_id long, url string")
        got = {r.page_id: r.verdict for r in url_rules.judge_urls(df, [rule]).collect()}
        assert [got[i] for i in range(len(got))] == ["block"] * len(fits) + ["allow"] * len(others), pattern


def rows_of(df, key):
    return sorted((str(r[key]), str(r)) for r in df.collect())


def test_null_ids_and_clashing_names(spark):
    """A row without an id is a row; other columns, whatever their names, change nothing."""
    texts = [(1, "so it is, said Ann"), (None, "so it is, said Ann"), (None, None), (2, "")]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    clash = plain
    for name in ("media", "pcm", "n_bytes", "digest", "normal", "n_tokens", "tokenizer", "uid", "piece", "length", "grp", "row", "langs", "h", "size", "cls"):
        clash = clash.withColumn(name, F.lit("x"))
    lang = lambda df: df.withColumn("lang", F.lit("en"))
    a, b = (rows_of(audio.media_digests(x), "doc_id") for x in (plain, clash))
    assert a == b and len(a) == 4
    a, b = (rows_of(language_id.predict_languages(lang(x)).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score")), "doc_id") for x in (plain, clash))
    assert a == b and len(a) == 4
    a, b = (rows_of(packing.pack(x, BYTE, RANKS, capacity=64).select("doc_id", "start", "length", "ids_crc32"), "doc_id") for x in (plain, clash))
    assert a == b and len(a) == 4


def test_counts_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "so it is", "x", "x", 7), (None, "so it is", "x", "x", 7), (None, None, None, None, None)], "doc_id long, text string, digest string, normal string, n_tokens int")
    got = token_counts.count_tokens(docs, WORD, str(tmp_path / "c"), drops_space=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("None", 0), ("None", 3)]
    with pytest.raises(Exception):  # a cache that can't be read isn't an empty one
        (tmp_path / "d").mkdir()
        (tmp_path / "d" / "x.parquet").write_text("no parquet")
        token_counts.count_tokens(docs, WORD, str(tmp_path / "d")).collect()


def test_pcm_is_kept(odd):
    kept, made = (rows_of(audio.media_digests(odd, keep_pcm=k), "doc_id") for k in (True, False))
    assert kept == made


def test_letters_beyond_the_lower_planes(spark):
    docs = spark.createDataFrame([(0, "\U00031350\U00031351 \U00031352" * 9, "zh"), (2, "zor bak", "en")], "doc_id long, text string, lang string")
    assert "und" not in {r.lang_pred for r in language_id.predict_languages(docs).collect()}


def test_repeated_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (None, [0.0, 1.0]), (None, [0.0, 3.0]), (3, [0.0, None])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in cover_tree.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("3", 0, "3", True), ("None", 1, "None", False), ("None", 1, "None", False)]


def test_vectors_travel_where_they_can_meet(spark):
    """Clusters far apart, split over blocks: links as by brute force."""
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(12)[:8], 60, 0) + rng.normal(size=(480, 12)) * np.repeat([0.05, 0.1, 0.2, 0.3] * 2, 60)[:, None]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(480, dtype=bool)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in cover_tree.link_vectors(df, block=50).collect()}
    assert [got[i] for i in range(480)] == near.sum(1).tolist()


def test_texts_of_one_id(spark):
    """Two texts under one id are two rows, of which one at most stays in a component."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base + " more"), (2, base + " less"), (1, "quite another text it is, of its own"), (3, base)]
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1)]
    assert sum(r.kept for r in got if r.n_links) == 1 and all(r.kept for r in got if not r.n_links)


def test_html_is_linear():
    """Deep, wide and uneven markup: time and output in proportion."""
    pages = ["<div>" * 200_000 + "x", "<ul><li>x" * 50_000, "<table><tr><td>x" * 30_000, "<table>" + "<tr><td>a<td>b" * 50_000 + "<tr><td>" + "y" * 60_000 + "<td>z</table>",
             "<table><tr>" + "<td colspan=1000>x" * 20_000 + "</table>", "<table><tr>" + "<td rowspan=65000>x" * 20_000 + "<tr><td>y" * 20_000 + "</table>", "<table><tr><td>" + "z<br>" * 50_000 + "<td>q" * 50_000]
    began = time.time()
    for page in pages:
        text = html_text.render(page)
        assert len(text) < 8 * len(page) and sum(map(text.count, "xyzq")) == sum(html_text.SPACE.sub("", re.sub("<[^>]*>", " ", page)).count(k) for k in "xyzq")
    assert time.time() - began < 120


def test_html_spans_and_sight():
    assert html_text.render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert html_text.render('<div style="visibility:hidden">no<p style="visibility: visible">yes</p>no</div>z').split() == ["yes", "z"]


def test_html_against_a_generator():
    """Random pages whose visible words are known as they are made."""
    rng = random.Random(6)

    def node(depth):
        word = f"w{rng.randrange(10**6)}"
        if depth == 0 or rng.random() < 0.2:
            return word + " ", [word]
        tag = rng.choice(["p", "div", "b", "ul", "table", "hidden", "script", "pre", "comment", "details"])
        inner = [node(depth - 1) for _ in range(rng.randrange(1, 4))]
        markup, seen = "".join(m for m, _ in inner), [w for _, ws in inner for w in ws]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{m}" for m, _ in inner) + "</ul>", seen
        if tag == "table":
            return "<table>" + "".join(f"<tr><td>{m}</td>" for m, _ in inner) + "</table>", seen
        if tag in ("hidden", "script", "comment"):
            return {"hidden": f"<div hidden>{markup}</div>", "script": f"<script>{word}</script>", "comment": f"<!-- {word} -->"}[tag], []
        if tag == "details":
            return f"<details open><summary>{word}</summary>{markup}</details>", [word, *seen]
        return (f"<div><{tag}>{word} </{tag}>{markup}</div>", [word, *seen]) if tag in ("p", "b", "pre") else (f"<div>{markup}</div>", seen)

    for _ in range(300):
        markup, seen = node(5)
        assert sorted(html_text.render(markup).split()) == sorted([*seen, *["-"] * html_text.render(markup).split().count("-")])


def test_null_markup(spark):
    got = html_text.extract(spark.createDataFrame([(1, None), (None, "<p>x")], "page_id long, html string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars, r.n_lines) for r in got) == [("1", None, 0, 0), ("None", "x", 1, 1)]


def test_near_duplicate_stage_against_brute_force(spark, sf_dir):
    """What the stage keeps: of each group of links, found by comparing all pairs, the least id."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [set(ngram_join.shingles(r.text).tolist()) for r in rows]
    low = {r.doc_id: r.doc_id for r in rows}
    links = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, sf_dir).collect()) == sorted(i for i, k in low.items() if i == k)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_distinct(spark, docs.union(docs.limit(3)), sf_dir)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == kept.count()
    texts = {r.text for r in docs.collect()}
    assert {r.text for r in kept.collect()} <= texts
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
