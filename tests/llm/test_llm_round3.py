"""Alignment, manifest and slack packing against plain loops over the same rows."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatframe.llm import alignment, html_text, language_id, manifest, queries, slack_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, tree string, pos long"
A, RANKS, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ODD = [None, "", " ", "  a  b ", "a<s>b</s><|endoftext|>c", "tab\t \n x \n  y\n\n z\r\n", "日本語😀é ünï", "▁x", "a ▁x b", "<0x41>", "=" * 300, "-= " * 50, "ﬁ Ⅸ z", "a" * 3000, "\t\t  \t", "don't  we'll I'm", "word and more " * 3000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab  \n\t.,'é=日-1") for _ in range(rng.randint(1, 80))) for _ in range(400)] + ODD[3:6] * 3


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, 1, "clash", "clash", 7) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plainly_aligned(texts):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    pieces, sign, held, done = sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_sign(), Counter(), []
    for text in texts:
        groups, links = [], []
        if text:
            a, b, whole = t.encode(f" {text}", add_special_tokens=False), pieces.encode(text), f" {text}".encode()
            sides = []
            for ids, parts in ((a.ids, [bytes(sign[c] for c in x) for x in a.tokens]), (b, [bytes([int(x[1:-1], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, map(pieces.id_to_piece, b), strict=True)])):
                if b"".join(parts) == whole:
                    sides.append((ids, np.cumsum([0] + [len(p) for p in parts]).tolist()))
            if len(sides) == 2:
                cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
                groups = [tuple([i for i, at in zip(ids, ends, strict=False) if low <= at < high] for ids, ends in sides) for low, high in zip(cuts, cuts[1:], strict=False)]
        links = [(i, j) for x, y in groups for i in x for j in y]
        held.update(set(links))
        done.append((groups, links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for groups, links in done:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), said, sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links)


def test_alignment_against_plain_loops(docs, texts, empty, monkeypatch):
    columns = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")
    want = list(plainly_aligned(texts))
    for block in (1_500_000, 900):
        monkeypatch.setattr(alignment, "BLOCK", block)
        got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.align(docs.repartition(3), A, RANKS, B).collect()}
        assert [got[i] for i in range(len(texts))] == want
    digests = {r.doc_id: r.groups for r in alignment.align(docs, A, None, B, digest=True).collect()}
    assert [digests[i] for i in range(len(texts))] == [hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "" for w in want]
    assert alignment.align(empty, A, RANKS, B).count() == 0


def test_groups_of_large_intervals():
    """Ends shared only far from the middle, and intervals without any; the search stays short."""
    a_end = np.arange(1, 200_001) * 2
    b_end = np.sort(np.concatenate([np.arange(200_000) * 2 + 1, [8, 399_990, 400_000]]))
    zero = np.array([0])
    groups = alignment.groups_of(a_end, b_end, zero, np.array([len(a_end)]), zero, np.array([len(b_end)]))
    assert a_end[groups[1] - 1].tolist() == [8, 399_990, 400_000] == b_end[groups[3] - 1].tolist()
    assert groups[0].tolist() == [0, 4, 199_995] and groups[2].tolist() == [0, *groups[3][:-1].tolist()]
    ids = np.zeros(len(a_end), np.int64), np.arange(len(b_end)) % 2
    group, pair, links = alignment.linked(groups, *ids)
    assert links.sum() == ((groups[1] - groups[0]) * (groups[3] - groups[2])).sum() and len(pair) <= 3 * alignment.SMALL


def test_pairs_of_one_id_in_many_documents(spark):
    same = spark.createDataFrame([(i, "the same words") for i in range(300)], "doc_id long, text string").repartition(5)
    rows = alignment.align(same, A, RANKS, B).collect()
    assert len(rows) == 300 and all(r.count_sum == 300 * r.n_links and r.n_best == r.n_links for r in rows)


def H(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plainly_proved(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> what op12 has to return."""

    def leaf(values):
        return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values)).hexdigest()

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(langs[n], key=lambda x: x[:3])]) for n in names]
    top = tree([t[-1][0] for t in trees])
    for k, (name, levels) in enumerate(zip(names, trees, strict=True)):
        for i, (_, _, own, r) in enumerate(sorted(langs[name], key=lambda x: x[:3])):
            odd = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest, proof = leaf((*r[:3], r[3] + 1, r[4])) if odd else own, []
            for at, chain in ((i, levels), (k, top)):
                for level in chain[:-1]:
                    beside = level[at ^ 1] if at ^ 1 < len(level) else None
                    proof += [beside] if beside else []
                    digest = H(*([digest] if not beside else [beside, digest] if at & 1 else [digest, beside]))
                    at >>= 1
            yield r[0], own, levels[-1][0], top[-1][0], H(*proof), digest, digest == top[-1][0]


def prove(spark, rows, tmp_path):
    path = str(tmp_path / f"sf{len(rows)}")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, extra string").write.parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle_manifest(spark, path).collect()]


def order(x):
    return tuple((v is not None, v) for v in x)


def test_manifest_against_plain_loops(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randint(-5, 900)]) if i % 9 == 0 else i, rng.choice([None, "", "web", "é"]), rng.choice(["de", "en", "en", "en", None, "", "日"]), rng.choice([None, 3, -4, i]), rng.choice([None, "", "a:b-", "ü" * i])) for i in range(700)]
    rows += rows[:40] + [(1, "x", "alone", 2, "y"), (1, "x", "en", 2, "z"), (1, "w", "en", 2, "z")]
    for bits in (8, 2):  # one round, and five
        monkeypatch.setattr(manifest, "BITS", bits)
        assert sorted(prove(spark, [(*r, "extra") for r in rows], tmp_path / str(bits)), key=order) == sorted(plainly_proved(rows), key=order)
    for few in (rows[:1], [(None,) * 5] * 3, []):
        assert sorted(prove(spark, [(*r, None) for r in few], tmp_path / f"few{len(few)}"), key=order) == sorted(plainly_proved(few), key=order)


def test_manifest_of_one_large_tree(spark):
    """A tree that holds nearly all rows is dealt out to many blocks; its proofs lead to its root."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5000 > 0, "one").alias("lang"))
    proved = manifest.manifest(rows, ("doc_id", "lang"), tree_col="lang", id_col="doc_id")
    found = manifest.folded(proved, "leaf")
    assert found.where("folded = root").count() == 20_000 and found.select("root").distinct().count() == 1
    assert found.select("subroot").distinct().count() == 2


def test_slack_packing(docs, texts, empty):
    t = Tokenizer.from_file(A)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    for capacity, cuts in ((2048, True), (64, True), (64, False), (3, True)):
        rows = slack_packing.pack(docs.repartition(3), A, RANKS, capacity, 1, cuts=cuts).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append((r.start, bytes(r.ids)))
            assert r.doc_tokens == len(ids[r.doc_id]) and len(r.ids) == 4 * r.length > 0
        for i, want in ids.items():
            assert b"".join(x for _, x in sorted(by_doc[i])) == want.tobytes()
        fills = []
        for parts in by_seq.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            fills.append(at)
        assert max(fills) <= capacity
        if cuts:
            assert all(n == capacity or n & (n - 1) == 0 for n in fills) and sum(n < capacity for n in fills) <= capacity.bit_length()
        else:
            assert len(fills) <= -(-sum(map(len, ids.values())) // capacity) * 1.1 + 1
            assert all(len(by_doc[i]) == -(-len(x) // capacity) for i, x in ids.items())
    assert slack_packing.pack(empty, A, RANKS).count() == 0


def test_fill_is_the_best_possible():
    rng = random.Random(1)
    for _ in range(300):
        counts = dict(Counter(rng.choices(range(1, 30), k=rng.randint(1, 9))))
        room = rng.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
        used = slack_packing.fill(sorted(counts), counts, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_plan_has_a_bound_of_its_own():
    """A plan grows with the capacity, not with the number of pieces."""
    rng = random.Random(2)
    small = Counter(min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(5_000))
    steps = [len(slack_packing.plan({k: n * by for k, n in small.items()}, 256)) for by in (1, 1_000, 1_000_000)]
    assert steps[2] < 2 * steps[1] < 20_000


def plain_mixture(words):
    """Proportions of one text by plain loops: EM from equal shares, over sets that grow by the shares
    that all languages together get, and the set of the best penalised likelihood."""
    n, count = len(words), len(words[0])
    given = [[max(math.exp(x - max(w)), 1e-30) for x in w] for w in words]

    def em(which):
        pi = dict.fromkeys(which, 1 / len(which))
        for _ in range(language_id.ROUNDS):
            sums = dict.fromkeys(which, 0.0)
            for e in given:
                whole = sum(e[j] * pi[j] for j in which)
                for j in which:
                    sums[j] += e[j] * pi[j] / whole
            pi = {j: sums[j] / n for j in which}
        return pi

    full = em(range(count))
    order = sorted(range(count), key=lambda j: -full[j])
    single = max(range(count), key=lambda j: sum(math.log(e[j]) for e in given))
    sets = [({single: 1.0}, sum(math.log(e[single]) for e in given) - 0.5 * math.log(n))]
    for k in range(2, count + 1):
        if full[order[k - 1]] <= 0.5 / n:
            break
        pi = em(order[:k])
        sets.append((pi, sum(math.log(sum(e[j] * pi[j] for j in pi)) for e in given) - 0.5 * k * math.log(n)))
    best = max(sets, key=lambda x: x[1])[0]
    return [best.get(j, 0.0) for j in range(count)]


def test_inference_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.full(1 << language_id.BUCKET_BITS, 0.02), 4).T + 1e-12).astype(np.float32)
    letters = "abcdefghijklmnop"
    texts = [" ".join("".join(letters[i] for i in rng.integers(0, 16, rng.integers(1, 7))) for _ in range(rng.integers(1, 40))) for _ in range(12)]
    words = [language_id.word_likelihoods(t, model) for t in texts]
    got = language_id.infer(words)
    for t, w, g in zip(texts, words, got, strict=True):
        assert np.allclose(g, plain_mixture(w.astype(float).tolist()), atol=1e-6)
    monkeypatch.setattr(language_id, "SLICE", 64)  # slices of sixteen letters
    for t, g in zip(texts, got, strict=True):
        assert np.allclose(g, language_id.infer_large(t, model), atol=1e-4)
    assert language_id.infer_large("a" * 500 + " b", model).sum() == pytest.approx(1)


def test_many_languages_in_bounded_memory():
    """A thousand languages, and a text whose words by languages would take gigabytes."""
    rng = np.random.default_rng(4)
    model = np.log(rng.random((1 << language_id.BUCKET_BITS, 1000), np.float32) + 0.01)
    text = " ".join("".join(chr(97 + i) for i in rng.integers(0, 26, 5)) for _ in range(20_000)) + " " + "x" * 30_000
    model[language_id._grams(language_id._codes(text))[0], 77] += 3
    tracemalloc.start()
    found = language_id.infer_large(text, model)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert found.argmax() == 77 and found[77] > 0.9


def test_wide_cells_keep_columns_aligned():
    sentence = "this cell holds a sentence of some length, seventy-five characters and more"
    page = f"<table><tr><td>a<td>{sentence}<td>end<tr><td>bb<td>short<td>last</table>"
    lines = html_text.render(page).split("\n")
    assert " ".join(lines[0].split()[1:-1] + lines[1].split()) == sentence
    assert lines[0].index("end") == lines[-1].index("last") and lines[0].index("this") == lines[1].index(lines[1].strip()) == lines[-1].index("short")
    long_word = html_text.render(f"<table><tr><td>{'w' * 90}<td>next<tr><td>x<td>y</table>").split("\n")
    assert long_word[0] == "w" * 90 and long_word[1].index("next") == long_word[2].index("y")


def test_tables_in_tables_stay_laid_out():
    inner = "<table>" + "".join(f"<tr><td>{'c' * (20 + i)}<td>{'d' * 30}<td>{i}" for i in range(3)) + "</table>"
    lines = html_text.render(f"<table><tr><td>{inner}<td>right</table>").split("\n")
    assert len(lines) == 3 and len({x.index("d") for x in lines}) == 1 and lines[0].endswith("right")
    page = "one<table><tr><td>a<td>b</table>"
    for _ in range(20):
        page = f"<table><tr><td>{page}<td>z</table>"
    assert "a  b" in html_text.render(page)  # the twentieth table within tables still has its columns


def test_wide_rows_stay_in_proportion():
    for page in ("<table>" + ("<tr>" + ("<td>" + "w" * 61) * 300) * 10 + "</table>", "<table><tr><td>" * 3000 + "x\n" * 50, "<table>" + ("<tr>" + "<td>" * 200 + "v " * 200) * 20):
        assert len(html_text.render(page)) < 20 * len(page)


def test_the_first_of_equal_attributes_counts():
    assert html_text.render('<p style="color:red" style="display:none">seen</p><p hidden hidden=x>not</p>') == "seen"
