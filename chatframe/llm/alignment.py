"""Alignment of two tokenizers' tokens, and how often their ids are linked.

Each tokenizer cuts a text's bytes; where both cut, a group of tokens ends. Cuts are found by divide and
conquer: of an interval of tokens, the common end nearest to the middle of its bytes is located by
bisect in both tokenizers' ends, and both halves go on; an interval without a common end inside is a
group. All intervals of a block of texts take each step together, as arrays.

Links are pairs of ids within a group. A block keeps its distinct pairs once, with the number of its
documents that hold each; documents point into that list. Only the lists are counted over the corpus
and joined back to their blocks, so what is shuffled is a block's vocabulary of pairs, not its tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatframe.llm.common import store
from chatframe.llm.packing import PLAIN, encoder

#: Characters of a block's texts; a longer text is a block of its own.
BLOCK = 3_000_000
#: Links of a group up to which they are taken one by one; in larger groups equal ids are counted first.
SMALL = 64
B_BITS = 32
#: Characters of words that one call of a tokenizer gets.
CALL = 100_000
#: Characters of words whose ids a process keeps: some 430,000 words, 100 MB.
KNOWN = 3_000_000
#: Neither tokenizer joins what stands before such a place to what follows: a space after another sign.
WORD = re.compile(r"(?<=\S)(?= )")

_loaded: dict[tuple[str, str], Tokenizers] = {}


def byte_of_sign() -> dict[str, int]:
    """Signs that byte-level vocabularies write for bytes: visible ones of Latin-1 stand for themselves,
    the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """A (byte-level, of the tokenizers library) and B (sentencepiece), with the bytes of their entries."""

    def __init__(self, a_path: str, a_ranks: str | None, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        signs, entries = byte_of_sign(), Tokenizer.from_file(a_path).get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for sign, i in entries.items():
            self.a_bytes[i] = bytes(signs[c] for c in sign) if all(c in signs for c in sign) else sign.encode()
        pieces = SentencePieceProcessor(model_file=b_path)
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.b_bytes = [bytes([int(x[1:-1], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._encode_a, self._pieces = encoder(a_path, a_ranks, specials=False), pieces
        ids_a, ids_b = ([str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        #: An id as it stands within a group and at its group's end, A before B.
        self.written = [f"{i}," for i in ids_a] + [f"{i}|" for i in ids_a] + [f"{i}," for i in ids_b] + [f"{i};" for i in ids_b]
        self._apart = not any("▁" in x.lstrip("▁") for x in names)
        self._space = pieces.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        """For A and B: how many ids each known word has, and all these in a row."""
        self._number: dict[str, int] = {}
        self._chars, self._known = 0, [[np.array([], np.int64)] * 2] * 2

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A for a text that starts with a space, and of B, which puts that space there itself; None
        if one of them loses bytes."""
        a, b = self._encode_a(text), self._pieces.encode(text[1:]) if text != " " else [self._space]
        whole = text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None

    def words(self, text: str | None) -> list[str]:
        """Parts of a text behind a space that may be encoded apart, each with its space."""
        if not text:
            return []
        text = f" {text}"
        return WORD.split(text) if self._apart and not PLAIN.search(text) else [text]

    def encode_words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and B: how many ids each word has, and all these in a row; -1 for words that lose bytes.
        Words of plain signs go to the tokenizers many at a time, and token ends tell them apart."""
        found = self.encode("".join(words))
        if found:
            ids = [np.array(f, np.int64) for f in found]
            ends = [np.cumsum(t[i]) for t, i in zip((self.a_length, self.b_length), ids, strict=True)]
            stops = np.cumsum([len(w.encode()) for w in words])
            upto = [np.searchsorted(e, stops, "right") for e in ends]
            if len(words) == 1 or all((e[u - 1] == stops).all() for e, u in zip(ends, upto, strict=True)):
                return [np.diff(u, prepend=0) for u in upto], ids
        elif len(words) == 1:
            return [np.array([-1])] * 2, [np.array([], np.int64)] * 2
        apart = [self.encode_words([w]) for w in words]
        return tuple([np.concatenate([x[k][side] for x in apart]) for side in (0, 1)] for k in (0, 1))

    def encode_all(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """For A and for B: ids of the distinct words in a row, and how many each word has; then for each
        word of the texts that lose no bytes its number and its text. What a process encoded is known to
        its later blocks, until it is more than KNOWN characters; then all is forgotten."""
        words = [self.words(t) for t in texts]
        distinct = set(chain.from_iterable(words))
        fresh = [w for w in distinct if w not in self._number]
        self._chars += sum(map(len, fresh))
        if self._chars > KNOWN:
            self._forget()
            fresh, self._chars = list(distinct), sum(map(len, distinct))
        alone = {w[-1] for w in words if len(w) == 1 or w and w[-1][-1].isspace()}.difference(self._number)
        fresh = [*alone, *(w for w in fresh if w not in alone)]
        chars = np.fromiter(map(len, fresh), np.int64, len(fresh))
        chars[: len(alone)] = CALL
        starts = np.flatnonzero((np.diff(np.cumsum(chars) // CALL, prepend=-1) > 0) | (chars > CALL)) if self._apart else range(len(fresh))
        done = [self.encode_words(fresh[i:j]) for i, j in pairwise([*starts, len(fresh)])]
        self._number.update(zip(fresh, range(len(self._number), len(self._number) + len(fresh)), strict=True))
        self._known = [[np.concatenate([x, *(d[k][side] for d in done)]) for k, x in enumerate(old)] for side, old in enumerate(self._known)]
        counts = np.array([len(w) for w in words], np.int64)
        code = np.fromiter(map(self._number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(texts)), counts)
        whole = np.bincount(text[self._known[0][0][code] < 0], minlength=len(texts)) == 0
        code, text = code[whole[text]], text[whole[text]]
        here = np.bincount(code, minlength=len(self._number)) > 0
        sides = []
        for each, ids in self._known:
            each = np.maximum(each, 0)
            sides.append((ids[_ranges((np.cumsum(each) - each)[here], each[here])[1]], each[here]))
        return *sides, (np.cumsum(here) - 1)[code], text


def tokenizers_of(a_path: str, a_ranks: str | None, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, a_ranks, b_path)
    return _loaded[a_path, b_path]


def _ranges(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values of the ranges from ``first`` on."""
    which = np.repeat(np.arange(len(first)), length)
    return which, np.arange(len(which)) + np.repeat(first - np.cumsum(length) + length, length)


def common_end(a_end: np.ndarray, b_end: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval a0..a1 of A's tokens: the token, but the last, with the common end nearest to the
    middle of its bytes, or -1, and B's token that ends there. The stretch searched around the middle
    doubles until it holds one."""
    low = np.where(a0 > 0, a_end[a0 - 1], 0)
    middle = np.clip(np.searchsorted(a_end, (low + a_end[a1 - 1]) >> 1), a0, a1 - 2)
    found_a, found_b, waiting, reach = np.full(len(a0), -1), np.full(len(a0), -1), np.arange(len(a0)), 1
    while len(waiting):
        mid = middle[waiting]
        left, right = np.maximum(a0[waiting], mid - reach + 1), np.minimum(a1[waiting] - 1, mid + reach)
        which, token = _ranges(left, right - left)
        ends = a_end[token]
        other = np.searchsorted(b_end, ends)
        far = np.abs(token - mid[which]) * 2 + (token > mid[which])
        far[b_end[other] != ends] = np.iinfo(np.int64).max
        best = np.minimum.reduceat(far, np.cumsum(right - left) - (right - left))
        hit = best < np.iinfo(np.int64).max
        token = mid + np.where(best & 1, best >> 1, -(best >> 1))
        found_a[waiting[hit]] = token[hit]
        found_b[waiting[hit]] = np.searchsorted(b_end, a_end[token[hit]])
        waiting = waiting[~hit & ((left > a0[waiting]) | (right < a1[waiting] - 1))]
        reach *= 2
    return found_a, found_b


def groups_of(a_end: np.ndarray, b_end: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Rows (a0, a1, b0, b1) of the groups of each interval, in order. Both ends of an interval are common."""
    spans, leaves = np.stack([a0, a1, b0, b1]), []
    spans = spans[:, a1 > a0]
    while spans.shape[1]:
        a0, a1, b0, b1 = spans
        one = (a1 - a0 == 1) | (b1 - b0 == 1)
        leaves.append(spans[:, one])
        a0, a1, b0, b1 = spans = spans[:, ~one]
        a, b = common_end(a_end, b_end, a0, a1)
        none = a < 0
        leaves.append(spans[:, none])
        a0, a1, b0, b1, a, b = (x[~none] for x in (a0, a1, b0, b1, a + 1, b + 1))
        spans = np.stack([np.stack([a0, a, b0, b]), np.stack([a, a1, b, b1])], axis=2).reshape(4, -1)  # in order
    found = np.concatenate(leaves, axis=1) if leaves else spans
    return found[:, np.argsort(found[0], kind="stable")]


def linked(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links): pairs of ids within groups, and of how many occurrences; a pair may come in
    several rows of a small group."""
    a0, a1, b0, b1 = groups
    large = (a1 - a0) * (b1 - b0) > SMALL
    found = []
    for chosen, reduced in ((~large, False), (large, True)):
        which = np.flatnonzero(chosen)
        sides = []
        for ids, first, last in ((a_ids, a0, a1), (b_ids, b0, b1)):
            of, at = _ranges(first[which], last[which] - first[which])
            token, n = ids[at], np.ones(len(at), np.int64)
            if reduced:
                kinds, n = np.unique((of << B_BITS) + token, return_counts=True)
                of, token = kinds >> B_BITS, kinds & ((1 << B_BITS) - 1)
            sides.append((of, token, n, np.bincount(of, minlength=len(which))))
        (of, a, n_a, _), (_, b, n_b, b_count) = sides
        b_first = np.cumsum(b_count) - b_count
        row, other = _ranges(b_first[of], b_count[of])
        found.append((which[of[row]], (a[row] << B_BITS) + b[other], n_a[row] * n_b[other]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def written(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, words: list[str], n_a_ids: int, n_b_ids: int) -> list[str]:
    """The tokens' texts in the order of their groups, A before B, as `a1,a2|b1;`."""
    a0, a1, b0, b1 = groups
    a_code, b_code = a_ids.copy(), b_ids + 2 * n_a_ids
    a_code[a1 - 1] += n_a_ids
    b_code[b1 - 1] += n_b_ids
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + np.repeat(b0, a1 - a0)] = a_code
    codes[np.arange(len(b_ids)) + np.repeat(a1, b1 - b0)] = b_code
    return list(map(words.__getitem__, codes.tolist()))


def align_block(tools: Tokenizers, texts: list[str | None]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """A row for each text, and the block's distinct pairs with the number of texts that hold each. Words
    end at common ends, so each distinct word is divided once and texts add up what their words have."""
    (a_ids, n_a), (b_ids, n_b), code, doc = tools.encode_all(texts)
    a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
    groups = groups_of(np.cumsum(tools.a_length[a_ids]), np.cumsum(tools.b_length[b_ids]), a_stop - n_a, a_stop, b_stop - n_b, b_stop)
    word = np.searchsorted(a_stop, groups[0], "right")
    group, pair, links = linked(groups, a_ids, b_ids)
    order = np.argsort(word[group], kind="stable")
    local, pairs = pd.factorize(pair[order])
    n_pairs = np.bincount(word[group[order]], minlength=len(n_a))
    of, at = _ranges((np.cumsum(n_pairs) - n_pairs)[code], n_pairs[code])
    of, kinds = pd.factorize(doc[of] * max(len(pairs), 1) + local[at])
    weight = np.zeros(len(kinds), np.int64)
    np.add.at(weight, of, links[order][at])
    holder, local = np.divmod(kinds, max(len(pairs), 1))  # texts in order
    tokens, token_ends = written(groups, a_ids, b_ids, tools.written, len(tools.a_bytes), len(tools.b_bytes)), (a_stop + b_stop).tolist()
    said = ["".join(tokens[i:j]) for i, j in pairwise([0, *token_ends])]
    word_links = np.zeros(len(n_a), np.int64)
    np.add.at(word_links, word, (groups[1] - groups[0]) * (groups[3] - groups[2]))
    sums = []
    for each in (n_a, n_b, np.bincount(word, minlength=len(n_a)), word_links):
        sums.append(np.zeros(len(texts), np.int64))
        np.add.at(sums[-1], doc, each[code])
    sums = [x.tolist() for x in sums]
    codes, places = code.tolist(), np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    ends = np.searchsorted(holder, np.arange(len(texts) + 1)).tolist()
    rows = []
    for i, counts in enumerate(zip(*sums, strict=True)):
        some = slice(ends[i], ends[i + 1])
        kind = "<u1" if not len(weight[some]) or weight[some].max() < 256 else "<i8"
        rows.append({
            **dict(zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)), "groups": "".join(map(said.__getitem__, codes[places[i] : places[i + 1]]))[:-1],
            "local": local[some].astype("<u4").tobytes(), "weight": weight[some].astype(kind).tobytes(),
        })
    return rows, pairs, np.bincount(local, minlength=len(pairs))


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    first, chars = 0, 0
    for i, text in enumerate(texts):
        if i > first and chars + len(text or "") > BLOCK:
            yield slice(first, i)
            first, chars = i, 0
        chars += len(text or "")
    yield slice(first, len(texts))


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups string"


def aligned(docs: DataFrame, a_path: str, a_ranks: str | None, b_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """A row for each document, and one for each block with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, block = tokenizers_of(a_path, a_ranks, b_path), TaskContext.get().partitionId() << B_BITS
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for some in _blocks(texts) if texts else ():
                rows, pairs, holders = align_block(tools, texts[some])
                if digest:
                    for r in rows:
                        r["groups"] = hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else ""
                rows.append({"pairs": pairs.tolist(), "holders": holders.tolist()})
                out = pa.Table.from_pylist(rows, schema=kind)
                of = ids.slice(some.start, some.stop - some.start)
                yield from out.add_column(0, "doc_id", pa.concat_arrays([of, pa.nulls(1, of.type)])).add_column(1, "block", pa.array(np.full(len(rows), block))).combine_chunks().to_batches()
                block += 1

    kind = pa.schema([*((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("local", pa.binary()), ("weight", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema[0].dataType.simpleString()}, block long, {FOUND}, local binary, weight binary, pairs array<long>, holders array<long>")


def counted(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether that is its A id's highest. A
    window holds one A id's partners, as many as B's vocabulary at most."""
    counts = pairs.groupBy("pair").agg(F.sum("holders").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", B_BITS))))


def align(docs: DataFrame, a_path: str, a_ranks: str | None, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row: (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum).

    ``groups`` is `a1,a2|b1;a3|b2,b3`, or with ``digest`` its SHA-256 in hex. ``n_best`` counts links
    whose pair is its A id's most frequent one, ties included; ``count_sum`` adds up the links' counts,
    which are documents that hold the pair. Null and empty texts, and those whose bytes a tokenizer
    doesn't give back, have no tokens: zeros and ''. Repeated rows count each. Other columns are not
    carried, so their names don't matter. An empty table gives no rows.
    """
    rows = store(aligned(docs, a_path, a_ranks, b_path, id_col, text_col, digest), "aligned")
    pairs = rows.where("pairs is not null").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "x")).select("of", "at", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
    counts = store(counted(pairs), "counts")
    back = pairs.join(counts, "pair").select("of", "at", "count", "best")

    def score(found: pa.Table, known: pa.Table) -> pa.Table:
        at = np.asarray(known["at"])
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at], best[at] = np.asarray(known["count"]), np.asarray(known["best"])
        n_best, count_sum = [], []
        for local, weight in zip(found["local"].to_pylist(), found["weight"].to_pylist(), strict=True):
            local = np.frombuffer(local, "<u4")
            weight = np.frombuffer(weight, "<u1" if len(weight) == len(local) else "<i8").astype(np.int64)
            n_best.append(int(weight[best[local]].sum()))
            count_sum.append(int((weight * count[local]).sum()))
        return found.drop_columns(["block", "local", "weight"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    documents = rows.where("pairs is null").drop("pairs", "holders")
    scored = documents.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(score, f"doc_id {rows.schema[0].dataType.simpleString()}, {FOUND}, n_best long, count_sum long")
    return scored
