"""Round 5: work of op5 on vectors that are all about equally far apart, and on large groups of near copies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from chatframe.llm import cover_tree

WORK = cover_tree._Pairs(math.sqrt(0.2), 0.9, False)


def vectors(x, copies=None):
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    return pa.table({"cls": np.arange(len(x)), "copies": np.ones(len(x), np.int64) if copies is None else copies, "embedding": flat})


def near_copies(rng, n, spread):
    centre = rng.normal(size=64)
    return centre / np.linalg.norm(centre) + rng.normal(size=(n, 64)) * spread / 8


@pytest.fixture
def alone(monkeypatch):
    """Numbers of rows that were multiplied one by one."""
    rows, plain = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: rows.append(len(a)) or plain(how, a, b))
    return rows


def test_vectors_equally_far_apart_meet_in_products(alone):
    """A level whose nodes can't be told apart isn't built: all but the pairs in reach fall to products."""
    x = np.random.default_rng(1).normal(size=(4000, 40))
    WORK.within(vectors(x))
    assert sum(alone) < 20 * len(x)


def test_near_copies_are_counted_as_nodes(alone):
    x = np.concatenate([near_copies(np.random.default_rng(2), 3000, 0.075), np.random.default_rng(3).normal(size=(500, 64))])
    got = WORK.within(vectors(x))
    assert got["links"].to_pylist() == [2999] * 3000 and set(got["low"].to_pylist()) == {0}
    assert sum(alone) < 20 * len(x)


@pytest.mark.parametrize("probe", [cover_tree.PROBE, 1 << 30])
@pytest.mark.parametrize("shape", ["blobs", "three", "six", "near", "mixed"])
def test_links_against_all_products(shape, probe, monkeypatch):
    """Links and components of one block and of two, with levels where they pay and with all of them."""
    monkeypatch.setattr(cover_tree, "PROBE", probe)
    rng = np.random.default_rng(4)
    x = {
        "blobs": lambda: np.repeat(np.eye(12)[:8], 150, 0) + rng.normal(size=(1200, 12)) * np.repeat([0.05, 0.1, 0.2, 0.3] * 2, 150)[:, None],
        "three": lambda: rng.normal(size=(1200, 3)),
        "six": lambda: rng.normal(size=(1200, 6)),
        "near": lambda: near_copies(rng, 1200, 0.45),
        "mixed": lambda: np.concatenate([near_copies(rng, 400, 0.1), near_copies(rng, 200, 0.3), rng.normal(size=(600, 64))]),
    }[shape]()
    copies = rng.integers(1, 4, len(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    links, root = near @ copies, cover_tree.forest(len(x), [np.nonzero(near)])
    whole = vectors(x, copies)
    got = WORK.within(whole)
    assert dict(zip(got["cls"].to_pylist(), zip(got["links"].to_pylist(), got["low"].to_pylist(), strict=True), strict=True)) == {k: (links[k], root[k]) for k in np.flatnonzero(links).tolist()}

    side = rng.random(len(x)) < 0.4
    counted, joined = np.zeros(len(x), np.int64), []
    for i, j in ((0, 0), (1, 1), (0, 1)):
        blocks = []
        for b in sorted({i, j}):
            rows = np.flatnonzero(side == b)
            nodes = cover_tree.nested_nets(u[rows], WORK.reach).T.astype(np.int32)
            block = whole.take(pa.array(rows)).append_column("block", pa.array(np.full(len(rows), b, np.int32))).append_column("place", pa.array(np.arange(len(rows), dtype=np.int32)))
            blocks.append(block.append_column("nodes", pa.array(list(nodes), pa.list_(pa.int32()))))
        group = pa.concat_tables(blocks)
        group = group.append_column("i", pa.array(np.full(group.num_rows, i, np.int32))).append_column("j", pa.array(np.full(group.num_rows, j, np.int32)))
        got = WORK.between(group.take(pa.array(rng.permutation(group.num_rows))))
        np.add.at(counted, got["cls"].to_numpy(), got["links"].to_numpy())
        joined.append((got["cls"].to_numpy(), got["low"].to_numpy()))
    assert (counted == links).all() and (cover_tree.forest(len(x), joined) == root).all()
    pairs = cover_tree._Pairs(WORK.reach, 0.9, True).within(whole)
    assert sorted(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)) == list(map(tuple, np.argwhere(np.triu(near)).tolist()))


def test_floats_travel_as_floats(spark):
    """Vectors keep the width they come with, and link alike."""
    x = near_copies(np.random.default_rng(5), 60, 0.45).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = [cover_tree.link_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), block=20).orderBy("vec_id").collect() for kind in ("float", "double")]
    assert found[0] == found[1] and any(r.n_links for r in found[0])
