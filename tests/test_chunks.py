"""Walks over chunks give what one walk over the whole conversation gives."""

import random

import numpy as np
import pyarrow as pa

from chatframe.operators import chunks
from chatframe.operators.segment import FLAGS, Walk, primary_intervals, primary_lines
from chatframe.plans import queries
from chatframe.plans.pipeline import parse_chunked, parse_primary


def composed(flags, users, cuts):
    """Intervals of a conversation whose lines are cut at ``cuts``."""
    n, rows = len(users), []
    for k, (first, end) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
        stop = min(n, end + chunks.AHEAD)
        while stop < n and flags["is_empty"][stop - 1]:
            stop += 1
        seen = range(max(0, first - chunks.NEAR), stop)
        key = {"conv": 1, "chunk": k, "first": first, "lead": 0, "n": end - first, "ahead": stop - end, "total": n}
        table = pa.table({"conv_id": [key] * len(seen), "line_no": list(seen), "author": [users[i] for i in seen], **{c: [bool(flags[c][i]) for i in seen] for c in FLAGS}})
        rows += chunks._summarise(table).to_pylist()
    return chunks.compose(rows)


def test_composed_walks_equal_one_walk():
    rng = random.Random(11)
    joined = 0
    for case in range(300):
        n = rng.randint(1, 60)
        often = {c: rng.choice([0.05, 0.2, 0.5]) for c in FLAGS}
        flags = {c: np.array([rng.random() < often[c] for _ in range(n)]) for c in FLAGS}
        for c in FLAGS:  # as features have it: an empty line is nothing else, and a candidate is a start
            if c != "is_empty":
                flags[c] &= ~flags["is_empty"]
        flags["is_candidate"] &= flags["is_start"] & ~flags["is_cont"]
        users = [rng.choice([None, "Ann", "Bo"]) for _ in range(n)]
        whole = Walk(flags, users).intervals()
        joined += any(b[0] <= a[1] for a, b in zip(whole, whole[1:], strict=False))
        for _ in range(3):
            cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(n - 1, 8))))
            assert composed(flags, users, cuts) == whole, (case, cuts)
    assert joined > 20  # intervals that overlap are among them


def test_lines_of_chunks_equal_lines_of_conversations(spark, sf_dir):
    """Features of lines by chunks, with sections, blank runs and headers over three lines at the seams."""
    rng = random.Random(5)
    some = ["Ann Lee", "Bo Day  3:04 PM", "  3:05 PM", "", "", "so it goes, they said.", "#GENERAL#", "[3:09](https://x.example/archives/C1/p9)", "3 replies", ":tada: 2", "See more", "Team Lead  3:01 PM", " (https://x.slack.com/services/B1)Hub", "Hub", "APP  Feb 6th at 3:04 PM", "![](https://ca.slack-edge.com/a.png)", "x" * 70]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(1, 90)))) for i in range(40)] + [(90, ""), (91, None), (92, "\n" * 40 + "#GENERAL#\nAnn Lee  3:04 PM\nhello")]
    frame = spark.createDataFrame(rows, "conv_id long, raw string")
    whole = primary_lines(frame)
    for size in (60, 400):
        found = chunks.chunked_features(frame, size)
        columns = [c for c in whole.columns if c not in ("conv_id", "line_no", "prev_line", "next_line")]
        key = lambda df: {(r.conv_id, r.line_no): tuple(r[c] for c in columns) for r in df.select("conv_id", "line_no", *columns).collect()}
        assert key(chunks.own_lines(found)) == key(whole)
        assert sorted(chunks.chunked_intervals(found).collect()) == sorted(primary_intervals(whole).collect())


def test_chunked_parse_equals_the_parse(spark, sf_dir):
    assert chunks.chunked(queries.transcripts(queries.turns(spark, sf_dir)), 4096).select("conv_id.conv").distinct().count() == queries.turns(spark, sf_dir).select("conv_id").distinct().count()
    raw = queries.transcripts(queries.turns(spark, sf_dir)).where("conv_id % 5 = 0")
    columns = ["conv_id", "msg_idx", "username", "ts_text", "text", "start_line", "end_line"]
    assert sorted(parse_chunked(raw, size=300).select(*columns).collect(), key=str) == sorted(parse_primary(raw).select(*columns).collect(), key=str)


def test_long_lines_and_many_blank_lines(spark):
    frame = spark.createDataFrame([(1, "Ann Lee  3:04 PM\n" + "y" * 9000 + "\n" * 500 + "Bo Day  3:05 PM\nhello there, all")], "conv_id long, raw string")
    found = chunks.chunked(frame, 1000).select("conv_id.*").orderBy("chunk").collect()
    assert [r.first for r in found][:3] == [0, 1, 2] and sum(r.n for r in found) == 503
    assert sorted(chunks.chunked_intervals(chunks.chunked_features(frame, 1000)).collect()) == sorted(primary_intervals(primary_lines(frame)).collect())
