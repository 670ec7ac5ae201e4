import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from daydigest.llm import line_dedup
from daydigest.llm.line_dedup import LineIndex, build_shard

SCHEMA = "doc_id long, text string, place string, n_dropped string, hits int"


def brute(rows, least, least_chars=1):
    def key(line):
        line = line.strip(" \t\n\v\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    split = [(t or "").split("\n") for _, t in rows]
    held = Counter(k for lines in split for k in {key(x) for x in lines})
    out = []
    for (i, _), lines in zip(rows, split):
        kept = [x for x in lines if len(key(x)) < least_chars or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def dedup(spark, rows, **how):
    table = spark.createDataFrame([(i, t, "p", "own", 1) for i, t in rows], SCHEMA)
    done = line_dedup.without_repeated_lines(table, **how)
    assert done.columns == ["doc_id", "text", "place", "hits", "kept_text", "n_lines", "n_dropped"]
    found = done.collect()
    assert all(r["place"] == "p" and r["hits"] == 1 for r in found)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(rows, key=str)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found), key=str)


HARD = [
    (1, None), (2, ""), (None, "a\nb"), (None, "a\nb"), (3, "A \n\n\n b\t"), (3, "  a\r\nÉ\n"), (4, "\n"), (5, "é\nb"),
    (6, "a\na\na"), (7, "É\nc"), (8, "\x1fa\nk"), (8, "K\n a"), (9, "x" * 300_000 + "\nK\nk"), (9, "İ\nK"),
]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_lines_of_enough_documents_go(spark, limit):
    for least in (2, 3, 100):
        assert dedup(spark, HARD, least=least, limit=limit) == brute(HARD, least)
    assert dedup(spark, HARD, least=2, least_chars=2, limit=limit) == brute(HARD, 2, 2)
    assert dedup(spark, [], least=2, limit=limit) == []


@pytest.mark.parametrize("limit", [1 << 24, 0, 2000])
def test_many_lines_over_several_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 10)
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 50)
    rng = random.Random(0)
    rows = [(i, "\n".join(["hot"] + [f"Line {int(rng.paretovariate(0.4))}" for _ in range(rng.randrange(30))])) for i in range(300)]
    rows += rows[:50]
    assert dedup(spark, rows, least=3, limit=limit) == brute(rows, 3)


def test_query_columns(spark):
    rows = [(1, "a\nb"), (2, "a\nc")]
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(i, 2, 1, hashlib.sha256(t).hexdigest()) for i, t in ((1, b"b"), (2, b"c"))]


def test_the_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 64, (40_000, 2), np.uint64)
    h[:100, 0] = h[100:200, 0]  # the same first half
    shards = []
    for shard in range(4):
        mine = np.flatnonzero(h[:, 0] >> np.uint64(62) == shard)
        rows = pd.DataFrame({"place": h[mine, 0].view(np.int64), "print": h[mine, 1].view(np.int64), "n": mine + 1})
        shards += build_shard((shard,), rows).to_dict("records")
    index = LineIndex(shards[::-1], 2)
    # a place for each key and no other; four bits a key beside print and count
    assert len(index.prints) == len(index.counts) == index.rank[-1] == len(h)
    assert len(index.words) * 64 < 4 * len(h)
    assert (index.documents(h) == np.arange(len(h)) + 1).all()
    strangers = rng.integers(0, 1 << 64, (100_000, 2), np.uint64)
    strangers[:50_000, 0] = h[rng.integers(0, len(h), 50_000), 0]
    assert not index.documents(strangers).any()
