import math
import random

from pyspark.sql import functions as F

from daydigest.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, copies int, block string"


def brute(rows, k, modulus):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, q) in enumerate(good):
        if i % modulus == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def search(spark, rows, k=5, modulus=10):
    table = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.search(table, F.col("vec_id") % modulus == 0, k).collect())


def test_matches_brute_force_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 40)
    rng = random.Random(0)
    # few values, so that there are many ties
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.2)]) for _ in range(8)]) for i in range(1000)]
    assert search(spark, rows) == brute(rows, 5, 10)


def test_blocks_stop_early_on_proof():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    values = np.floor(256 * rng.normal(0, 0.2, (3000, 16))).astype(np.int64)
    rows = pd.DataFrame({"vec_id": np.arange(3000), "vector": list(values), "tag": np.arange(3000), "copies": 1})
    found = topk.search_block(topk.build_block((16, 0), rows), rows.iloc[:50], 5)
    for i, part in found.groupby("query_id"):
        scores = values @ values[i]
        order = sorted((-s, j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted((-s, j) for j, s in zip(part["vec_id"], part["score"])) == order


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 0.0]), (10, None), (20, [None, 1.0]), (30, [nan, 1.0]), (40, [inf, 0.0])]
    rows += [(None, [1.0, 1.0]), (50, []), (51, []), (60, [1.0]), (1, [3e4, -3e4]), (2, [0.0, 0.0]), (3, [-0.001, 0.001])]
    assert search(spark, rows) == brute(rows, 5, 10)
    copies = [(7, [0.1, 0.2])] * 12 + [(8, [0.1, 0.1]), (10, [1.0, 1.0])]
    assert search(spark, copies) == brute(copies, 5, 10)
    assert search(spark, [(10, [1e30, 1.0]), (11, [1e30, 1.0])])[0][:3] == (10, 1, 11)
    assert search(spark, []) == []
