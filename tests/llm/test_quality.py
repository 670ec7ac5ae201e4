import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daydigest.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, log_ratio int, selected int, target int"


def text(seed, good):
    rng = random.Random(seed)
    pool = [f"g{i}" for i in range(40)] if good else [f"b{i}" for i in range(40)]
    return " ".join(rng.choice(pool if rng.random() < 0.7 else ["x", "y", "z"]) for _ in range(30))


def documents(n=300):
    return [(i, text(i, i % 3 == 0), "en", 1, 1, 1) for i in range(n)]


def test_good_texts_have_the_higher_ratio_and_the_sample_has_its_size(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    good = spark.range(0, 150, 3).select(F.col("id").alias("doc_id"))
    out = Q.resample(docs, good, fraction=0.1).collect()
    assert len(out) == 300 and sum(r["selected"] for r in out) == 30
    ratio = {r["doc_id"]: r["log_ratio"] for r in out}
    assert min(ratio[i] for i in range(300) if i % 3 == 0) > max(ratio[i] for i in range(300) if i % 3)
    assert all(r["doc_id"] % 3 == 0 for r in out if r["selected"])
    chosen = sorted(out, key=lambda r: -r["gumbel_key"])[:30]
    assert {r["doc_id"] for r in chosen} == {r["doc_id"] for r in out if r["selected"]}


def test_ratios_are_those_of_counted_buckets(spark):
    docs = [(1, "A b a", "x", 1, 1, 1), (2, "b c", "x", 1, 1, 1), (3, None, "x", 1, 1, 1)]
    ratios = Q.log_ratios(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1,)], "doc_id long"))
    every, target = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    for i, t, *_ in docs:
        flat = np.frombuffer((t or "").encode(), np.uint8)
        _, bucket = Q.buckets(flat, np.array([0, len(flat)]))
        for b in bucket:
            every[b] += 1
            target[b] += i == 1
    assert every.sum() == Q.BUCKETS + 8
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(every / every.sum()))


@pytest.mark.parametrize("k", [1, 7, 4999, 5000, 9000])
def test_cut_of_the_highest_k(spark, k):
    values = spark.range(9000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("v"))
    sorted_values = sorted((r["v"] for r in values.collect()), reverse=True)
    cut, above = Q.top_cut(values, "v", k)
    assert cut == sorted_values[k - 1] and above == sum(v > cut for v in sorted_values)


def test_hard_rows(spark):
    rows = documents(30) + [(None, None, None, None, None, None), (100, "", "x", 1, 1, 1), (101, "?!", "x", 1, 1, 1)]
    rows += [(102, text(0, True), "x", 1, 1, 1)] * 40 + [(103, "g1 " * 50_000, "x", 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    good = spark.createDataFrame([(0,), (3,), (None,), (0,), (999,)], "doc_id long")
    out = Q.resample(docs, good, fraction=0.25)
    assert out.columns == ["doc_id", "log_ratio", "n_grams", "gumbel_key", "selected"]
    got = out.collect()
    assert len(got) == len(rows) and sum(r["selected"] for r in got) == -(-len(rows) // 4)
    assert all(r["log_ratio"] == 0 for r in got if r["doc_id"] in (None, 100, 101))
    assert Q.resample(docs.limit(0), good).count() == 0
    assert Q.resample(docs, good.limit(0)).filter("log_ratio <> 0").count() == 0
