"""Staged tables, orders of results, and profiles of odd columns."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from daydigest.operators import dedup, digest, profile, publish
from daydigest.session import cut_lineage, dealt_out, release, staging, work_path
from daydigest.sinks.writers import exists, write_csv


def test_staged_tables_are_released(spark):
    release(spark)
    kept = cut_lineage(spark.range(3), "kept")
    with staging(spark):
        inner = cut_lineage(spark.range(5), "inner")
        path = inner.inputFiles()[0]
        assert inner.count() == 5
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3
    assert release(spark) == 1 and release(spark) == 0


def test_sorted_results_are_sorted(spark):
    rows = [("2020-01-02", "b", 1.0), ("2020-01-01", "a", None), ("2020-01-01", "c", 2.0), ("2020-01-01", "b", 2.0)]
    df = spark.createDataFrame(rows, "date string, docno string, importance double").repartition(4)
    assert [r.docno for r in digest.by_date_and(df, "importance", "docno").collect()] == ["b", "c", "a", "b"]
    assert [(r.importance, r.docno) for r in digest.by_importance(df).collect()] == [
        (2.0, "b"), (2.0, "c"), (1.0, "b"), (None, "a"),
    ]
    requests = publish.unique_requests(df.select(F.col("docno").alias("request")))
    assert [r.request for r in requests.collect()] == ["a", "b", "c"]


def test_a_published_table_is_not_read_again(spark, monkeypatch):
    folder, target = work_path(spark, "folder"), work_path(spark, "target")
    write_csv(spark.range(4).select(F.col("id").alias("n")), f"{folder}/other.csv")
    first = publish.publish_folder(spark, folder, target, {"other": "n long"})
    assert exists(spark, first["other"]) and spark.read.parquet(first["other"]).count() == 4
    monkeypatch.setattr(publish, "read_csv_table", lambda *a: pytest.fail("read"))
    assert publish.publish_folder(spark, folder, target) == first


def test_profiles_count_nan_and_null_columns_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, None, 1), (nan, None, 2), (3.0, None, None), (2.0, None, 4)], "a double, b double, c int")
    assert {r.column_name: r.n_null for r in profile.null_counts(df).collect()} == {"a": 1, "b": 4, "c": 1}
    got = {(r.column_name, r.stat): r.value for r in profile.describe(df).collect()}
    assert got["a", "count"] == 3 and got["a", "50%"] == 2.0 and got["a", "max"] == 3.0
    assert got["b", "count"] == 0 and got["b", "25%"] is None and len(got) == 24


def exact_quartiles(values):
    values = sorted(values)
    out = {}
    for name, q in profile.QUARTILES.items():
        at = q * (len(values) - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        out[name] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out


@pytest.mark.parametrize(("margin", "accuracy", "most"), [(0.001, 10_000, 200_000), (0.2, 50, 40), (0.0001, 5, 30), (0.6, 100, 3)])
def test_quartiles_by_windows_that_miss_are_large_or_tied(spark, monkeypatch, margin, accuracy, most):
    for name, value in (("MARGIN", margin), ("ACCURACY", accuracy), ("WINDOW_VALUES", most), ("PARTS", 7)):
        monkeypatch.setattr(profile, name, value)
    rng = random.Random(5)
    columns = {
        "spread": [float(i * 7919 % 5003) for i in range(3000)],
        "tied": [float(rng.choice([1, 1, 1, 2, 3, 3, 9])) for _ in range(3000)],
        "long tail": [rng.paretovariate(0.3) for _ in range(2999)] + [math.inf],
        "two": [0.0] * 1500 + [1.0] * 1500,
        "some": [rng.gauss(0, 1) if i % 3 else None for i in range(3000)],
    }
    frame = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` double" for c in columns))
    got = {(r.column_name, r.stat): r.value for r in profile.describe(frame.repartition(7)).collect()}
    for c, values in columns.items():
        want = exact_quartiles([v for v in values if v is not None])
        assert {k: got[c, k] for k in want} == pytest.approx(want, rel=1e-12), c


def test_signatures_of_equal_and_empty_texts(spark):
    texts = [(1, "One two three four five six"), (2, "one  TWO three, four five six"), (3, ""), (4, None), (5, "one two")]
    signed = dedup.with_signature(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r for r in signed.collect()}
    assert got[1].signature == got[2].signature and got[1].n_shingles == 2 and got[5].n_shingles == 1
    assert got[3].signature is None and got[4].n_shingles == 0
    buckets = dedup.band_buckets(signed).collect()
    assert {(r.doc_id, r.size) for r in buckets} == {(1, 2), (2, 2), (5, 1)} and len(buckets) == 3 * dedup.BANDS


def test_near_duplicates_at_the_threshold_share_a_bucket(spark):
    rng = random.Random(4)
    texts = []
    for i in range(150):
        one = [f"w{rng.randrange(10**6)}" for _ in range(124)]
        other = list(one)
        for at in (20, 60, 100):
            other[at + rng.randrange(10)] = f"v{rng.randrange(10**6)}"
        texts += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    runs = [{tuple(t.split()[k : k + 5]) for k in range(120)} for _, t in texts]
    near = {(i, j) for j in range(300) for i in range(j) if 0.75 <= len(runs[i] & runs[j]) / len(runs[i] | runs[j]) <= 0.8}
    assert len(near) == 150
    members = {}
    for r in dedup.band_buckets(dedup.with_signature(spark.createDataFrame(texts, "doc_id long, text string"))).collect():
        members.setdefault((r.band, r.bucket), set()).add(r.doc_id)
    met = {(i, j) for i, j in near if any(i in m and j in m for m in members.values())}
    assert len(met) >= 0.97 * len(near), len(met)


def test_tables_of_few_parts_are_dealt_out(spark, tmp_path):
    spark.range(1000).withColumn("text", F.lit("a b")).coalesce(1).write.parquet(f"{tmp_path}/few")
    few = dealt_out(spark.read.parquet(f"{tmp_path}/few"))
    cores = spark.sparkContext.defaultParallelism
    assert few.select(F.spark_partition_id().alias("p")).distinct().count() == cores
    assert few.count() == few.select("id").distinct().count() == 1000
    # one column is read where one is wanted
    plan = few.select("id").filter("id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,5)" in plan
    many = spark.range(1000).repartition(3 * cores)
    many.write.parquet(f"{tmp_path}/many")
    assert dealt_out(many) is many
