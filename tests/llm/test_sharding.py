import zlib

import numpy as np
from pyspark.sql import functions as F

from daydigest.llm import common, sharding

SCHEMA = "doc_id long, text string, source string, shard string, slot int, _copies int"


def plain_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_follows_the_published_algorithm():
    keys = [0, 1, 2**63, 2**64 - 1, *range(10, 3000, 7)]
    for shards in (1, 2, 7, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.shard_table(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 16 for r in moved)
    assert 150 < len(moved) < 330
    sizes = np.bincount([r["shard"] for r in rows], minlength=16)
    assert sizes.min() > 180


def test_slots_are_gapless_with_nulls_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 7)
    monkeypatch.setattr(common, "COPY_BLOCK", 5)
    rows = [(None, None, None, "s", 1, 2), (None, None, None, "s", 1, 2), (3, "", "a", None, 0, 0)]
    rows += [(7, "é" * 50_000, "a", "z", 9, 9)] * 40 + [(i, f"text {i}", "b", "z", 9, 9) for i in range(100, 160)]
    out = sharding.shard_table(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in out:
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["law"] == "key"
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 1


def test_empty_table_and_written_shards(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_table(empty).count() == 0
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r["shard"] for r in back.collect()} <= set(range(4))
    named = sharding.with_shard(spark.createDataFrame([(1, "t", "s", "old", 1, 1)], SCHEMA))
    assert dict(named.dtypes)["shard"] == "int" and len(named.columns) == 6
