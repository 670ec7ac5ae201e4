"""Tables a record a line, tables that are published whole, dictionaries without a hot key, and groups of near
duplicates."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from daydigest.operators import dedup, evaluate
from daydigest.sinks import writers
from daydigest.sources import results


def test_records_on_one_line_keep_any_text_and_are_split(spark, tmp_path):
    hard = ["a\nb", "\r\n", "\\n", "\\\\n\\", 'say "x", \\"y\\"', " outer ", "\\\n", "\\0", "é z", ""]
    rows = [(i, hard[i % len(hard)] + "x" * (i % 7), ["p\nq"]) for i in range(5000)]
    frame = spark.createDataFrame(rows, "id int, text string, docs array<string>").coalesce(1)
    path = writers.write_csv(frame, str(tmp_path / "t"), one_line=True)
    schema = "id int, text string, docs string"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        back = results.read_csv_table(spark, path, schema, one_line=True)
        assert back.rdd.getNumPartitions() > 3
        got = back.select("id", F.coalesce("text", F.lit("")), F.from_json("docs", "array<string>")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got)) == rows


def test_a_table_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "tables" / "t")
    failing = spark.range(1000).repartition(4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.insert_if_absent(failing, path)
    assert not writers.exists(spark, path)
    frames = [spark.range(n * 1000).withColumn("of", F.lit(n)) for n in range(1, 6)]
    threads = [threading.Thread(target=writers.insert_if_absent, args=(f, path)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = spark.read.parquet(path)
    winner = rows.select("of").distinct().collect()
    assert len(winner) == 1 and rows.count() == winner[0]["of"] * 1000
    assert [p.name for p in (tmp_path / "tables").iterdir() if p.is_dir()] == ["t"]
    assert writers.renamed_if_absent(spark, writers.write_csv(spark.range(1), str(tmp_path / "u")), path) is False


def test_a_large_dictionary_meets_pairs_on_many_keys(spark, monkeypatch):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(["the", "the", "fires", "fire", "burning", "hills"]) for _ in range(n))
    ours = spark.createDataFrame([(f"r{i}", "e", text(60)) for i in range(5)], "run_id string, event_id string, text string")
    theirs = spark.createDataFrame([("e", text(80))], "event_id string, text string")
    want = sorted(map(tuple, evaluate.rouge2(ours, theirs).collect()))
    monkeypatch.setattr(evaluate, "WORD_BYTES", 1 << 40)
    assert sorted(map(tuple, evaluate.rouge2(ours, theirs).collect())) == want


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def least_roots(nodes, links):
    parent = {n: n for n in nodes}
    for x, y in links:
        a, b = sorted((root_of(parent, x), root_of(parent, y)))
        parent[b] = a
    return {n: root_of(parent, n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_connected_documents(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1000), 60)
    links = [(a, b) for a, b in zip(names[:25], names[1:26])] + [(rng.choice(names[26:]), rng.choice(names[26:])) for _ in range(18)]
    links += [(2, 4), (4, 3), (3, 5), (5, 1), (7001, 7001)]
    got = {r["doc_id"]: r["group_id"] for r in dedup.connected(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == least_roots({n for link in links for n in link}, links)


def test_near_duplicates_are_verified_and_nearly_all_found(spark):
    rng = random.Random(6)
    texts, family = [], {}
    for g in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for k in range(rng.choice([1, 2, 5])):
            one = list(base)
            for _ in range(rng.randrange(4) if k else 0):
                one[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
            family[len(texts)] = g
            texts.append((len(texts), " ".join(one)))
    n = len(texts)
    # a page of a template shares half of its words only: buckets may offer it, the check refuses it
    base = [f"t{rng.randrange(10**6)}" for _ in range(50)]
    texts += [(n + i, " ".join(base + [f"u{rng.randrange(10**6)}" for _ in range(50)])) for i in range(20)]
    texts += [(9000 + i, "same text") for i in range(300)] + [(9999, None), (9998, ""), (None, "same text"), (9000, "same text")]
    runs = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts[: n + 20]}
    near = [(i, j) for j in runs for i in runs if i < j and 4 * len(runs[i] & runs[j]) >= 3 * len(runs[i] | runs[j])]
    got = {r["doc_id"]: (r["group_id"], r["size"]) for r in dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, t in texts if i is not None and t}
    assert {got[9000 + i] for i in range(300)} == {(9000, 300)}
    want = least_roots(list(runs), near)
    # nothing is joined that links do not join, and nine of ten links are kept at least
    assert all(want[i] == want[got[i][0]] for i in runs)
    assert sum(got[i][0] == got[j][0] for i, j in near) >= 0.9 * len(near) > 50
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
