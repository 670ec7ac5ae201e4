"""The pipeline, stage by stage against plain Python on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daydigest.llm import ngram_jaccard, queries
from daydigest.session import cut_lineage
from tests.llm.test_decontamination import words as item_words
from tests.llm.test_ngram_jaccard import brute

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], TABLES), "stage"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding",
    ]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert stages[-1].columns == [*stages[0].columns, "shard"]


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    kept = {i for i, _ in rows(stages[1])}
    clean = [i for i, t in labels.items() if t == 0]
    toxic = [i for i, t in labels.items() if t == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i in toxic) >= 0.6 * len(toxic)


def test_one_document_of_each_group_stays(stages):
    groups = brute(rows(stages[1]))
    assert sorted(i for i, _ in rows(stages[2])) == sorted({int(c) for _, _, c in groups})


def test_leaked_documents_go(spark, stages):
    grams = set()
    for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect():
        w = item_words(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(g) for g in grams}

    def leaks(text):
        w = item_words(text)
        return any(tuple(w[i : i + n]) in grams for n in lengths for i in range(len(w) - n + 1))

    assert sorted(rows(stages[3])) == sorted((i, t) for i, t in rows(stages[2]) if not leaks(t))


def test_mixture_and_shards(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) <= set(before) and len(after) >= 0.5 * len(before)
    last = [(r["doc_id"], r["text"]) for r in stages[5].collect()]
    assert sorted(last) == sorted(after)
    assert set(range(16)) >= {r["shard"] for r in stages[5].collect()}


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, TABLES).collect())) == sorted(map(tuple, stages[5].collect()))


def test_stages_take_empty_tables_nulls_repeats_and_other_columns(spark, stages):
    schema = stages[0].schema
    rows_ = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "ok then", None, None, 7)]
    for df in (spark.createDataFrame([], schema), spark.createDataFrame(rows_, schema)):
        df = df.withColumn("severity", F.lit("x")).withColumn("_bad_id", F.lit(1)).withColumn("k0", F.lit(2))
        columns = df.columns
        n = df.count()
        for _, stage in corpus_pipeline.STAGES:
            df = cut_lineage(stage(spark, df, TABLES), "stage")
            assert df.columns[: len(columns)] == columns
        assert df.count() == n


def test_registered_queries_match_brute_force_where_sql_does_not_reach(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = queries.op3_ngram_jaccard(spark, TABLES)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == brute(rows(docs))
    assert ngram_jaccard.one_of_each(docs).count() == len({c for _, _, c in brute(rows(docs))})
    named = {q.split("_")[0] for q in queries.QUERIES}
    assert named == {f"op{n}" for n in range(1, 14)}
