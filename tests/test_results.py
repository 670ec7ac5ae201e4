"""Sources, sinks, publishing, profiling and evaluation on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daydigest import schemas
from daydigest.operators import evaluate, profile, publish, summaries
from daydigest.sinks import writers
from daydigest.sources import inputs, results


def test_calendar_files(spark, tmp_path):
    for event in ("001", "002"):
        days = [{"eventID": event, "requestID": f"X-{event}-r{i}", "dateString": f"2020-01-0{9 - i}"} for i in (1, 2, 3)]
        (tmp_path / f"X-{event}.requests.json").write_text(json.dumps(days, indent=1))
    calendar = inputs.read_calendar(spark, f"{tmp_path}/*.json", "002", 2)
    rows = sorted((r.event_id, r.day_pos, str(r.date), r.request_id) for r in calendar.collect())
    assert rows == [("002", 0, "2020-01-08", "X-002-r1"), ("002", 1, "2020-01-07", "X-002-r2")]


def test_queries_csv(spark, tmp_path):
    header = ",".join(f.name for f in schemas.QUERIES.fields)
    line = 'q1,"Have, roads closed",road closed,None,X-001,T,ds,"A ""fire""",id,Wildfire,url'
    (tmp_path / "001.csv").write_text(f"{header}\n{line}\n")
    row = inputs.read_queries(spark, f"{tmp_path}/*.csv").first()
    assert (row.text, row.trecis_category_mapping, row.event_description, row.file_event) == (
        "Have, roads closed",
        None,
        'A "fire"',
        "001",
    )


def test_event_dim_and_topics(spark, tmp_path):
    assert inputs.event_dim(spark).count() == 18
    (tmp_path / "topics.json").write_text(json.dumps([{"eventID": "a", "title": "A"}, {"eventID": "b"}], indent=1))
    assert inputs.read_topics(spark, f"{tmp_path}/topics.json").count() == 2


def test_judged_requests_of_one_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"X-001-r1": [1], "X-001-r2": {"k": 1}}, indent=1))
    rows = inputs.read_judged_requests(spark, f"{tmp_path}/a.json").collect()
    assert sorted(r.request_id for r in rows) == ["X-001-r1", "X-001-r2"]


def test_corpus_with_repeated_ids(spark, tmp_path):
    rows = [("d1", "b", 2), ("d1", "a", 1), ("d1", "c", 3), ("d2", "x", 1)]
    df = spark.createDataFrame(rows, "docno string, text string, unix_timestamp long")
    df.withColumns({"event_id": F.lit("001"), "date": F.lit("2020-01-01")}).write.partitionBy(
        "event_id", "date"
    ).parquet(f"{tmp_path}/c")
    assert inputs.read_corpus(spark, f"{tmp_path}/c").count() == 4
    unique = inputs.read_corpus(spark, f"{tmp_path}/c", unique=True, fields=("docno", "text"))
    assert sorted((r.docno, r.text) for r in unique.collect()) == [("d1", "a"), ("d2", "x")]


def test_run_files_keep_the_null_field(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", "t", 1, 0.5, ["a", "b"], None, "q")],
        schemas.FACTS,
    )
    path = writers.write_facts(df, f"{tmp_path}/run-a")
    assert '"streamID":null' in spark.read.text(path).first()[0]
    row = results.read_runs(spark, path).first()
    assert (row.sources, row.streamID) == (["a", "b"], None) and row.run_id.startswith("part-")


GROUPED = """request_id string, q_id string, Event string, event_title string, texts string,
    docno_list array<string>, avg_importance double, unix_timestamp long, question string, query string"""
GROUP_ROWS = [
    ("e-1-r1", "q1", "1", "E", 'Roads shut. A "fire" burns near the school! Go.', ["d1", "d2"], 0.5, 86400, "where is the fire", "fire"),
    ("e-1-r1", "q2", "1", "E", "Nothing\nto see", ["d3"], None, 86401, "how many boats", "boats"),
]


def test_grouped_csv_round_trip(spark, tmp_path):
    grouped = spark.createDataFrame(GROUP_ROWS, GROUPED)
    path = writers.write_named_csv(grouped, str(tmp_path), "BM25", "T5", True)
    assert path.endswith("BM25_T5_summary.csv")
    back = results.read_grouped(spark, path).orderBy("q_id").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in grouped.orderBy("q_id").collect()]


def test_answers_and_finish(spark):
    grouped = spark.createDataFrame(GROUP_ROWS, GROUPED)
    rows = summaries.finalised(summaries.with_answers(grouped)).collect()
    assert [r.summary for r in rows] == ['A "fire" burns near the school', "unanswerable"]
    assert (rows[0].request, rows[0].date, rows[0].datetime) == ("e-1", "1970-01-02", "1970-01-02 00:00:00")


def test_batch_summaries_see_prompt_and_clean_text(spark):
    def factory():
        def run(batch: pd.DataFrame) -> pd.Series:
            assert batch["prompt"].str.contains("?", regex=False).all()
            return batch["texts"].str.upper()

        return run

    df = spark.createDataFrame([GROUP_ROWS[0][:4] + ("go #fire @me",) + GROUP_ROWS[0][5:]], GROUPED)
    row = summaries.with_batch_summaries(df, factory, 2, clean=True).first()
    assert (row.summary, row.texts) == ("GO  ", "go #fire @me")


def test_publish_folder_skips_existing(spark, tmp_path):
    spark.createDataFrame([("E", "s", "q", 10, 0.1)], "event_name string, summary string, question string, unix_timestamp long, avg_importance double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/in/summary.csv")
    (tmp_path / "in" / "other.csv").write_text("a,b\n1,x\n2,y\n")
    tables = publish.publish_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert sorted(tables) == ["other", "summary"]
    published = spark.read.parquet(tables["summary"])
    assert published.columns == ["request", "date", "datetime", "question", "summary_xsum_detail", "avg_importance"]
    (tmp_path / "in" / "other.csv").write_text("a,b\n9,z\n")
    publish.publish_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert spark.read.parquet(tables["other"]).count() == 2
    assert publish.rows_of_request(published, "E").count() == 1
    assert publish.rows_of_request(published, "F").count() == 0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 50 + [1.0, 9.0], [float(i * i) for i in range(101)]])
def test_describe_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {r.stat: r.value for r in profile.describe(df).collect()}
    expected = pd.Series(values).describe()
    for stat, value in expected.items():
        assert (got[stat] is None and pd.isna(value)) or abs(got[stat] - value) < 1e-9, stat


def test_null_counts_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert {r.column_name: r.n_null for r in profile.null_counts(df).collect()} == {"a": 1, "b": 2}
    info = {r.column_name: tuple(r)[1:] for r in profile.schema_info(df).collect()}
    assert info == {"a": ("int", 2, 3), "b": ("string", 1, 3)}


def test_rouge2_identity_disjoint_and_clipped(spark):
    candidates = spark.createDataFrame(
        [("same", "e", "The fires burned hills"), ("none", "e", "boats sail away"), ("one", "e", "word"), ("twice", "e", "the fires the fires")],
        "run_id string, event_id string, text string",
    )
    references = spark.createDataFrame([("e", "the fire burning hills")], "event_id string, text string")
    got = {r.run_id: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) for r in evaluate.rouge2(candidates, references).collect()}
    assert got == {
        "same": (1.0, 1.0, 1.0),
        "none": (0.0, 0.0, 0.0),
        "one": (0.0, 0.0, 0.0),
        "twice": (0.3333, 0.3333, 0.3333),
    }


def test_event_summary_keeps_top_facts_of_judged_requests(spark):
    rows = [("run", "e-r1", f"f{i}", float(i // 2), i) for i in range(40)] + [("run", "e-r2", "x", 1.0, 99)]
    facts = spark.createDataFrame(rows, "run_id string, requestID string, factText string, importance double, position int")
    requests = spark.createDataFrame([("e-r1", 0)], "request_id string, request_pos int")
    row = evaluate.event_summaries(facts, requests).first()
    expected = sorted(range(40), key=lambda i: (-(i // 2), i))[:32]
    assert row.n_facts == 32 and row.event_id == "e"
    assert row.summary_text == ". ".join(f"f{i}" for i in expected)
