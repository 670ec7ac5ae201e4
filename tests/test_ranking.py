"""Ranking models and paths against a plain Python count over a small corpus."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daydigest.operators import collection as C
from daydigest.operators import digest, ranking, rerank, vectors
from daydigest.plans import rank_rerank

DOCS = [
    ("d1", "fire near road fire"),
    ("d2", "road closed"),
    ("d3", "water supply fire"),
    ("d4", "fire fire fire"),
    ("d5", "fire near road fire"),
    ("d6", "nothing else matches"),
    ("d7", None),
]
QUERY = "fire road road"


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(
        [("e", "2020-01-01", f"X-e-web-{d}", t, 100 + i) for i, (d, t) in enumerate(DOCS)],
        "event_id string, date string, docno string, text string, unix_timestamp long",
    ).withColumn("date", F.to_date("date"))
    queries = spark.createDataFrame(
        [
            ("q1", "fire where", QUERY, "cat", "e", "Event"),
            ("q2", "no hit", "volcano", None, "e", "Event"),
        ],
        """query_id string, text string, indicative_terms string, trecis_category_mapping string,
        event_id string, event_title string""",
    )
    calendar = corpus.select("event_id", "date").distinct().withColumns(
        {"day_pos": F.lit(0), "request_id": F.lit("e-r1")}
    )
    return corpus, queries, calendar


def brute_force(model):
    docs = {d: t.split() for d, t in DOCS if t}
    n, total = len(DOCS), sum(len(t) for t in docs.values())
    avg = total / n
    cf = Counter(w for t in docs.values() for w in t)
    df = Counter(w for t in docs.values() for w in set(t))
    scores = {}
    for d, words in docs.items():
        dl, s, hit = len(words), 0.0, False
        for term, qtf in Counter(QUERY.split()).items():
            tf = words.count(term)
            if not tf:
                continue
            hit = True
            if model == "BM25":
                idf = math.log2((n - df[term] + 0.5) / (df[term] + 0.5))
                s += idf * 2.2 * tf / (1.2 * (0.25 + 0.75 * dl / avg) + tf) * 9 * qtf / (8 + qtf)
            elif model == "DPH" and tf < dl:
                f = tf / dl
                inner = tf * math.log2(tf * (avg / dl) * (n / cf[term]))
                inner += 0.5 * math.log2(2 * math.pi * tf * (1 - f))
                s += qtf * (1 - f) ** 2 / (tf + 1) * inner
            elif model == "DirichletLM":
                s += qtf * (math.log2(1 + tf / (2500 * cf[term] / total)) + math.log2(2500 / (dl + 2500)))
            elif model == "Hiemstra_LM":
                s += qtf * math.log2(1 + 0.15 * tf * total / (0.85 * cf[term] * dl))
        if hit:
            scores[f"X-e-web-{d}"] = round(s, 6)
    return scores


@pytest.mark.parametrize("model", ["BM25", "DPH", "DirichletLM", "Hiemstra_LM"])
def test_model_scores(tables, model):
    rows = ranking.rank(*tables, model=model, steps=("stop",)).collect()
    got = {r.docno: r.score for r in rows}
    expected = brute_force(model)
    assert got.keys() == expected.keys()
    assert all(abs(got[d] - expected[d]) < 2e-6 for d in expected)
    ordered = sorted(rows, key=lambda r: r["rank"])
    assert [r["rank"] for r in ordered] == list(range(len(rows)))
    assert [r.docno for r in ordered] == sorted(expected, key=lambda d: (-expected[d], d))


def test_one_index_serves_every_model_from_one_pass(tables):
    corpus, queries, calendar = tables
    index = ranking.corpus_index(corpus, calendar, ("stop",))
    for model in ranking.MODELS:
        ranked = ranking.rank_index(index, queries, calendar, model)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan.replace("indicative", "")
    got = {r.docno: r.score for r in ranking.rank_index(index, queries, calendar, "BM25").collect()}
    assert got.keys() == brute_force("BM25").keys()


def test_rows_of_one_id_are_documents_of_their_own(spark, tables):
    _, queries, calendar = tables
    corpus = spark.createDataFrame(
        [("e", "2020-01-01", "a-b-c-1", t, 1) for t in ("fire road", "fire road", "fire water")],
        "event_id string, date string, docno string, text string, unix_timestamp long",
    ).withColumn("date", F.to_date("date"))
    index = ranking.corpus_index(corpus, calendar)
    rows = ranking.postings_of_queries(index, queries, calendar).collect()
    assert sorted((r.term, r.tf, r.df, r.cf, r.n_docs) for r in rows) == [("fire", 1, 3, 3, 3)] * 3 + [("road", 1, 2, 2, 3)] * 2
    hits = rank_rerank.candidates(corpus, queries, calendar, "DPH", C.STOP_THEN_STEM).collect()
    assert sorted((r["rank"], r.text) for r in hits) == sorted((r["rank"], r.text) for r in hits) and len(hits) == 3
    assert sorted(r.text for r in hits) == ["fire road", "fire road", "fire water"]


def test_long_terms_numbers_and_late_hits_count(spark, tables):
    _, _, calendar = tables
    long = "internationalizationalism" + "x" * 10
    text = "word " * 1200 + f"20171207 {long} aaaaa"
    corpus = spark.createDataFrame(
        [("e", "2020-01-01", "a-b-c-1", text, 1), ("e", "2020-01-01", "a-b-c-2", "other words", 1)],
        "event_id string, date string, docno string, text string, unix_timestamp long",
    ).withColumn("date", F.to_date("date"))
    queries = spark.createDataFrame(
        [("q1", "when", f"20171207 {long} aaaaa", "c", "e", "Event")],
        """query_id string, text string, indicative_terms string, trecis_category_mapping string,
        event_id string, event_title string""",
    )
    row = rank_rerank.rank_rerank_colbert(corpus, queries, calendar).first()
    assert row.docno == "a-b-c-1" and row.text == text
    assert len(rank_rerank.rank_rerank_colbert(corpus, queries, calendar, stored_chars=200).first().text) == 200
    terms = ranking.postings_of_queries(ranking.corpus_index(corpus, calendar, ("stop",)), queries, calendar)
    assert {r.term for r in terms.collect()} == {"20171207", long, "aaaaa"}


def test_unknown_model_is_refused(tables):
    with pytest.raises(ValueError):
        rank_rerank.run_digest(*tables, model="nope")
    with pytest.raises(ValueError):
        rank_rerank.run_digest(*tables, reranker="nope")


def test_step_order_changes_length(spark, tables):
    """'having' stems to a stop word, so only the stem-first order drops it."""
    corpus = spark.createDataFrame(
        [("e", "2020-01-01", "a-b-c-1", "fires havings road", 1)],
        "event_id string, date string, docno string, text string, unix_timestamp long",
    ).withColumn("date", F.to_date("date"))
    _, queries, calendar = tables
    for steps, length in ((C.STOP_THEN_STEM, 3), (C.STEM_THEN_STOP, 2)):
        index = ranking.corpus_index(corpus, calendar, steps)
        row = ranking.postings_of_queries(index, queries, calendar).filter("term = 'fire'").first()
        assert (row.dl, row.n_terms, row.tf) == (length, length, 1)


def test_whole_path(tables):
    ranked = rank_rerank.rank_rerank_colbert(*tables)
    assert ranked.columns == rank_rerank.RANKED
    rows = ranked.collect()
    assert 0 < len(rows) <= 5 and {r.q_id for r in rows} == {"q1"}
    assert max(r.importance for r in rows) == 1.0 and min(r.importance for r in rows) == 0.0
    assert sorted(r.rerank_rank for r in rows) == list(range(1, len(rows) + 1))
    assert {r.source for r in rows} == {"web"} and {str(r.request_date) for r in rows} == {"2020-01-01"}
    grouped = digest.group_documents(ranked).collect()
    assert len(grouped) == 1
    best = sorted(rows, key=lambda r: (-r.importance, r.docno))
    assert grouped[0].docno_list == [r.docno for r in best]
    assert grouped[0].texts == " ".join(r.text for r in best)


def test_other_path_has_the_same_columns(tables):
    assert rank_rerank.rank_rerank_t5(*tables).columns == rank_rerank.RANKED


def test_top_k_is_cut_before_the_shuffle(tables):
    plan = ranking.rank(*tables, steps=("stop",))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_model_scorer_and_null_scores(spark):
    hits = spark.createDataFrame(
        [("e", "q", "a", "x", "xx"), ("e", "q", "b", "x", "x"), ("e", "q", "c", "x", "none")],
        "event_id string, q_id string, docno string, query string, text string",
    )

    def factory():
        return lambda q, t: t.str.len().where(t != "none").astype("float64")

    scored = rerank.with_model_score(hits, factory)
    ranks = {r.docno: r.rerank_rank for r in rerank.rerank_ranks(scored, ["event_id"]).collect()}
    assert ranks == {"a": 1, "b": 2, "c": None}
    assert rerank.rerank_cut(scored, ["event_id"], 1).first().docno == "a"


def test_equal_scores_give_null_importance(spark):
    rows = [("r1", 2.0), ("r1", 2.0), ("r2", 1.0), ("r2", 3.0)]
    df = spark.createDataFrame(rows, "request_id string, rerank_score double")
    got = sorted(
        (r.request_id, r.importance) for r in digest.with_importance(df).collect() if r.request_id == "r2"
    )
    assert got == [("r2", 0.0), ("r2", 1.0)]
    equal = digest.with_importance(df).filter("request_id = 'r1'").collect()
    assert [r.importance for r in equal] == [None, None]


def test_groups_with_null_keys_are_dropped(spark):
    df = spark.createDataFrame(
        [("r", None, "e", "t", "d", "x", 1.0, 5, "q", "w"), ("r", "q", "e", "t", "d", "x", None, 5, "q", "w")],
        """request_id string, q_id string, event_id string, event_title string, docno string,
        text string, importance double, unix_timestamp long, question string, query string""",
    )
    rows = digest.group_documents(df).collect()
    assert [(r.q_id, r.texts, r.avg_importance) for r in rows] == [("q", "x", None)]


def test_max_sim_over_many_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    sides = {name: rng.normal(size=(size, 8)) for name, size in (("q", 3), ("big", 600), ("small", 2))}

    def rows(*names):
        data = [(n, i, [float(x) for x in v]) for n in names for i, v in enumerate(sides[n])]
        return spark.createDataFrame(data, "owner string, pos long, vector array<double>")

    pairs = spark.createDataFrame([("q", "big"), ("q", "small")], "left string, right string")
    got = {r.right: r.rerank_score for r in vectors.max_sim(pairs, rows("q"), rows("big", "small")).collect()}
    unit = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in sides.items()}
    for name in ("big", "small"):
        assert abs(got[name] - (unit["q"] @ unit[name].T).max(axis=1).sum()) < 1e-4


def test_every_model_is_the_query_weight_times_its_score_of_one(spark):
    row = spark.createDataFrame([(3, 20, 4, 5, 9, 50, 900)], "tf long, dl long, qtf long, df long, cf long, n_docs long, n_terms long")
    one = ranking.replace(ranking.Statistics.of_row(), qtf=F.lit(1.0))
    pairs = {m: (f(ranking.Statistics.of_row()), f(one) * ranking.query_weight(m)) for m, f in ranking.MODELS.items()}
    found = row.select(*[c.alias(f"{m}_{i}") for m, both in pairs.items() for i, c in enumerate(both)]).first()
    assert all(found[f"{m}_0"] == pytest.approx(found[f"{m}_1"], rel=1e-12) for m in pairs)


@pytest.mark.parametrize("model", ["BM25", "DPH", "DFRee"])
def test_best_of_groups_are_the_best_of_all(spark, tables, monkeypatch, model):
    """Ties, repeated rows, a null query number and terms asked twice; documents in groups of two, one run each."""
    monkeypatch.setattr(ranking, "PART_DOCS", 2)
    monkeypatch.setattr(ranking, "DOCS_A_RANK", 0)
    monkeypatch.setattr(ranking, "CELLS", 3)
    words = ["fire", "road", "water", "fires", "bridge"]
    texts = [" ".join(words[(i * j) % 5] for j in range(1, 2 + i % 4)) for i in range(23)] + [None, "none at all"]
    corpus = spark.createDataFrame(
        [("e", f"2020-01-0{1 + i % 2}", f"a-b-c-{i // 2 * 2}", t, 1) for i, t in enumerate(texts)],
        "event_id string, date string, docno string, text string, unix_timestamp long",
    ).withColumn("date", F.to_date("date"))
    queries = spark.createDataFrame(
        [(None, "", "fire fire road", "c", "e", "E"), ("q1", "", "bridge", "c", "e", "E"), ("q2", "", "water fire", "c", "f", "E")],
        """query_id string, text string, indicative_terms string, trecis_category_mapping string,
        event_id string, event_title string""",
    )
    calendar = corpus.select("event_id", "date").distinct()
    index = ranking.corpus_index(corpus, calendar)
    every = ranking.score_documents(ranking.postings_of_queries(index, queries, calendar), model)
    key = ["q_id", "event_id", "date", "docno", "row_id", "row_hash", "rank", "score"]
    rows = lambda df: sorted([tuple(r) for r in df.select(*key).collect()], key=repr)
    want = rows(ranking.first_stage(every, 4))
    got = rows(ranking.rank_index(index, queries, calendar, model, 4))
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and len(got) > 8
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want], abs=1e-9)


def test_no_pair_of_query_and_document_is_shuffled(tables):
    """The shuffles before the scores carry postings and queries; behind them come the best rows alone."""
    plan = ranking.rank(*tables, steps=("stop",))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate(keys=[q_id" not in plan


def test_rounding_and_order_are_those_of_spark(spark):
    import numpy as np

    values = [0.1234565, -0.1234565, 2.5e-7, 5e-7, 1.0000005, 123456.7890125, 3e12, -0.0, float("nan"), float("inf"), 1.4999999999e-6]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("x")).collect()]
    np.testing.assert_array_equal(ranking.rounded(np.array(values)), want)
    score = np.ma.masked_array([1.0, np.nan, 0.0, -np.inf, 1.0], [False, False, True, False, False])
    assert ranking.best_rows(np.zeros(5, int), np.array([4, 1, 2, 3, 0]), score, 4).tolist() == [1, 4, 0, 3]
