"""Queries against all texts that travel as numbers of words."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators import embed, vectors
from suite import tables as S


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def frames(spark, asked, held, words, column="words", kind="array<string>"):
    return (
        spark.createDataFrame([(q, i, w) for q, ws in asked.items() for i, w in enumerate(ws)], "owner string, pos int, word string"),
        spark.createDataFrame(held, f"owner string, {column} {kind}"),
        spark.createDataFrame([(w, [float(x) for x in v]) for w, v in words.items()], "word string, vector array<double>"),
    )


def test_texts_are_numbered_where_they_are_read(spark):
    """Neither the words of a text nor the text itself are dealt out by group before its words have numbers."""
    asked, held, words = frames(spark, {"q": ["road"]}, [(str(i), ["fire", "road"]) for i in range(50)], {"fire": (1, 0), "road": (0, 1)})
    found = vectors.max_sim_words(asked, held, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan
    assert not re.search(r"hashpartitioning\(part#\w+, word", plan)
    assert not re.search(r"words#\w+: array<string>|words:array<string>", plan)
    assert [r.rerank_score for r in found.collect()] == [1.0] * 50


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("dims", [3, 300])
def test_cosines_that_hardly_differ_are_told_apart(spark, monkeypatch, small, dims):
    """The best cosine is exact where many are the same in short numbers."""
    if small:
        limits = {"TEXT_WORDS": 3, "PRODUCT_WORDS": 2, "PRODUCT_COLUMNS": 3, "RETURNED_ROWS": 4, "GROUP_VOCABULARY": 5, "PART_QUERIES": 2}
        for name, value in limits.items():
            monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(2)
    about = rng.normal(size=dims)
    matrix = np.vstack([about + 1e-6 * rng.normal(size=(20, dims)), rng.normal(size=(4, dims)), np.zeros((1, dims))])
    words = {f"w{i}": v for i, v in enumerate(matrix)}
    exact = np.vstack([unit(matrix[:-1]), np.zeros((1, dims))])
    draw = lambda n: rng.choice(25, n, replace=False).tolist()
    asked = {f"q{i}": draw(1 + 2 * i) for i in range(5)}
    held = {f"d{i}": draw(1 + i % 11) for i in range(30)}
    got = vectors.max_sim_words(
        *frames(spark, {q: [f"w{i}" for i in ws] for q, ws in asked.items()}, [(d, [f"w{i}" for i in ws]) for d, ws in held.items()], words)
    )
    want = {(q, d): (exact[a] @ exact[h].T).max(axis=1).sum() for q, a in asked.items() for d, h in held.items()}
    assert {(r.left, r.right): r.rerank_score for r in got.collect()} == pytest.approx(want, rel=0, abs=1e-13)


def test_texts_may_be_given_whole(spark):
    words = {"fire": (1, 0), "road": (0, 1), "hill": (3, 4)}
    texts = [("a", "Fire on the ROAD, fire!"), ("b", "the road"), ("b", "hill"), ("c", None), ("d", "the"), ("e", "Été-hill"), (None, "fire")]
    found = vectors.max_sim_words(*frames(spark, {"q": ["road", "hill"], "p": ["fire"]}, texts, words, "text", "string")).collect()
    want = {("q", "a"): 1.8, ("p", "a"): 1, ("q", "b"): 2, ("p", "b"): 0.6, ("q", "e"): 1.8, ("p", "e"): 0.6, ("q", None): 0.6, ("p", None): 1}
    assert {(r.left, r.right): r.rerank_score for r in found} == pytest.approx(want)


def test_terms_of_a_batch_are_those_of_the_expression(spark):
    texts = [None, "", "the", "fire", "Fire fire", "a1 B2-c3", "ñandú ÉTÉ", "İstanbul Kelvin K", " lead", "trail ", "日本abc日本", "x" * 5000, None, "Q"]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    want = {r.n: r.terms or [] for r in frame.select("n", T.terms_without_stop_words("text").alias("terms")).collect()}
    lowered = frame.select("n", F.lower("text").alias("text")).orderBy("n").toArrow()["text"].combine_chunks()
    for at in range(len(texts) + 1):
        text, codes, words = T.coded_terms(lowered[at:])
        found = {n: [] for n in range(at, len(texts))}
        for n, code in zip(text, codes):
            found[n + at].append(words[code].as_py())
        assert found == {n: want[n] for n in found}


def test_sums_of_many_batches(spark, monkeypatch):
    frame = spark.createDataFrame([(f"storm {i % 7} coast fire{i % 3} hills",) for i in range(200)], "text string").repartition(2)
    want = {r.word: r.vector for r in embed.word_vectors(frame).collect()}
    monkeypatch.setattr(embed, "SUMMED_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.word: r.vector for r in embed.word_vectors(frame).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_documents_are_joined_with_their_times_once(spark, tmp_path):
    spark.createDataFrame([(1, "fire road", "en", "s"), (2, "hill", "de", "s"), (3, "lost", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (2,), (2,)], "event_id long").selectExpr(
        "event_id", "timestamp'2024-01-01 00:00:00' AS ts", "'view' AS event_type", "1.0D AS value"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(5, "hill road")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    asked, held, words = S.learned_words(spark, str(tmp_path))
    assert sorted(tuple(r) for r in held.collect()) == [("Doc-de-s-2", "hill")] * 2 + [("Doc-en-s-1", "fire road")]
    assert sorted(r.word for r in words.collect()) == ["fire", "hill", "road"]
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
