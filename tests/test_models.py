"""The pair scorer that is learned and the sentence summarizers, against plain computations."""

import math
import random
import re

import numpy as np
import pytest

from daydigest.operators import learned, summaries, summarizers


def plain_features(query, text):
    q, t = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (query, text))
    qp, tp = (set(zip(x, x[1:])) for x in (q, t))
    shared = len(set(q) & set(t))
    return [
        shared / len(set(q)) if q else 0.0,
        shared / len(set(t)) if t else 0.0,
        len(qp & tp) / len(qp) if qp else 0.0,
        math.log2(1 + len(set(t))) / 16,
    ]


def test_learned_scorer_is_the_least_squares_over_all_pairs(spark):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(f"r{k % 3}", f"d{k}", text(5), text(rng.randrange(1, 40))) for k in range(80)]
    rows += [("r0", "d80", text(4), None), ("r1", "d81", "", text(3)), ("r2", "d82", None, ""), ("r9", "d1", text(3), text(9))]
    judged = [(f"d{k}", rng.random() < 0.4) for k in range(0, 83, 2)] + [("d1", None), ("d5", True), ("unknown", True)]
    frame = spark.createDataFrame(rows, "request string, docno string, query string, text string")
    verdicts = spark.createDataFrame(judged, "docno string, good boolean")
    described = learned.with_features(frame)
    x = {r["docno"]: r["features"] for r in described.filter("request <> 'r9'").collect()}
    for r, d, q, t in rows:
        assert r == "r9" or x[d] == pytest.approx(plain_features(q, t)), d
    good = dict(j for j in judged if j[1] is not None)
    apart = [
        np.array(plain_features(q, t)) - np.array(plain_features(p, s))
        for r, d, q, t in rows for o, e, p, s in rows if r == o and good.get(d) is True and good.get(e) is False
    ]
    a = np.array(apart)
    want = np.linalg.solve(a.T @ a + 0.001 * len(a) * np.eye(4), a.sum(axis=0))
    weights = learned.fit(described, verdicts, ["request"])
    assert weights == pytest.approx(want.tolist(), abs=2e-6)
    scored = learned.learned_scorer(verdicts, ["request"])(frame).collect()
    assert {(r["request"], r["docno"]): r["rerank_score"] for r in scored} == pytest.approx(
        {(r, d): round(float(np.dot(weights, plain_features(q, t))), 6) for r, d, q, t in rows}, abs=2e-6
    )
    assert learned.fit(described, verdicts.filter("good"), ["request"]) == [0.0] * 4


def plain_walk(sentences):
    sets = [set(re.findall("[a-z0-9]+", s.lower())) for s in sentences]
    n = len(sets)
    alike = [[len(a & b) / math.sqrt(len(a) * len(b)) if i != j and a and b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    r = [1 / n] * n
    for _ in range(10):
        r = [0.15 / n + 0.85 * sum(r[i] * alike[i][j] / sum(alike[i]) for i in range(n) if alike[i][j]) for j in range(n)]
    return r


def test_central_sentences():
    text = "The fire burns. A fire in the hills burns homes! Cats sleep. Hills and homes near the fire? ... Rain"
    sentences = re.split(r"[.!?]+\s+", text)
    assert summarizers.walk_ratings(summarizers.term_sets(sentences)) == pytest.approx(plain_walk(sentences), abs=1e-9)
    order = sorted(range(len(sentences)), key=lambda i: -round(plain_walk(sentences)[i], 9))
    assert summarizers.central_sentences(text, 2) == ". ".join(sentences[i] for i in sorted(order[:2]))
    assert "Cats sleep" in [sentences[i] for i in order[-3:]]
    assert summarizers.central_sentences("one two", 2) == "one two"
    assert summarizers.central_sentences("a. a. a. a", 2) == "a. a"
    assert summarizers.central_sentences(None) is None and summarizers.central_sentences("") == ""
    long = ". ".join(f"word{i % 50} word{i % 7} tail{i}" for i in range(1500))
    assert len(summarizers.central_sentences(long).split(". ")) == 3


def test_short_summaries_say_something_new_within_bounds():
    text = "Fire in the hills. Fire in the hills again. Homes near the river are safe and the road is open to all now. Rain"
    assert summarizers.fresh_sentences(text, "fire hills homes", least=5, most=9) == "Fire in the hills Homes near the river are"
    # without the penalty the repetition comes first
    assert summarizers.fresh_sentences(text, "fire hills homes", 5, 9, penalty=0.0) == "Fire in the hills Fire in the hills again."[:-1]
    assert summarizers.fresh_sentences("a b. c", None) == "a b c"
    assert summarizers.fresh_sentences(None, "x") is None and summarizers.fresh_sentences("", "x") == ""
    out = summarizers.fresh_sentences(" ".join(f"w{i}" for i in range(5000)), "w1")
    assert len(out.split()) == 20


def test_summaries_of_a_table(spark):
    rows = [("E-r1", f"q{i}", t, "fire", 1.0) for i, t in enumerate(["Fire here. Fire there #tag", None, ""])]
    frame = spark.createDataFrame(rows, "request_id string, q_id string, texts string, question string, avg_importance double")
    for model in (summarizers.graph_summarizer(), summarizers.short_summarizer()):
        got = {r["q_id"]: r["summary"] for r in summaries.with_batch_summaries(frame, model, 2, clean=True).collect()}
        assert got["q0"].replace(".", "").split() == ["Fire", "here", "Fire", "there"] and got["q1"] is None and got["q2"] == ""
