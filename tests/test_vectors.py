"""Learned token vectors, and queries against all texts."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators import embed, vectors


def signs(word):
    code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return np.array([1 if code >> k & 1 == 0 else -1 for k in range(32)])


def test_word_vectors_match_a_plain_count(spark):
    texts = ["Fire near the hills, fire spreads", "hills burn; fire", None, "", "the of", "fire " * 3000 + "hills"]
    want = {}
    for text in texts:
        words = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in T.STOP_WORDS]
        for i, w in enumerate(words):
            total = want.setdefault(w, np.zeros(32, int))
            total += signs(w)
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    total += signs(words[j])
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = embed.word_vectors(frame.repartition(3))
    assert {r["word"]: r["vector"] for r in found.collect()} == {w: v.tolist() for w, v in want.items()}
    owners = spark.createDataFrame([(1, texts[0]), (2, None), (3, "the"), (3, "")], "owner long, text string")
    tokens = embed.token_vectors(owners, found).orderBy("owner", "pos").collect()
    assert [(r["owner"], r["pos"]) for r in tokens] == [(1, i) for i in range(4)]
    assert [r["vector"] for r in tokens] == [want[w].tolist() for w in ("fire", "near", "hills", "spreads")]
    assert embed.word_vectors(frame.limit(0)).count() == 0


def test_words_with_like_neighbours_get_like_vectors(spark):
    texts = [f"wild {a} storm {b} coast" for a in ("north", "sea") for b in ("hits", "floods")]
    texts += [t.replace("storm", "tempest") for t in texts] + ["a small choir sings old hymns", "the old choir hums songs"]
    found = {r["word"]: np.array(r["vector"], float) for r in embed.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}

    def cosine(a, b):
        return found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b])

    assert cosine("storm", "tempest") > cosine("storm", "choir") + 0.3


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_every_query_meets_every_text(spark, monkeypatch, size):
    for name in ("QUERY_TOKENS", "TEXT_TOKENS", "PRODUCT_TOKENS"):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(0)
    asked = {f"q{i}": rng.normal(size=(rng.integers(1, 6), 4)) for i in range(4)}
    held = {i: rng.normal(size=(rng.integers(1, 9), 4)) for i in range(9)}
    held[3] = np.zeros((2, 4))

    def frame(texts, kind):
        rows = [(o, i, v.tolist()) for o, m in texts.items() for i, v in enumerate(m)]
        return spark.createDataFrame(rows, f"owner {kind}, pos long, vector array<double>")

    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    products = {(a, b): unit(x) @ unit(y).T for a, x in asked.items() for b, y in held.items()}
    got = {(r.left, r.right): r.rerank_score for r in vectors.max_sim_all(frame(asked, "string"), frame(held, "long")).collect()}
    assert got == pytest.approx({k: p.max(axis=1).sum() for k, p in products.items()})
    greedy = vectors.greedy_scores_all(frame(asked, "string"), frame(held, "long")).collect()
    assert {(r.left, r.right): r.precision for r in greedy} == pytest.approx({k: p.max(axis=1).mean() for k, p in products.items()})
    assert {(r.left, r.right): r.recall for r in greedy} == pytest.approx({k: p.max(axis=0).mean() for k, p in products.items()})
    pairs = spark.createDataFrame(list(products), "left string, right long")
    old = {(r.left, r.right): r.rerank_score for r in vectors.max_sim(pairs, frame(asked, "string"), frame(held, "long")).collect()}
    assert old == pytest.approx(got)
    assert vectors.max_sim_all(frame(asked, "string"), frame(held, "long").filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_texts_as_words_give_the_scores_of_their_vectors(spark, monkeypatch, size):
    """Repeated owners are one text, a query's repeated place counts once for pairs, and words without a vector not at all."""
    for name in ("QUERY_TOKENS", "GROUP_WORDS", "GROUP_TEXTS", "PRODUCT_TOKENS", "PRODUCT_COLUMNS"):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(1)
    unit = {f"w{i}": v / np.linalg.norm(v) for i, v in enumerate(rng.normal(size=(12, 4)))}
    draw = lambda n: [f"w{i}" for i in rng.choice(12, n, replace=False)]
    asked = [("a", 0, "w1"), ("a", 1, "w5"), ("b", 0, "w2"), ("b", 0, "w7"), ("b", 1, "w7"), ("c", 0, "none")]
    held = [(i, draw(1 + i % 5)) for i in range(9)] + [(3, draw(4)), (20, ["none"]), (21, []), (22, None)]
    words = spark.createDataFrame([(w, [float(x) for x in v * 3]) for w, v in unit.items()], "word string, vector array<double>")
    texts = {i: [w for j, ws in held if j == i for w in ws or [] if w in unit] for i, _ in held}
    best = lambda w, i: max(float(unit[w] @ unit[u]) for u in texts[i])
    frames = spark.createDataFrame(asked, "owner string, pos int, word string"), spark.createDataFrame(held, "owner long, words array<string>"), words
    every = {(q, i): sum(best(w, i) for o, _, w in asked if o == q) for q in "ab" for i in texts if texts[i]}
    assert {(r.left, r.right): r.rerank_score for r in vectors.max_sim_words(*frames).collect()} == pytest.approx(every)
    wanted = [("a", 1), ("b", 3), ("a", 3), ("b", 20), ("c", 2), ("b", 99)]
    pairs = spark.createDataFrame(wanted, "left string, right long")
    once = {("a", 1): every["a", 1], ("a", 3): every["a", 3], ("b", 3): max(best("w2", 3), best("w7", 3)) + best("w7", 3)}
    assert {(r.left, r.right): r.rerank_score for r in vectors.max_sim_words(*frames, pairs).collect()} == pytest.approx(once)
    assert vectors.max_sim_words(frames[0], frames[1].limit(0), words).count() == 0


def test_a_text_travels_as_words(spark):
    """A vector crosses a shuffle once for a word of a group, not for each token of a text."""
    texts = spark.createDataFrame([(i, ["fire", "road"]) for i in range(50)], "owner long, words array<string>")
    words = spark.createDataFrame([("fire", [1.0, 0.0]), ("road", [0.0, 1.0])], "word string, vector array<double>")
    asked = spark.createDataFrame([("q", 0, "road")], "owner string, pos int, word string")
    found = vectors.max_sim_words(asked, texts, words)
    assert [r.rerank_score for r in found.collect()] == [1.0] * 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [part" in plan and "collect_list(vector" not in plan
