import math
import random

import numpy as np

from daydigest.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, grade int, severity string, toxic int"
MILD, SEVERE = "foolish silly daft".split(), "vermin filthyone scumlike".split()


def text(seed, grade, n=60):
    rng = random.Random(seed)
    words = ["w" + str(rng.randint(0, 300)) for _ in range(n)]
    for _ in range(3 if grade else 0):
        words.insert(rng.randrange(n), rng.choice(SEVERE if grade == 2 else MILD) + rng.choice(["", "er", "s"]))
    return " ".join(words)


def sample(n=900):
    grades = [0, 0, 0, 0, 1, 2] * (n // 6)
    return [(i, text(i, g), "en", 9, "x", 7) for i, g in enumerate(grades)], grades


def labelled(i):
    return i // 6 % 2 == 0


def labels(grades):
    return [(i, g, None) for i, g in enumerate(grades) if labelled(i)]


def test_gradients_find_ordered_thresholds():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows, columns = np.arange(600), grades
    weights, thresholds = T.fit(grades, rows, columns, np.ones(600), 3)
    assert thresholds[0] < thresholds[1]
    assert weights[0] < weights[1] < weights[2]
    above = T.Model(np.zeros(0), thresholds).above(weights[grades])
    severity = above.sum(axis=1)
    assert severity[grades == 0].max() < 0.5 < severity[grades == 1].min() < 1.5 < severity[grades == 2].min()


def plain_loss(weights, thresholds, grades, rows, columns, values):
    """Mean negative log likelihood of the grades plus the penalty, document by document."""
    score = [0.0] * len(grades)
    for r, c, v in zip(rows, columns, values):
        score[r] += weights[c] * v
    total = 0.0
    for s, g in zip(score, grades):
        above = [1.0, *(1 / (1 + math.exp(t - s)) for t in thresholds), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(grades) + T.PENALTY / 2 * sum(w * w for w in weights)


def test_no_other_weights_or_thresholds_fit_better():
    rng = np.random.default_rng(4)
    n, size = 150, 6
    held = rng.random((n, size)) < 0.4
    held[:, T.LENGTH] = True
    true = held @ np.array([0.0, 2.0, 1.0, -1.0, 0.5, 0.0])
    grades = (true + rng.logistic(size=n) > 0.5).astype(int) + (true + rng.logistic(size=n) > 2.5)
    rows, columns = np.nonzero(held)
    values = rng.uniform(0.5, 1.5, len(rows))
    weights, thresholds = T.fit(grades, rows, columns, values, size)
    assert thresholds[0] < thresholds[1] and weights[T.LENGTH] <= 0
    data = (grades.tolist(), rows.tolist(), columns.tolist(), values.tolist())
    best = plain_loss(weights, thresholds, *data)
    for _ in range(300):
        w, t = weights + rng.normal(0, 0.05, size), thresholds + rng.normal(0, 0.05, 2)
        w[T.LENGTH] = min(w[T.LENGTH], 0.0)
        assert plain_loss(w, t, *data) > best - 1e-5
    # along each axis too, where a gradient that is wrong in one place would show
    for k in range(size):
        for step in (-0.02, 0.02):
            w = weights.copy()
            w[k] += step
            if k != T.LENGTH or w[k] <= 0:
                assert plain_loss(w, thresholds, *data) > best - 1e-5
    model = T.Model(weights, thresholds)
    score = np.bincount(rows, weights[columns] * values, minlength=n)
    chances = [[1 / (1 + math.exp(t - s)) for t in thresholds] for s in score]
    expected = [sum(g * (a - b) for g, (a, b) in enumerate(zip([1.0, *c], [*c, 0.0]))) for c in chances]
    assert np.allclose(model.above(score).sum(axis=1), expected)


def test_held_out_severity_follows_the_grade(spark):
    docs, grades = sample()
    out = {r["doc_id"]: r for r in T.toxicity(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels(grades), "doc_id long, grade int, text string")
    ).collect()}
    assert len(out) == len(docs)
    odd = [i for i in out if not labelled(i)]
    right = [out[i]["toxic"] == (grades[i] > 0) for i in odd]
    assert sum(right) / len(right) > 0.98
    mean = [np.mean([out[i]["severity"] for i in odd if grades[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.2 < mean[1] < 1.6 < mean[2]


def test_hard_rows_and_filter(spark):
    docs, grades = sample()
    docs += [(None, None, None, None, None, None), (5000, "", "en", 1, "x", 1), (5001, text(1, 0, 50_000), "en", 1, "x", 1)]
    docs += [(5002, text(3, 2), "en", 1, "x", 1)] * 2 + [(None, text(4, 0), "en", 1, "x", 1)]
    given = labels(grades) + [(None, 1, "x"), (7, None, None), (8, -1, None), (0, 0, "y")]
    table, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(given, "doc_id long, grade int, text string")
    out = T.toxicity(table, marks).collect()
    assert len(out) == len(docs)
    rated = [(r["doc_id"], r["severity"], r["toxic"]) for r in out]
    assert (5000, 0.0, False) in rated and sum(i == 5002 and x for i, _, x in rated) == 2
    assert not any(x for i, _, x in rated if i in (None, 5001))
    kept = T.without_toxic(table, marks)
    assert kept.columns == table.columns and kept.dtypes == table.dtypes
    assert kept.count() == sum(not x for _, _, x in rated)


def test_without_labels_nothing_is_toxic(spark):
    docs, _ = sample(60)
    table = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], "doc_id long, grade int, text string")
    assert T.toxicity(table, none).filter("toxic OR severity > 0.001").count() == 0
    assert T.toxicity(table.limit(0), none).count() == 0
