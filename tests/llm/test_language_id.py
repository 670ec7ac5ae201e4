import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from daydigest.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, k0 int, letter int, score string"
SYLLABLES = {"aa": "the and ing er on".split(), "bb": "que les ou né ai".split(), "cc": "ung sch ei der ü".split()}


def prose(lang, seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def documents(n=120):
    return [(i, prose(lang, i), lang, 1, 1, "x") for i, lang in enumerate(sorted(SYLLABLES) * (n // 3))]


def plain_bits(train, text, order):
    """Code length by a tree of dictionaries, context by context."""
    seen = defaultdict(Counter)
    for t in train:
        padded = bytes(order) + t.encode()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k : i]][padded[i]] += 1
    total, padded = 0, bytes(order) + text.encode()
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            counts = seen.get(padded[i - k : i])
            if counts is None:
                continue
            whole = sum(counts.values()) + len(counts)
            if padded[i] in counts:
                total += round(-math.log2(counts[padded[i]] / whole) * L.UNIT)
                break
            total += round(-math.log2(len(counts) / whole) * L.UNIT)
        else:
            total += 8 * L.UNIT
    return total


def test_code_lengths_match_a_plain_tree():
    train = {"aa": ["abab abc", "b"], "bb": ["xyz ab", "zzé"]}
    rows = []
    for number, lang in enumerate(sorted(train)):
        for k in range(L.MAX_ORDER + 1):
            counts = Counter()
            for t in train[lang]:
                flat = np.frombuffer(t.encode(), np.uint8)
                counts.update(L.grams(flat, np.array([0, len(flat)]), L.MAX_ORDER)[k].tolist())
            rows += [(number, k, g, n) for g, n in counts.items()]
    model = L.Model(sorted(train), rows, L.MAX_ORDER)
    texts = ["abc", "zz ab", "é", "q", "xyzabab abab"]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    want = [[plain_bits(train[x], t, L.MAX_ORDER) for x in sorted(train)] for t in texts]
    assert model.lengths(flat, offsets).tolist() == want


def test_held_out_accuracy_and_columns(spark):
    out = L.identify(spark.createDataFrame(documents(), SCHEMA)).collect()
    lang = {d[0]: d[2] for d in documents()}
    assert out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] == lang[r["doc_id"]] and 0.5 < r["score"] <= 1
    assert any(r["held_out"] for r in out)


def test_prediction_ignores_the_label_and_hard_rows(spark):
    rows = documents() + [
        (1000, prose("bb", 1000), None, 1, 1, "x"),
        (1001, None, "aa", 1, 1, "x"),
        (1002, "", "aa", 1, 1, "x"),
        (1003, "123 ... 456", "aa", 1, 1, "x"),
        (1004, prose("cc", 5, 60_000), None, 1, 1, "x"),
        (None, prose("aa", 7), None, None, None, None),
        (1005, prose("aa", 8), None, 1, 1, "x"),
        (1005, prose("aa", 8), None, 1, 1, "x"),
    ]
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(out) == len(rows)
    got = {i: p for i, p, _ in out}
    assert (got[1000], got[1004], got[None], got[1005]) == ("bb", "cc", "aa", "aa")
    assert {got[i] for i in (1001, 1002, 1003)} == {"und"}
    assert all(s == 0 for i, _, s in out if i in (1001, 1002, 1003))


def test_copies_of_a_text_are_learned_once(spark):
    rows = documents(60)
    copies = spark.createDataFrame(rows + [(5000 + i, *rows[0][1:]) for i in range(300)], SCHEMA)
    once, often = (L.train(spark.createDataFrame(rows, SCHEMA)), L.train(copies))
    assert often.languages == once.languages
    for (keys, cost), (keys_2, cost_2) in zip(once.tables, often.tables):
        assert keys.tolist() == keys_2.tolist() and cost.tolist() == cost_2.tolist()


def test_the_sample_is_bounded(spark):
    few = L.train(spark.createDataFrame(documents(120), SCHEMA), train_texts=4)
    all_of_them = L.train(spark.createDataFrame(documents(120), SCHEMA))
    assert few.languages == all_of_them.languages
    assert 0 < len(few.tables[-1][0]) < len(all_of_them.tables[-1][0])


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(0, "some text", None, 1, 1, "x")], SCHEMA)
    assert [tuple(r) for r in L.identify(docs).collect()] == [(0, L.identify(docs).first()["held_out"], "und", 0.0)]
    assert L.identify(docs.filter(F.lit(False))).count() == 0
