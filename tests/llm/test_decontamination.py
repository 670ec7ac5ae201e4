import hashlib
import re

import pytest
from pyspark.sql import functions as F

from daydigest.llm import decontamination as D

DOCS = "doc_id long, text string, key int, at string, length int, words int"
BENCH = "item_id long, text string, key string"

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, LONG, "k"), (2, "Just THREE words", "k"), (3, "", "k"), (4, None, "k"), (10, "É one two", "k"), (2, "just three words", "k")]
TEXTS = [
    (1, f"Before. {LONG.upper()}! after it", 0, "x", 1, 1),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota", 0, "x", 1, 1),
    (3, "we say: just-three (words) and just three words", 0, "x", 1, 1),
    (4, "é one two", 0, "x", 1, 1),
    (5, "É ONE two", 0, "x", 1, 1),
    (6, None, 0, "x", 1, 1),
    (7, "", 0, "x", 1, 1),
    (7, "just three words", 0, "x", 1, 1),
    (8, "same clean text", 0, "x", 1, 1),
    (8, "same clean text", 0, "x", 1, 1),
    (9, "word " * 20_000 + LONG, 0, "x", 1, 1),
    (None, LONG + " " + LONG, 0, "x", 1, 1),
    (None, None, 0, "x", 1, 1),
]


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, t, _ in ITEMS:
        v = words(t)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                items.add(str(item))
    return (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("limit, keys_sent", [(D.BROADCAST_BYTES, True), (0, True), (0, False)])
def test_hits_match_brute_force_on_either_side_of_the_broadcast_limit(spark, monkeypatch, limit, keys_sent):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    if not keys_sent:
        monkeypatch.setattr(D, "broadcast_if_small", lambda table, row_bytes: table)
    out = D.contamination(spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, BENCH)).collect()
    assert out[0].asDict().keys() == {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    got = sorted((str(r["doc_id"]), *r[1:]) for r in out)
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in TEXTS)


def test_equal_keys_of_other_words_are_no_hit(spark, monkeypatch):
    monkeypatch.setattr(D, "key_of", lambda at, length: F.lit(7).cast("long"))
    docs, bench = spark.createDataFrame(TEXTS[:4], DOCS), spark.createDataFrame(ITEMS, BENCH)
    for limit in (D.BROADCAST_BYTES, 0):
        monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
        got = sorted((r["doc_id"], *r[1:]) for r in D.contamination(docs, bench).collect())
        assert got == sorted((i, *brute(t)) for i, t, *_ in TEXTS[:4])


def test_documents_and_spans_are_removed(spark):
    docs, bench = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    kept = D.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    want = sorted((str(t[0]), str(t[1])) for t in TEXTS if not brute(t[1])[4])
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == want
    cut = D.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (1, "Before. after it") in texts and (3, "we say: and ") in texts
    assert (2, TEXTS[1][1]) in texts and (8, "same clean text") in texts
    assert D.contamination(cut, bench).filter("contaminated").count() == 0


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(TEXTS, DOCS), spark.createDataFrame(ITEMS, BENCH)
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).filter("n_hit = 0 AND NOT contaminated").count() == len(TEXTS)
