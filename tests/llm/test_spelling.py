import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from daydigest.llm import spelling


def brute_words(rows, least=7, count=2, misspell=31):
    held = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % misspell == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= least:
                held[w] += 1
    return {w: n for w, n in held.items() if n >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=10):
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        out[w] = (n, len(near))
    rows = []
    for w, (n, near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, near, words[forms[w]] if forms[w] else None))
    return sorted(rows)


def found(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    rng = random.Random(0)
    base = ["aabbccddee", "stellung", "fenêtrées", "aaaaaaaa", "überhaupt"]

    def noisy():
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("sté÷") + w[i + 1 :]])
        return w.title() if rng.random() < 0.2 else w

    rows = [(i % 250, rng.choice([" ", "-", "\n", "1", "ĳ"]).join(noisy() for _ in range(40))) for i in range(300)]
    rows += [(None, "Stellung STELLUNG ÉTRANGE étrange"), (7, None), (8, ""), (9, "ab cd"), (1, "Q" * 50_000 + " " + "q" * 50_000)]
    table = spark.createDataFrame([(i, t, "own", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    got = found(spelling.spelling_groups(table, 31))
    assert got == brute_variants(brute_words(rows))
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] != r[2] for r in got if r[1])
    plain = {r["word"]: r["n"] for r in spelling.word_counts(table, 4, 1).collect()}
    assert plain == brute_words(rows, 4, 1, None)
    assert found(spelling.spelling_groups(table.limit(0), 31)) == []


@pytest.mark.parametrize("batch", [3, 10_000])
def test_runs_of_equal_letters_ties_and_chains(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = random.Random(1)
        words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))): rng.choice([1, 1, 10, 10, 100, 1000]) for _ in range(200)}
        # a chain of forms of ten steps
        words |= {"z" * k + "y" * (12 - k): 10 ** (k + 1) for k in range(13)}
        table = spark.createDataFrame(list(words.items()), "word string, n long")
        assert found(spelling.spelling_variants(table)) == brute_variants(words)
        assert found(spelling.spelling_variants(table, 2)) == brute_variants(words, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_hot_word_with_many_variants(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    hot = "strasse"
    words = {hot: 10**12} | {hot[:i] + c + hot[i + 1 :]: 2 for i in range(7) for c in letters if c != hot[i]}
    words |= {hot[:i] + c + hot[i:]: 3 for i in range(8) for c in letters}
    got = found(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)
    assert {r[2] for r in got} == {hot}


def test_groups_over_batches():
    rows = [("a", 5, False, True), ("b", 1, True, False), ("b", 2, False, True), ("b", 3, False, False), ("c", 4, True, False)]
    fields = [("key", pa.string()), ("rank", pa.int64()), ("whole", pa.bool_()), ("leads", pa.bool_())]
    want = [(1, 1, 2), (2, 2, 1), (3, 1, 1)]
    for size in (1, 2, 3, 5):
        batches = [pa.RecordBatch.from_pylist([dict(zip([f[0] for f in fields], r)) for r in rows[i : i + size]], pa.schema(fields)) for i in range(0, 5, size)]
        assert [tuple(r.values()) for b in spelling.scanned(iter(batches)) for r in b.to_pylist()] == want


def test_long_words(spark):
    rng = random.Random(2)
    words = {}
    for size in (62, 63, 64, 65, 66, 200):
        base = "".join(rng.choice("abcé") for _ in range(size))
        words[base] = 100
        for _ in range(12):
            i = rng.randrange(size)
            words[rng.choice([base[:i] + base[i + 1 :], base[:i] + rng.choice("xyz") + base[i + 1 :], base[:i] + rng.choice("aé") + base[i:]])] = rng.choice([3, 3, 20])
    words |= {"a" * n: n for n in range(60, 70)}
    got = found(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)
    # a million letters, twice, and a copy that lacks one
    huge = "".join(rng.choices("acgt", k=1_000_000))
    pair = [(huge, 50), (huge[:-3] + huge[-2:], 2)]
    got = {len(r["word"]): (len(r["root"]), r["n_near"]) for r in spelling.spelling_variants(spark.createDataFrame(pair, "word string, n long")).collect()}
    assert got == {1_000_000: (1_000_000, 1), 999_999: (1_000_000, 1)}
