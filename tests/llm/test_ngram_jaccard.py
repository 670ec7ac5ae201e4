import random
import re

import pytest
from pyspark.sql import functions as F

from daydigest.llm import graphs
from daydigest.llm import ngram_jaccard as N

SCHEMA = "doc_id long, text string, source string, a long, n int, t long, component_id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """(doc_id, size, component) of each row, sorted."""
    sets = [shingles(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append(d[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(d[0]), len(sets[i]), str(low[find(i)])) for i, d in enumerate(docs))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w[rng.randint(0, 3) :]))
        elif kind < 0.45 and texts:
            texts.append(rng.choice(texts).upper())
        else:
            own = " ".join(rng.choices(vocabulary, k=rng.randint(1, 90)))
            texts.append(own + (" " + passage if kind > 0.8 else ""))
    return [(i, t, "s", 1, 2, 3, "c") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    docs = corpus(seed)
    out = N.jaccard_groups(spark.createDataFrame(docs, SCHEMA))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == brute(docs)


def test_the_exact_search_finds_every_link_alone(spark, monkeypatch):
    docs = corpus(3)
    none = spark.createDataFrame([], "x long, y long")
    monkeypatch.setattr(N, "quick_pairs", lambda sets: none)
    out = N.jaccard_groups(spark.createDataFrame(docs, SCHEMA))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == brute(docs)


def test_nulls_short_and_long_texts_copies_and_repeated_ids(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [
        (5, None), (6, ""), (6, " \t\r\n\x0b\x0c "), (7, "one two"), (3, "ONE  two"), (8, "one two three"), (9, "one"),
        (20, long), (21, long + " tail"), (22, long.replace("x7 ", "y ")), (22, "another text with the same id here"),
        (None, "only a null id has this text"), (None, "only a null id has this text"),
        (None, "some words that two rows share"), (30, "some words that two rows share"),
        (40, "copy of a row that repeats itself"), (40, "copy of a row that repeats itself"),
    ]
    docs += [(50, "a very hot group of equal texts")] * 30
    docs = [(i, t, None, 1, 1, 1, "x") for i, t in docs]
    table = spark.createDataFrame(docs, SCHEMA)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in N.jaccard_groups(table).collect())
    assert got == brute(docs)
    kept = N.one_of_each(table)
    assert kept.columns == table.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    ids = sorted(str(i) for i, _ in rows)
    assert ids == sorted(["5", "6", "6", "3", "8", "9", "20", "22", "None", "30", "40", "50"])
    assert N.jaccard_groups(table.limit(0)).count() == 0 and N.one_of_each(table.limit(0)).count() == 0


def test_groups_of_one_smallest_id_are_groups_of_their_own(spark):
    docs = [
        (None, "text a of null ids"), (None, "text a of null ids"), (None, "text b of null ids"), (None, "text b of null ids"),
        (5, "text c"), (6, "text c"), (5, "text d"), (7, "text d"), (8, "alone"),
    ]
    docs = [(i, t, None, 1, 1, 1, "x") for i, t in docs]
    table = spark.createDataFrame(docs, SCHEMA)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in N.jaccard_groups(table).collect()) == brute(docs)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in N.one_of_each(table).collect())
    assert kept == [
        ("5", "text c"), ("5", "text d"), ("8", "alone"), ("None", "text a of null ids"), ("None", "text b of null ids")
    ]


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, both in ((100, 120, 95), (64, 64, 64), (500, 400, 390), (3, 3, 2)):
        pool = rng.integers(0, 2**64, n + m, dtype=np.uint64)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
        sets = np.concatenate([x, y])
        *_, bits, ends = N.describe_sets(sets, np.array([0, n, n + m]))
        sx, sy = bits[ends[0] : ends[1]], bits[ends[1] : ends[2]]
        assert both <= N.overlap_bound(sx, sy, n, m) <= min(n, m)


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (1, 1), (3, 2), (10, 9), (7, 10)]
    got = {r["node"]: r["root"] for r in graphs.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 7: 7, 8: 7, 9: 7, 10: 7}
    chain = [(i, i + 1) for i in range(200)]
    roots = graphs.components(spark.createDataFrame(chain, "x long, y long")).select("root").distinct().collect()
    assert [r["root"] for r in roots] == [0]


def test_components_of_a_path_that_the_large_star_leaves_as_it_is(spark):
    links = spark.createDataFrame([(3, 4), (3, 5), (2, 4), (1, 5)], "x long, y long")
    got = sorted((r["node"], r["root"]) for r in graphs.components(links).collect())
    assert got == [(n, 1) for n in range(1, 6)]
    assert graphs.components(links.limit(0)).count() == 0


def test_components_match_union_find(spark):
    rng, links, root = random.Random(5), [], {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    # 120 paths, trees and random graphs of up to 40 nodes under shuffled labels, all in one table
    for g in range(120):
        n = rng.randint(2, 40)
        label = [1000 * g - 60_000 + x for x in rng.sample(range(1000), n)]
        if g % 3 == 0:
            links += [(label[i], label[i + 1]) for i in range(n - 1)]
        elif g % 3 == 1:
            links += [(label[i], label[rng.randrange(i)]) for i in range(1, n)]
        else:
            links += [(rng.choice(label), rng.choice(label)) for _ in range(n)]
    for x, y in links:
        if x != y:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    got = graphs.components(spark.createDataFrame(links, "x long, y long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((i, find(i)) for i in list(root))


def template_corpus(n, changed, places=None, seed=0):
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(n):
        w = list(base)
        for at in places or rng.sample(range(200), changed):
            w[at] = f"v{rng.randrange(10**9)}"
        docs.append((i, " ".join(w), "s", 1, 2, 3, "c"))
    return docs


@pytest.mark.parametrize("crowd, part", [(20, 16)])
def test_crowded_tiles_match_brute_force(spark, monkeypatch, crowd, part):
    from daydigest.llm import tile_blocks as B

    for name, value in (("CROWDED_PAIRS", crowd), ("PART_SETS", part), ("STEP_PAIRS", 50 * part), ("STEP_WORDS", 40 * part), ("REMEMBERED", part)):
        monkeypatch.setattr(B, name, value)
    docs = corpus(7, 60) + [(1000 + d[0], *d[1:]) for d in template_corpus(80, 3)]
    docs += [(2000 + d[0], *d[1:]) for d in template_corpus(40, 5, seed=1)] + [(3000 + i, t, "s", 1, 2, 3, "c") for i, t in enumerate(["short text", "short  TEXT", None])]
    out = N.jaccard_groups(spark.createDataFrame(docs, SCHEMA))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == brute(docs)


def test_linked_sets_are_of_neighbouring_bands(spark):
    sizes = spark.range(1, 30_000).select(N.size_band(F.col("id")).alias("b"), N.size_band(F.floor(F.col("id") * 100 / 75)).alias("c"), "id")
    assert sizes.filter("c - b > 1 OR c < b").count() == 0


def test_rows_of_one_template_grow_with_the_texts(spark, monkeypatch):
    rows = {}
    cut = N.cut_lineage

    def counted(df, label="table"):
        out = cut(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(N, "cut_lineage", counted)
    monkeypatch.setattr(N.tile_blocks, "cut_lineage", counted)
    found = []
    for n in (150, 300):
        rows.clear()
        docs = template_corpus(n, 4)
        out = N.jaccard_groups(spark.createDataFrame(docs, SCHEMA))
        got = sorted((str(r[0]), r[1], str(r[2])) for r in out.collect())
        found.append(dict(rows))
        if n == 150:
            assert got == brute(docs)
    for label, one in found[0].items():
        assert found[1][label] <= 2.6 * one + 100, (label, one, found[1][label])
