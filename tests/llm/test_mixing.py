import heapq
import random
from collections import Counter

import pytest

from daydigest.llm import mixing as M

DOCS = "doc_id long, text string, source string, units int, slot string, quota int"


def rows(sizes):
    return [(i, f"{s} {i}", s, 1, "x", 1) for s, n in sizes.items() for i in range(n)]


def plain_schedule(units, period):
    done, picks = Counter(), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // u), s or "") for s, u in units.items() if done[s] < u and done[s] * period // u <= t]
        picks.append(min(ready)[1])
        done[picks[-1]] += 1
    return picks


@pytest.mark.parametrize("units", [{"a": 50, "b": 30, "c": 20}, {"a": 97, "b": 1, "c": 2}, {"a": 34, "b": 33, "c": 33}])
def test_schedule_is_earliest_deadline_first_and_never_a_block_off(spark, units):
    table = spark.createDataFrame(list(units.items()), "source string, units long")
    slots = sorted(M.schedule(table, 100).collect())
    assert [r["source"] for r in slots] == plain_schedule(units, 100)
    done = Counter()
    for t, r in enumerate(slots, 1):
        assert r["turn"] == done[r["source"]]
        done[r["source"]] += 1
        assert all(abs(done[s] - t * u / 100) < 1 for s, u in units.items())


def heap_schedule(units, period):
    """plain_schedule for many sources: slot, source, turn."""
    blocks = [(j * period // u, -(-(j + 1) * period // u), s or "", j) for s, u in units.items() for j in range(u)]
    blocks.sort(reverse=True)
    ready, picks = [], []
    for t in range(period):
        while blocks and blocks[-1][0] <= t:
            heapq.heappush(ready, blocks.pop()[1:])
        _, s, j = heapq.heappop(ready)
        picks.append((t, s, j))
    return picks


@pytest.mark.parametrize("n, period", [(3, 100), (90, 1000)])
def test_schedule_from_rows_is_earliest_deadline_first(spark, n, period):
    rng = random.Random(n)
    cuts = [0, *sorted(rng.sample(range(1, period), n - 1)), period]
    names = [None, *(f"s{i:03}" for i in rng.sample(range(1000), n - 1))]
    units = {s: b - a for s, a, b in zip(names, cuts, cuts[1:])}
    table = spark.createDataFrame(list(units.items()), "source string, units long")
    got = sorted((r["slot"], r["source"] or "", r["turn"]) for r in M.schedule_rows(table, period).collect())
    assert got == heap_schedule(units, period)
    assert [s for _, s, _ in got] == plain_schedule({s or "": u for s, u in units.items()}, period)


def test_more_than_5000_sources(spark):
    docs = spark.createDataFrame([(i, f"t {i}", f"site{i % 5001}", 1, "x", 1) for i in range(5100)], DOCS)
    out = M.mix(docs, block_rows=1).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(5100)) and len({r["slot"] for r in out}) == 5100
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)


def test_every_document_is_placed_within_its_window(spark):
    docs = spark.createDataFrame(rows({"big": 900, "b": 200, "c": 210, None: 190, "tiny": 1}), DOCS)
    out = M.mix(docs, period=100, block_rows=10).collect()
    assert len(out) == 1501
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    blocks = Counter((r["source"], r["block"]) for r in out)
    assert max(blocks.values()) <= 10 and len({(r["slot"]) for r in out}) == len(blocks)
    kept = Counter(r["source"] for r in out if r["in_mix"])
    assert kept["tiny"] == 1 and kept[None] == 190 and kept["b"] > 180 and 190 < kept["big"] < 900
    chosen = M.mixed_documents(docs, period=100, block_rows=10)
    assert chosen.columns == docs.columns
    assert Counter((r["source"], r["doc_id"]) for r in chosen.collect()) == Counter(
        (r["source"], r["doc_id"]) for r in out if r["in_mix"]
    )


@pytest.mark.parametrize("exponent", [0, 0.75, 1.0])
def test_a_mixture_to_the_last_source_leaves_nothing_out(spark, exponent):
    docs = spark.createDataFrame(rows({"hot": 700, "b": 20, "c": 210, None: 19, "tiny": 1}), DOCS)
    how = {"period": 100, "block_rows": 10, "exponent": exponent}
    out = M.mix(docs, end=1.0, **how).collect()
    assert len(out) == 950 and all(r["in_mix"] for r in out)
    assert sorted(r["doc_id"] for r in M.mixed_documents(docs, end=1.0, **how).collect()) == sorted(r["doc_id"] for r in docs.collect())
    kept = [M.mixed_documents(docs, end=share, **how).count() for share in (0.1, 0.5, 0.9, 1.0)]
    assert kept == sorted(kept)
    if exponent == 0:
        assert len({r["units"] for r in M.target_units(M.source_counts(docs), 100, 0).collect()}) == 1
    with pytest.raises(ValueError):
        M.mix(docs, end=0.0)


def test_weights_given_nulls_copies_and_empty_tables(spark):
    some = [(1, "t", "a", 1, "x", 1)] * 25 + [(None, None, "a", 1, "x", 1), (2, "", None, 1, "x", 1), (2, "x" * 99_999, "b", 1, "x", 1)]
    docs = spark.createDataFrame(some, DOCS)
    weights = spark.createDataFrame([("a", 2), ("b", 1), (None, 1)], "source string, units long")
    out = M.mix(docs, weights, period=4, block_rows=5).collect()
    assert len(out) == len(some)
    assert sorted((r["block"], r["row_in_block"]) for r in out if r["source"] == "a") == [(i // 5, i % 5) for i in range(26)]
    assert M.mixed_documents(docs, weights, period=4, block_rows=5).count() >= 3
    empty = docs.limit(0)
    assert M.mix(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, weights, period=5)


def test_units_are_tempered_shares(spark):
    counts = spark.createDataFrame([("a", 10_000), ("b", 100), (None, 1)], "source string, rows long")
    units = {r["source"]: r["units"] for r in M.target_units(counts, 100).collect()}
    assert sum(units.values()) == 100 and units[None] >= 1
    assert units["a"] < 97 and units["b"] > 2
