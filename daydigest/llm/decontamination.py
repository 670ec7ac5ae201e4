"""Benchmark decontamination by a broadcast hash set of n-grams. Only DataFrame functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.llm.common import anonymous, broadcast_if_small
from daydigest.session import BROADCAST_BYTES, cut_lineage

WINDOW = 10
# Everything ASCII but digits and lower-case letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Key of the row that stands for a document as such; windows have keys from hashes of their words.
WHOLE = 0


def words(text: Column) -> Column:
    """The normalised words of a text; a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def key_of(at, length: int) -> Column:
    """64-bit hash of ``length`` words, given by ``at(offset)``."""
    return F.xxhash64(F.lit(length), *[at(i) for i in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The set of test n-grams: key, length, gram, item_id. An item of fewer words is one
    window, an item without words none; repeated windows of an item count once."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    grams = items.select(
        "item_id",
        length.alias("length"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length)
            )
        ).alias("gram"),
    ).distinct()
    key = F.coalesce(
        *[
            F.when(F.col("length") == n, key_of(lambda i: F.get(F.col("gram"), F.lit(i)), n))
            for n in range(1, window + 1)
        ]
    )
    return grams.withColumn("key", key)


def scan_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """All windows of every document: doc_id, digest, words, at, key, and one row with ``at``
    null for the document as such."""
    spread = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    # position -1 is the document as such
    rows = spread.withColumn("at", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)))

    def key(n: int) -> Column:
        here = key_of(lambda i: F.get(F.col("words"), F.col("at") + i), n)
        return F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("words")), here)

    whole = F.when(F.col("at") < 0, F.lit(WHOLE).cast("long"))
    if len(lengths) == 1:
        return rows.withColumn("key", F.coalesce(whole, key(lengths[0])))
    keys = F.when(F.col("at") < 0, F.array(whole)).otherwise(F.array(*[key(n) for n in lengths]))
    return rows.withColumn("key", F.explode(keys))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of documents that stand inside a test n-gram, a row for each document: doc_id,
    digest (hash of the text), copies, n_words, spans (sorted (at, length)), items.

    One scan of the texts. A hash of each window is looked up in the broadcast set, and the
    words themselves are compared where it is found. A document's rows meet by doc_id and
    hash of the text, so that repeated rows are counted (``copies``) and a repeated id with
    another text stays apart. The set is broadcast only if its size is small; above the limit
    see ``shuffled_hits``.
    """
    grams = benchmark_windows(benchmark, window)
    facts = grams.groupBy("length").agg(F.sum(F.octet_length(F.to_json("gram")) + 48).alias("bytes")).collect()
    lengths = sorted(r["length"] for r in facts)
    small = sum(r["bytes"] for r in facts) <= BROADCAST_BYTES
    rows = scan_windows(docs, lengths)
    none = F.array().cast("array<string>")
    test = grams.select(F.col("key").alias("test_key"), "length", "gram", "item_id")
    same = (F.col("key") == F.col("test_key")) & (
        (F.col("length") == 0) | (F.slice("words", F.greatest("at", F.lit(0)) + 1, F.col("length")) == F.col("gram"))
    )
    kept = ["doc_id", "digest", F.size("words").alias("n_words"), "at", "length", "item_id"]
    if small:
        # a row of the set that every document meets, so that one pass gives documents and hits
        whole = test.sparkSession.range(1).select(
            F.lit(WHOLE).cast("long").alias("test_key"),
            F.lit(0).alias("length"),
            none.alias("gram"),
            F.lit(None).cast(test.schema["item_id"].dataType).alias("item_id"),
        )
        met = rows.join(F.broadcast(test.union(whole)), same).select(*kept)
    else:
        hits = shuffled_hits(rows, docs, test)
        whole = rows.filter("at < 0").select(
            "doc_id",
            "digest",
            F.size("words").alias("n_words"),
            "at",
            F.lit(0).alias("length"),
            F.lit(None).cast(test.schema["item_id"].dataType).alias("item_id"),
        )
        met = hits.union(whole)
    hit = F.col("length") > 0
    return met.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(~hit).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("at", "length")))).alias("spans"),
        F.collect_set(F.when(hit, F.col("item_id").cast("string"))).alias("items"),
    )


def shuffled_hits(rows: DataFrame, docs: DataFrame, test: DataFrame) -> DataFrame:
    """``find_hits`` for a set too large to broadcast whole: doc_id, digest, n_words, at, length, item_id.

    First the keys alone decide where a window may be: they are sent out while they are few, and else
    the windows are shuffled as numbers, without words. Then the texts with such a place are split
    again, and the words at these places are compared with the set.
    """
    keys = cut_lineage(test.select("test_key").distinct(), "test-keys")
    place = rows.filter("at >= 0 AND key IS NOT NULL").select("doc_id", "digest", "at", "key")
    met = place.join(broadcast_if_small(keys, 48), F.col("key") == F.col("test_key"), "left_semi")
    # repeated rows give their places once
    places = cut_lineage(met.select("doc_id", "digest", "at", "key").distinct(), "places")
    with_hits = cut_lineage(places.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "met")
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    texts = texts.join(broadcast_if_small(with_hits, 32), same, "left_semi")
    # one text of an id and digest
    texts = texts.groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    at = places.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.struct("at", "key").alias("place"))
    at = at.groupBy("_id", "_digest").agg(F.collect_list("place").alias("places"))
    split = texts.join(at, same).select("doc_id", "digest", words(F.col("text")).alias("words"), "places")
    longest = test.agg(F.coalesce(F.max("length"), F.lit(1))).first()[0]
    own = split.select("doc_id", "digest", F.size("words").alias("n_words"), "words", F.explode("places").alias("place"))
    own = own.select(
        "doc_id",
        "digest",
        "n_words",
        F.col("place.at").alias("at"),
        F.col("place.key").alias("key"),
        F.slice("words", F.col("place.at") + 1, longest).alias("own"),
    )
    equal = (F.col("key") == F.col("test_key")) & (F.slice("own", 1, F.col("length")) == F.col("gram"))
    return own.join(test, equal).select("doc_id", "digest", "n_words", "at", "length", "item_id")


def covered(spans: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, span):
        end = F.greatest(acc["end"], span["at"] + span["length"])
        new = end - F.greatest(acc["end"], F.least(span["at"], end))
        return F.struct((acc["n"] + new).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each document.

    Null and empty texts have no words and no hits; repeated rows give a row each; an empty
    benchmark hits nothing; other columns are ignored.
    """
    items = F.array_join(F.array_sort("items"), ",")
    found = find_hits(docs, benchmark, window).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        "copies",
    )
    each = found.withColumn("contaminated", F.col("n_hit") > 0)
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_copy", "copies")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a test n-gram; columns and other rows as they are."""
    bad = find_hits(docs, benchmark, window).filter(F.size("spans") > 0)
    # ids and hashes alone, sent to the texts while they are few
    bad = cut_lineage(bad.select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")), "contaminated")
    bad = broadcast_if_small(bad, 32)
    plain, at = anonymous(docs)
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(at["text"]) == F.col("_bad_digest"))
    return plain.join(bad, same, "left_anti").toDF(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of test n-grams cut out of ``text``. In a document with hits the
    raw runs of word characters inside a hit go, together with the separators behind them; all
    other text stays byte by byte. Documents without hits are unchanged."""
    bad = find_hits(docs, benchmark, window).filter(F.size("spans") > 0)
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    plain, at = anonymous(docs)
    text = F.col(at["text"])
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_digest"))
    raw = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    tail = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(text, f"^{tail}", 0)
    runs = F.regexp_extract_all(text, F.lit(f"({raw}{tail})"), F.lit(1))
    hit = F.array_distinct(
        F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    )
    # the hit positions go as an array of runs to blank, matched by position
    cut = F.concat(lead, F.array_join(F.transform(runs, lambda r, i: F.when(F.array_contains(hit, i), "").otherwise(r)), ""))
    joined = plain.join(bad, same, "left")
    shown = joined.withColumn(at["text"], F.when(F.col("_spans").isNotNull(), cut).otherwise(text))
    return shown.select(*plain.columns).toDF(*docs.columns)
