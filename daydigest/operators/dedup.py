"""Near duplicates of texts: shingles, minimum-hash signatures, buckets of signature bands, and groups.

The first three are made in the row or the batch, so texts are never shuffled; the bucket table lists members, never
pairs, and the groups come from links between a bucket's members and its representative, checked on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.session import cut_lineage

SHINGLE_WORDS = 5
# Signatures of 16 bands of 4: of pairs of similarity s 1 - (1 - s^4)^16 share a bucket, 0.998 at 0.75.
BANDS, BAND_ROWS = 16, 4
# Documents are near duplicates if they share so many percent of their shingles together.
PERCENT = 75
# A prime above 2^32, the range of the shingle hashes.
PRIME = 4294967311


def shingles(text: Column | str, words: int = SHINGLE_WORDS) -> Column:
    """The distinct runs of ``words`` terms; of fewer terms the whole text, of none no shingle."""

    def of(terms: Column) -> Column:
        n = F.size(terms)
        runs = F.transform(
            F.sequence(F.lit(1), F.greatest(n - words + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(terms, i, words), " "),
        )
        return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return T.bound(F.coalesce(T.tokens(text), F.array().cast("array<string>")), of)


def hashed(listed: Column) -> Column:
    """32 bits of the MD5 of each shingle."""
    return F.transform(listed, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long"))


def seeds(n: int) -> list[tuple[int, int]]:
    """Factor and summand of each hash function, from a fixed generator."""
    state, out = 12345, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            state = (state * 1103515245 + 12345) % (1 << 31)
            pair.append(state >> 1 | 1)
        out.append(tuple(pair))
    return out


def minima(hashes: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists that hold something, and for each of them, under each of ``n`` hash functions, the minimum."""
    length = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(length)
    flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    starts = (np.cumsum(length) - length)[some]
    out = np.zeros((len(some), n), np.int64)
    for k, (a, b) in enumerate(seeds(n)) if len(some) else ():
        out[:, k] = np.minimum.reduceat((flat * np.uint64(a) + np.uint64(b)) % np.uint64(PRIME), starts)
    return some, out


def with_signature(docs: DataFrame, n: int = BANDS * BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, signature of each document: under each of ``n`` hash functions the minimum over all
    shingles, null without shingles. A batch is worked on at once."""
    listed = docs.select("doc_id", hashed(shingles("text")).alias("hashes"))
    kind = listed.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch["hashes"]
            some, values = minima(hashes, n)
            have = np.zeros(len(batch), bool)
            have[some] = True
            ends = np.concatenate([[0], np.cumsum(have) * n]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~have))
            counts = hashes.value_lengths().fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, lists], names=["doc_id", "n_shingles", "signature"])

    return listed.mapInArrow(work, f"doc_id {kind}, n_shingles long, signature array<long>")


def banded(signed: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, band, bucket (hash of the band's minima) of each document with shingles."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.md5(F.array_join(F.slice("signature", i * rows + 1, rows).cast("array<string>"), ",").cast("binary")),
    )
    return signed.filter("signature IS NOT NULL").select("doc_id", F.posexplode(parts).alias("band", "bucket"))


def band_buckets(signed: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, band, bucket, size (documents in the bucket). The buckets are written once; sizes are counted on the
    map side first and joined back, however many documents share a bucket."""
    listed = cut_lineage(banded(signed, bands, rows), "bands")
    sizes = listed.groupBy("band", "bucket").agg(F.count("*").alias("size"))
    return listed.join(sizes, ["band", "bucket"]).select("doc_id", "band", "bucket", "size")


def near_links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y): documents whose sets of shingles are alike by ``percent`` or more, among those that a bucket offers: each
    of its documents beside its representative, the smallest id. A document is offered once a band at most, however
    large its buckets are, and every offer is checked on the whole sets."""
    sets = docs.filter("doc_id IS NOT NULL").select("doc_id", hashed(shingles("text")).alias("hashes"))
    sets = cut_lineage(sets.filter(F.size("hashes") > 0), "shingle-sets")
    kind = sets.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = minima(batch["hashes"], BANDS * BAND_ROWS)[1].reshape(-1)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * (BANDS * BAND_ROWS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "signature"])

    listed = cut_lineage(banded(sets.mapInArrow(sign, f"doc_id {kind}, signature array<long>")), "bands")
    first = listed.groupBy("band", "bucket").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("last"))
    shared = first.filter("x <> last").select("band", "bucket", "x")
    offers = listed.join(shared, ["band", "bucket"]).filter("doc_id <> x")
    offers = cut_lineage(offers.select("x", F.col("doc_id").alias("y")).distinct(), "offers")
    met = offers.join(sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("p")), "x")
    met = met.join(sets.select(F.col("doc_id").alias("y"), F.col("hashes").alias("q")), "y")
    both = F.size(F.array_intersect("p", "q"))
    alike = both * 100 >= (F.size("p") + F.size("q") - both) * percent
    return met.filter(alike).select("x", "y").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document that a link (x, y) names: the smallest id that links reach. In each round a
    document takes the smallest group of its neighbours, and then the group of that group; the rounds end when no
    group changes."""
    both = links.select("x", "y").union(links.select("y", "x")).toDF("doc_id", "beside").distinct()
    both = cut_lineage(both, "links")
    found = cut_lineage(both.groupBy("doc_id").agg(F.least("doc_id", F.min("beside")).alias("group_id")), "groups")
    while True:
        near = both.join(found.withColumnRenamed("doc_id", "beside"), "beside").groupBy("doc_id").agg(F.min("group_id").alias("g"))
        taken = found.join(near, "doc_id").withColumn("new", F.least("group_id", "g"))
        ahead = found.select(F.col("doc_id").alias("new"), F.col("group_id").alias("next"))
        moved = taken.join(ahead, "new").select("doc_id", F.least("new", "next").alias("new"), "group_id")
        moved = cut_lineage(moved, "groups")
        done = not moved.filter("new <> group_id").limit(1).count()
        found = moved.select("doc_id", F.col("new").alias("group_id"))
        if done:
            return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, group_id, size): each document with the smallest id of its near duplicates and how many they are; one that
    is like no other is its own group. A null id or a text without terms is in no group and has no row; rows of equal
    id are one document."""
    groups = connected(near_links(docs, percent))
    every = docs.filter(F.size(T.tokens("text")) > 0).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    named = every.join(groups, "doc_id", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    named = cut_lineage(named, "near-duplicates")
    sizes = named.groupBy("group_id").agg(F.count("*").alias("size"))
    return named.join(sizes, "group_id").select("doc_id", "group_id", "size")
