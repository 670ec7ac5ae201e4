"""Quality by importance resampling.

Two generative models of hashed words and word pairs, one of target texts and one of the raw corpus,
give each document the logarithm of the ratio of its probabilities. Gumbel noise on top makes the k
highest keys a sample without replacement in proportion to that ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daydigest.llm.bytes import NOT_ALNUM, mix64, text_chunks, words_of
from daydigest.llm.common import bounded_batches
from daydigest.session import cut_lineage

# Buckets of the hashed words and pairs, of one model.
BUCKETS = 10_000
# Labelled texts the target model counts at most, the first by hash of the id; whole texts.
TARGET_ROWS = 20_000
# The part of all documents that the sample holds.
FRACTION = 0.1


def buckets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words of a text."""
    words, row = words_of(flat, offsets, NOT_ALNUM)
    same = row[1:] == row[:-1]
    pairs = mix64(words[:-1] * np.uint64(3) + words[1:])[same]
    both = np.concatenate([words, pairs]) % np.uint64(BUCKETS)
    return np.concatenate([row, row[1:][same]]), both.astype(np.int64)


def bucket_counts(texts: DataFrame, flag: str) -> DataFrame:
    """bucket, n, target: n-grams of all texts in each bucket, and of those where ``flag`` holds.
    One pass; each task sends at most one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marked = batch[flag].to_numpy(zero_copy_only=False).astype(bool)
            for row, flat, offsets in text_chunks(batch["text"]):
                of, bucket = buckets(flat, offsets)
                every += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[marked[row + of]], minlength=BUCKETS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(every[at]), pa.array(target[at])], names=["bucket", "n", "target"]
        )

    counted = texts.select("text", flag).mapInArrow(count, "bucket int, n long, target long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, good: DataFrame, most: int = TARGET_ROWS) -> np.ndarray:
    """For each bucket the logarithm of its probability in the target over that in the corpus, both
    with one added to every count. The raw counts are those of all texts; target texts are those
    of at most ``most`` ids of ``good`` (doc_id). Without target texts every ratio is 0."""
    ids = good.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct()
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    # at most ``most`` numbers
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left")
    rows = bucket_counts(marked.select("text", F.col("_id").isNotNull().alias("target")), "target").collect()
    every, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        every[r["bucket"]] += r["n"]
        target[r["bucket"]] += r["target"]
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(every / every.sum())


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise that depends on ``key`` and ``seed`` alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_ratio, n_grams; a text without words has the ratio 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for row, flat, offsets in text_chunks(batch["text"]):
                of, bucket = buckets(flat, offsets)
                size = len(offsets) - 1
                total[row : row + size] = np.bincount(of, ratios[bucket], minlength=size)
                n[row : row + size] = np.bincount(of, minlength=size)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(total), pa.array(n)], names=["doc_id", "log_ratio", "n_grams"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(add, f"doc_id {kind}, log_ratio double, n_grams long")


def top_cut(scored: DataFrame, column: str, k: int) -> tuple[float | None, int]:
    """The ``k``-th highest value of ``column`` and how many rows are above it, exactly.

    A sketch gives a range that holds the value; the rows above the range are counted, and the
    range is narrowed by counts until few distinct values are left. Nothing but counts and at
    most a few thousand values leaves the tasks.
    """
    low, high = scored.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None, 0
    above, inside = 0, scored.count()
    steps = 1024
    # invariant: the value lies in [low, high], ``above`` rows lie over high
    while True:
        here = scored.filter(F.col(column).between(low, high))
        if inside <= 4096 or low == high:
            values = here.groupBy(column).count().orderBy(F.desc(column)).collect()
            for value, n in values:
                if above + n >= k:
                    return value, above
                above += n
            return low, above
        width = (high - low) / steps
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(steps - 1))
        parts = (
            here.groupBy(place.alias("p"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("p"))
            .collect()
        )
        for part in parts:
            if above + part["n"] >= k:
                low, high, inside = part["low"], part["high"], part["n"]
                break
            above += part["n"]


def resample(
    docs: DataFrame, good: DataFrame, fraction: float = FRACTION, seed: int = 0, most: int = TARGET_ROWS
) -> DataFrame:
    """doc_id, log_ratio, n_grams, gumbel_key, selected; a row for each document.

    ``selected`` marks the ceil(fraction * rows) documents of highest key (log_ratio plus noise of the
    id); equal keys go by doc_id, then by n_grams, and rows equal in all of these are selected in
    any order but in the right number. Null ids get noise too; an empty table gives no rows; other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = score(docs, log_ratios(docs, good, most))
    scored = cut_lineage(rows.withColumn("gumbel_key", F.col("log_ratio") + gumbel(F.col("doc_id"), seed)), "scores")
    total = scored.count()
    k = -(-int(total * round(fraction * 1_000_000)) // 1_000_000)
    cut, above = top_cut(scored, "gumbel_key", k)
    if cut is None:
        return scored.withColumn("selected", F.lit(False))
    tied = scored.filter(F.col("gumbel_key") == F.lit(cut))
    rest = scored.filter(F.col("gumbel_key") != F.lit(cut)).withColumn("selected", F.col("gumbel_key") > F.lit(cut))
    if tied.count() == 1:
        return scored.withColumn("selected", F.col("gumbel_key") >= F.lit(cut))
    # rows of one key: one id and its copies, unless keys of several ids meet by chance
    counted = tied.groupBy("doc_id", "log_ratio", "n_grams", "gumbel_key").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("gumbel_key").orderBy("doc_id", "n_grams", "log_ratio")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_before", before).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    )
    ends = placed.withColumn("selected", F.col("_before") + F.col("_copy") <= k - above)
    return rest.unionByName(ends.drop("_before", "_copy", "copies"))
