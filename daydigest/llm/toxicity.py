"""Toxicity by cumulative-link ordinal regression.

Grades 0 < 1 < ... of severity share one weight for each sparse feature and differ in ordered
thresholds: P(grade > k) = logistic(w . x - threshold_k). The output is the expected severity, the
sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.llm.bytes import NOT_ALNUM, span_hashes, text_chunks, word_spans
from daydigest.llm.common import anonymous, bounded_batches
from daydigest.session import cut_lineage

# Labelled rows the model is fitted on at most, taken by hash of the id; whole texts.
TRAIN_ROWS = 16_000
# Hashed features are words and beginnings of words.
BITS = 20
BEGINNINGS = (4, 5, 6)
LENGTH = 0
# Features that enter the model: those whose link with the grade is beyond chance, the
# strongest first.
MOST_FEATURES = 4096
LEAST_DOCUMENTS = 3
LEAST_LINK = 4.5
PENALTY = 2e-5
STEPS = 400


def features(flat: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None):
    """(row, feature, value): the distinct words and beginnings of words of each text, with the
    logarithm of how often they occur. Feature ``LENGTH`` is that of the text's words. With
    ``wanted`` (a mask) only those features."""
    start, end, row = word_spans(flat, offsets, NOT_ALNUM)
    hashes = span_hashes(flat)
    shift = np.uint64(64 - BITS)
    keys = [(row << BITS) | (hashes(start, end) >> shift).astype(np.int64)]
    for n in BEGINNINGS:
        long = end - start >= n
        begun = hashes(start[long], start[long] + n) * np.uint64(2 * n + 1)
        keys.append((row[long] << BITS) | (begun >> shift).astype(np.int64))
    both = np.concatenate(keys)
    low = (1 << BITS) - 1
    if wanted is not None:
        both = both[wanted[both & low]]
    both = both[(both & low) != LENGTH]
    both, n = np.unique(both, return_counts=True)
    rows = len(offsets) - 1
    size = np.log2(1.0 + np.bincount(row, minlength=rows)) - 8.0
    return (
        np.concatenate([np.arange(rows), both >> BITS]),
        np.concatenate([np.full(rows, LENGTH), both & low]),
        np.concatenate([size, np.log2(1.0 + n)]),
    )


@dataclass
class Model:
    """Shared weights by feature, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature, value = features(flat, offsets, self.weights != 0)
        return np.bincount(row, self.weights[feature] * value, minlength=len(offsets) - 1)


def fit(
    grades: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss for documents with ``grades`` (0 to K - 1)
    where feature ``columns[i]`` of document ``rows[i]`` has ``values[i]``. Full passes with adaptive steps; the
    thresholds stay ordered as they are one threshold plus positive gaps. The weight of column 0, the
    length, is never positive: more text alone is no sign, and lengths beyond those seen occur."""
    n, top = len(grades), int(grades.max())
    share = np.array([(grades > k).mean() for k in range(top)])
    weights = np.zeros(size)
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    free = np.concatenate([weights, start[:1], gaps])
    first, second = np.zeros_like(free), np.zeros_like(free)
    who = np.arange(n)
    for step in range(1, STEPS + 1):
        weights, lead, gaps = free[:size], free[size], np.exp(free[size + 1 :])
        cuts = lead + np.concatenate([[0.0], np.cumsum(gaps)])
        f = np.bincount(rows, weights[columns] * values, minlength=n)
        # P(grade > k) with the certain ends on both sides
        above = np.ones((n, top + 2))
        above[:, 1:-1] = 1.0 / (1.0 + np.exp(np.clip(cuts[None, :] - f[:, None], -60, 60)))
        above[:, -1] = 0.0
        slope = above * (1 - above)
        upper, lower = above[who, grades], above[who, grades + 1]
        inverse = 1.0 / np.maximum(upper - lower, 1e-12) / n
        by_cut = np.zeros((n, top + 2))
        by_cut[who, grades] += slope[who, grades] * inverse
        by_cut[who, grades + 1] -= slope[who, grades + 1] * inverse
        cut_gradient = by_cut[:, 1:-1].sum(axis=0)
        gradient = np.empty_like(free)
        gradient[:size] = np.bincount(columns, -by_cut.sum(axis=1)[rows] * values, minlength=size) + PENALTY * weights
        gradient[size] = cut_gradient.sum()
        gradient[size + 1 :] = gaps * cut_gradient[::-1].cumsum()[::-1][1:]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        size_of_step = 0.15 * (1 - (step - 1) / STEPS)
        free -= size_of_step * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        free[0] = min(free[0], 0.0)
    gaps = np.exp(free[size + 1 :])
    return free[:size], free[size] + np.concatenate([[0.0], np.cumsum(gaps)])


def training_rows(docs: DataFrame, graded: DataFrame, most: int) -> DataFrame:
    """(id: hash of the text, grade, text) of at most ``most`` graded documents, the first by hash of the id. ``graded``
    has doc_id and grade; null ids and grades take no part. Repeated texts count once."""
    order = F.xxhash64("doc_id")
    rows = graded.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("grade"))
    chosen = rows.filter("_id IS NOT NULL AND grade >= 0").orderBy(F.xxhash64("_id"), "_id", "grade").limit(most)
    # at most ``most`` rows of two numbers
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    met = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select("doc_id", "grade", "text")
    return met.groupBy(F.xxhash64("text").alias("id")).agg(
        F.max("grade").alias("grade"), F.min_by("text", order).alias("text")
    )


def train(docs: DataFrame, graded: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on the documents that ``graded`` (doc_id, grade) grades, at most ``most``.

    Tasks count each feature's documents and grades; only features linked with the grade reach
    the driver, and of the texts only which of these they hold. Without graded texts, or with
    one grade alone, no text is above grade 0.
    """
    bounded_batches(docs.sparkSession)
    sample = cut_lineage(training_rows(docs, graded, most), "graded")
    by_grade = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model(np.zeros(1 << BITS), np.full(1, 60.0))
    if len(by_grade) < 2:
        return nothing
    # the part of the sample above each threshold that divides it
    every = sum(by_grade.values())
    share = {k: sum(n for g, n in by_grade.items() if g > k) / every for k in range(max(by_grade))}
    share = {k: x for k, x in share.items() if 0 < x < 1}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(1 << BITS, np.int64)
        above = {k: np.zeros(1 << BITS, np.int64) for k in share}
        for batch in batches:
            grade = batch["grade"].to_numpy()
            for row, flat, offsets in text_chunks(batch["text"]):
                of, feature, _ = features(flat, offsets)
                have += np.bincount(feature, minlength=1 << BITS)
                for k, counts in above.items():
                    counts += np.bincount(feature[grade[row + of] > k], minlength=1 << BITS)
        at = np.flatnonzero(have)
        for k, counts in above.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), share[k])), pa.array(have[at]), pa.array(counts[at])],
                names=["feature", "share", "n", "above"],
            )

    counted = sample.mapInArrow(count, "feature int, share double, n long, above long")
    counted = counted.groupBy("feature", "share").agg(F.sum("n").alias("n"), F.sum("above").alias("above"))
    spread = F.col("n") * F.col("share") * (1 - F.col("share"))
    link = F.abs(F.col("above") - F.col("n") * F.col("share")) / F.sqrt(spread)
    linked = counted.filter(f"n >= {LEAST_DOCUMENTS}").groupBy("feature").agg(F.max(link).alias("link"))
    linked = linked.filter(f"link >= {LEAST_LINK}")
    strongest = linked.orderBy(F.desc("link"), "feature").limit(MOST_FEATURES).collect()
    if not strongest:
        return nothing
    chosen = np.array(sorted({LENGTH, *[r["feature"] for r in strongest]}), np.int64)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[chosen] = True
        for batch in batches:
            for row, flat, offsets in text_chunks(batch["text"]):
                of, feature, value = features(flat, offsets, wanted)
                order = np.argsort(of, kind="stable")
                n = len(offsets) - 1
                ends = np.searchsorted(of[order], np.arange(n + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(ends, np.searchsorted(chosen, feature[order]).astype(np.int32))
                values = pa.ListArray.from_arrays(ends, value[order])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, n), batch["grade"].slice(row, n), held, values],
                    names=["id", "grade", "held", "value"],
                )

    # of at most ``most`` rows; in one order, so that the fit is the same every time
    held = sample.mapInArrow(hold, "id long, grade int, held array<int>, value array<double>").toArrow().sort_by("id")
    grades = held["grade"].to_numpy().astype(np.int64)
    lists = held["held"].combine_chunks()
    columns = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(grades)), np.diff(lists.offsets.to_numpy()))
    values = held["value"].combine_chunks().flatten().to_numpy()
    weights, thresholds = fit(grades, rows, columns, values, len(chosen))
    whole = np.zeros(1 << BITS)
    whole[chosen] = weights
    return Model(whole, thresholds)


def rate(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with severity (expected grade, 0 and more) and toxic (a grade above 0 is
    more likely than not). A null or empty text has severity 0 and is not toxic."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    used = np.flatnonzero(model.weights)
    small = (used, model.weights[used], model.thresholds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[small[0]] = small[1]
        mine = Model(weights, small[2])
        for batch in batches:
            severity, toxic = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for row, flat, offsets in text_chunks(batch["text"]):
                above = mine.above(mine.scores(flat, offsets))
                there = np.diff(offsets) > 0
                to = slice(row, row + len(there))
                severity[to] = np.where(there, above.sum(axis=1), 0.0)
                toxic[to] = there & (above[:, 0] >= 0.5)
            yield pa.RecordBatch.from_arrays(
                [*[batch[f"k{i}"] for i in range(len(keep))], pa.array(severity), pa.array(toxic)],
                names=[*[f"k{i}" for i in range(len(keep))], "severity", "toxic"],
            )

    out = rows.mapInArrow(score, (schema + ", " if keep else "") + "severity double, toxic boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "severity", "toxic")


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades of the given labels, which know two: 0 not toxic, 1 toxic. (Their quality is no
    degree of toxicity: as a third grade it made the fit worse.)"""
    return labels.select("doc_id", F.when(F.col("toxic").isin(0, 1), F.col("toxic")).alias("grade"))


def toxicity(docs: DataFrame, graded: DataFrame) -> DataFrame:
    """doc_id, severity, toxic for each document, learned from ``graded`` (doc_id, grade). Repeated rows give equal rows, an empty table
    none; other columns are ignored."""
    return rate(docs, train(docs, graded), ["doc_id"])


def without_toxic(docs: DataFrame, graded: DataFrame) -> DataFrame:
    """``docs`` without the documents rated toxic; columns and other rows as they are."""
    plain, at = anonymous(docs)
    rated = rate(plain.withColumn("text", F.col(at["text"])), train(docs, graded), plain.columns)
    return rated.filter(~F.col("toxic")).select(*plain.columns).toDF(*docs.columns)
