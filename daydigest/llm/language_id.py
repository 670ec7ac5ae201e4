"""Language identification by prediction by partial matching.

For each language the training texts give a tree of byte contexts of up to ``max_order`` bytes.
Its statistics are frozen, and the code length of a byte in its context is a fixed number: the
longest known context that has seen the byte pays for it, each longer known context pays for an
escape. The language whose tree codes a text in the fewest bits is its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.llm.bytes import text_chunks
from daydigest.llm.common import bounded_batches

MAX_ORDER = 3
# About so many different training texts of each language, taken by hash of the text; whole texts.
TRAIN_TEXTS = 1500
# Code lengths are whole multiples of 1/2048 bit, so that sums are exact in any order.
UNIT = 2048
UNKNOWN = "und"
# Positions that are looked up at once.
STEP = 1 << 18


def grams(flat: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For each context length from 0 to ``order``: the byte with its context, as one number.
    What stands before a text are zero bytes."""
    current = flat.astype(np.uint64)
    found, value, n = [current], current, len(flat)
    heads = offsets[:-1]
    for back in range(1, order + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[back:] = current[:-back] if back < n else 0
        for i in range(back):
            at = heads + i  # beyond a short text this is the start of a later one
            shifted[at[at < n]] = 0
        value = value | (shifted << np.uint64(8 * back))
        found.append(value)
    return found


class Model:
    """Frozen trees of all languages. ``tables[k]`` has the sorted grams of context length k seen
    in any language with the code length in each language; ``escapes[k]`` the sorted contexts
    of k bytes with the length of an escape from each (0 where a language does not know it)."""

    def __init__(self, languages: list[str], counts: np.ndarray | list[tuple[int, int, int, int]], max_order: int):
        """``counts``: rows of (language number, context length, gram, count)."""
        self.languages, self.max_order = languages, max_order
        size = len(languages)
        by = np.array(counts, dtype=np.uint64).reshape(-1, 4)
        # order -1: any byte, evenly
        floor = np.full(size, 8 * UNIT, np.int32)
        self.tables, self.escapes = [], []
        for k in range(max_order + 1):
            here = by[by[:, 1] == k]
            keys, at = np.unique(here[:, 2], return_inverse=True)
            seen = np.zeros((len(keys), size))
            seen[at, here[:, 0].astype(int)] = here[:, 3]
            contexts, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, parent, seen)
            np.add.at(kinds, parent, seen > 0)
            whole = np.maximum(total + kinds, 1)
            with np.errstate(divide="ignore"):
                own = np.rint(-np.log2(seen / whole[parent]) * UNIT)
                escape = np.where(total > 0, np.rint(-np.log2(np.maximum(kinds, 1) / whole) * UNIT), 0).astype(np.int32)
            # k bytes of context lie above the byte: a known context has its own lowest bytes
            shorter = self._cost(k - 1, keys & np.uint64((1 << (8 * k)) - 1)) if k else np.tile(floor, (len(keys), 1))
            cost = np.where(seen > 0, own, escape[parent] + shorter).astype(np.int32)
            self.escapes.append((contexts, escape))
            self.tables.append((keys, cost))
        self.floor = floor

    def _cost(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """Code lengths of grams of context length ``k``, a row each."""
        if k < 0:
            return np.tile(np.full(len(self.languages), 8 * UNIT, np.int32), (len(wanted), 1))
        keys, cost = self.tables[k]
        if not len(keys):
            return self._cost(k - 1, wanted & np.uint64((1 << (8 * max(k, 0))) - 1))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = cost[at]
        lost = np.flatnonzero(keys[at] != wanted)
        if len(lost):
            rest = wanted[lost]
            contexts, escape = self.escapes[k]
            at = np.minimum(np.searchsorted(contexts, rest >> np.uint64(8)), len(contexts) - 1)
            paid = np.where((contexts[at] == rest >> np.uint64(8))[:, None], escape[at], 0)
            out[lost] = paid + self._cost(k - 1, rest & np.uint64((1 << (8 * k)) - 1))
        return out

    def lengths(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length (in units) of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        if not len(flat):
            return out
        values = grams(flat, offsets, self.max_order)[-1]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for i in range(0, len(values), STEP):
            cost = self._cost(self.max_order, values[i : i + STEP])
            rows = row[i : i + STEP]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[rows[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.int64)
        return out


def count_grams(batches: Iterator[pa.RecordBatch], max_order: int) -> Iterator[pa.RecordBatch]:
    """Counts of grams of a task's training texts, by language."""
    totals: dict[tuple[str, int], list[np.ndarray]] = {}
    for batch in batches:
        lang = np.array(batch["lang"].to_pylist(), object)
        for row, flat, offsets in text_chunks(batch["text"]):
            of = np.repeat(lang[row : row + len(offsets) - 1], np.diff(offsets))
            values = grams(flat, offsets, max_order)
            for name in set(of):
                mine = of == name
                for k, v in enumerate(values):
                    keys, n = np.unique(v[mine], return_counts=True)
                    old = totals.get((name, k))
                    if old is not None:
                        keys, at = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([old[1], n])).astype(np.int64)
                    totals[name, k] = [keys, n]
    for (name, k), (keys, n) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
            names=["lang", "k", "gram", "n"],
        )


def train(docs: DataFrame, max_order: int = MAX_ORDER, train_texts: int = TRAIN_TEXTS) -> Model:
    """Fit on about ``train_texts`` distinct texts of each language, chosen by hash of the text, however
    often each occurs; the rows of ``docs`` (text, lang) with a null or empty text or a null lang take no
    part. The gram counts that reach the driver are bounded by the sample, not by the corpus."""
    if not 0 <= max_order <= 6:
        raise ValueError("max_order must be from 0 to 6")
    bounded_batches(docs.sparkSession)
    known = docs.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    known = known.withColumn("hash", F.xxhash64("text"))
    # about how many different texts there are; a task keeps a sketch of each language
    kinds = known.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).toArrow().to_pydict()
    have = dict(zip(kinds["lang"], kinds["n"]))
    if not have:
        return Model([], [], max_order)
    share = F.create_map(*[F.lit(x) for lang, n in have.items() for x in (lang, min(1.0, train_texts / n))])
    chance = F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53))
    # copies are counted out before the shuffle
    sample = known.filter(chance < F.element_at(share, F.col("lang"))).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    counts = (
        sample.select("lang", "text")
        .mapInArrow(lambda b: count_grams(b, max_order), "lang string, k int, gram long, n long")
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(have)
    number = pa.array(languages, pa.string())
    rows = np.column_stack([
        pc.index_in(counts["lang"].combine_chunks(), number).to_numpy(zero_copy_only=False),
        counts["k"].to_numpy(),
        counts["gram"].to_numpy(),
        counts["n"].to_numpy(),
    ])
    return Model(languages, rows, max_order)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score, from ``text`` alone.

    ``score`` is the share of the best language in the sum of all languages' probabilities of
    the text. Equal lengths go to the first language by name. A null text, a text without a
    letter and, where nothing was learned, every text is ``und`` with score 0.
    """
    rows = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        "text",
        has_letter(F.col("text")).alias("letter"),
    )
    kept = rows.schema.fields[: len(keep)]
    schema = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, UNKNOWN, object)
            sure = np.zeros(batch.num_rows)
            letter = batch["letter"].to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                names = np.array(model.languages, object)
                for row, flat, offsets in text_chunks(batch["text"]):
                    bits = model.lengths(flat, offsets)
                    pick = bits.argmin(axis=1)
                    gap = (bits - bits.min(axis=1, keepdims=True)) / UNIT
                    to = slice(row, row + len(bits))
                    mine = letter[to]
                    best[to] = np.where(mine, names[pick], UNKNOWN)
                    sure[to] = np.where(mine, 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch[f"k{i}"] for i in range(len(keep))], pa.array(best, pa.string()), pa.array(sure)],
                names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"],
            )

    out = rows.mapInArrow(score, (schema + ", " if keep else "") + "lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, max_order: int = MAX_ORDER, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document; learned from the documents that are
    not held out. Repeated rows give equal rows, an empty table none; other columns are ignored."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), max_order, train_texts)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
