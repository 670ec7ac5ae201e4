"""Token vectors learned from the texts themselves, by random indexing.

Every word has a fixed vector of signs drawn by its hash. The vector of a word is the sum, over all places where
it stands, of the sign vectors of its neighbours and its own: words with like neighbours get
like vectors. All entries are whole numbers, so the sums are the same however the texts are dealt out. The
tokens of a text are its distinct terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.session import checked_small_side, cut_lineage

DIMS = 32
# Neighbours to either side.
WINDOW = 2
# Bytes of texts that are summed up at once.
SUMMED_BYTES = 1 << 23


def signs_of(words: list[str]) -> np.ndarray:
    """A row of 1 and -1 for each word: the bits of the first four bytes of its MD5 sum."""
    codes = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:4] for w in words), ">u4").astype(np.int64)
    return 1 - 2 * (codes[:, None] >> np.arange(DIMS) & 1)


def neighbour_sums(codes: np.ndarray, row: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each dimension (rows) and each word (columns) the sum of the signs around the word's places. ``codes`` are the
    words of several texts in order, each of them there, ``row`` their texts, counted from 0.

    Texts stand with ``WINDOW`` places without a sign between them, so no neighbour is one of another text. Two dimensions
    are summed in one number: the low half is the one, and what is left of it the other."""
    known = len(signs)
    places = np.arange(len(codes)) + WINDOW * (row + 1)
    line = np.full(places[-1] + 1 + WINDOW, known)
    line[places] = codes
    # numbers of word and place sort faster than words with their places
    ordered = np.sort(codes << 32 | places - WINDOW)
    begins = np.searchsorted(ordered, np.arange(known) << 32)
    places = ordered & 0xFFFFFFFF
    two = np.zeros((DIMS // 2, known + 1), np.int64)
    two[:, :known] = (signs[:, ::2] + (signs[:, 1::2] << 32)).T
    out = np.empty((DIMS, known), np.int64)
    for k, of_word in enumerate(two):
        at = of_word.take(line)
        around = at[WINDOW:-WINDOW].copy()
        for apart in range(1, WINDOW + 1):
            around += at[WINDOW - apart : len(at) - WINDOW - apart]
            around += at[WINDOW + apart : len(at) - WINDOW + apart]
        both = np.add.reduceat(around.take(places), begins)
        out[2 * k] = both.astype(np.int32)
        out[2 * k + 1] = (both - out[2 * k]) >> 32
    return out


def word_vectors(texts: DataFrame, stop_words=T.STOP_WORDS) -> DataFrame:
    """word, vector (array of long) of every term of ``texts`` (text; null texts have none), written once. Terms are
    those of the index, without stop words. Texts of about ``SUMMED_BYTES`` are summed up before the shuffle."""
    rows = texts.select(F.lower("text").alias("text"))
    names = [f"v{k}" for k in range(DIMS)]

    def summed(lowered: pa.Array) -> Iterator[pa.RecordBatch]:
        row, codes, words = T.coded_terms(lowered, stop_words)
        if len(codes):
            sums = neighbour_sums(codes, row, signs_of(words.to_pylist()))
            yield pa.RecordBatch.from_arrays([words, *map(pa.array, sums)], names=["word", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch["text"])
            size += held[-1].nbytes
            if size >= SUMMED_BYTES:
                yield from summed(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield from summed(pa.concat_arrays(held))

    parts = rows.mapInArrow(work, "word string, " + ", ".join(f"{c} long" for c in names))
    every = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    return cut_lineage(every.select("word", F.array(*names).alias("vector")), "word-vectors")


def text_words(texts: DataFrame, stop_words=T.STOP_WORDS) -> DataFrame:
    """owner, words: the distinct terms of each text (owner, text) in the order of the first use."""
    return texts.select("owner", F.array_distinct(T.terms_without_stop_words("text", stop_words)).alias("words"))


def token_words(texts: DataFrame, stop_words=T.STOP_WORDS) -> DataFrame:
    """owner, pos, word: ``text_words`` as rows, counted from 0."""
    return text_words(texts, stop_words).select("owner", F.posexplode("words").alias("pos", "word"))


def token_vectors(texts: DataFrame, words: DataFrame, stop_words=T.STOP_WORDS) -> DataFrame:
    """owner, pos, vector of the distinct terms of each text (owner, text), in the order of the first use; pos counts
    from 0. ``words`` is broadcast if it is small; else the terms, which are narrow, meet it by shuffle and adaptive
    execution splits a hot word's rows. A text without terms has no rows."""
    tokens = token_words(texts, stop_words)
    vectors = words.select("word", F.col("vector").cast("array<double>").alias("vector"))
    found = tokens.join(checked_small_side(vectors, 64 + 8 * DIMS), "word")
    return found.select("owner", F.col("pos").cast("long").alias("pos"), "vector")
