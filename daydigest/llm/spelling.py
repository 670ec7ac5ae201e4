"""Spelling variant grouping by sorted permuterm rotations.

A word and a terminator are written round a circle; a rotation starts anywhere on it. The rotation that
starts behind an edited character ends with that character, so what it has before its last character is the
same for every word that differs there alone, and is also the whole rotation of the word that lacks
the character. So each rotation stands in the sorted list twice, whole and without its last character, and a
run of equal entries is a group of words that are all one edit apart: replacements of one character, and
at most one word without it. A group has no more words than the alphabet has letters, and one scan
of the sorted list finds what every word gets from its groups: how many near words, and the best of them. Words are ranked
by count and code points, so that the best is the smallest number. No pair of words is written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.llm.common import bounded_batches, broadcast_if_small
from daydigest.session import cut_lineage

LEAST_CHARS = 7
LEAST_COUNT = 2
# A near word is a word's form if it is so many times as frequent.
RATIO = 10
# A letter is deleted from a document's word if this divides the checksum of both.
MISSPELL = 31
TERMINATOR = "$"
# Words that a task counts before it hands them on, and rotations of a long word that it hands on at once.
HELD_WORDS = 200_000
# Rotations of more characters are hashed, by polynomials modulo four primes below 2^31.
LONG = 64
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASE = 1_000_003
MIX = 1_234_567_891
U = np.uint64


def altered(word: str, checksum: int, misspell: int | None) -> str:
    """``word``, without one letter where ``misspell`` divides the checksum."""
    if not misspell or checksum % misspell:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, misspell: int | None = None
) -> DataFrame:
    """word, n: the words of ``least_chars`` code points or more, lower-cased in ASCII, that occur ``least_count``
    times or more in all texts together. A word is a whole run of letters up to U+00FF. With ``misspell``,
    words lose a letter in the documents that their checksum picks (a null id is an empty one)."""
    bounded_batches(docs.sparkSession)
    # deleting never lengthens, so shorter runs are none of the words
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )

        held: Counter = Counter()
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for id_, text in zip(batch["id"].to_pylist(), texts):
                # a byte string is lower-cased in ASCII only
                found = Counter(m[0] for m in runs.finditer(text.as_py().lower().decode()))
                start = zlib.crc32(f"{id_}:".encode())
                for word, n in found.items():
                    word = altered(word, zlib.crc32(word.encode(), start), misspell)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """key, rank, whole, leads: every rotation of each of ``words`` (word, rank), whole and without its last
    character. ``leads`` is true where that character differs from the one before it in the word: of equal letters
    in a row the first stands for all, as deleting any of them gives the same word. A rotation of more than
    ``LONG`` characters is its hash; see ``long_entries``."""
    at = words.filter(F.length("word") <= LONG).select("rank", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    tail = F.expr("substring(word, at + 1)")
    whole = at.filter(F.length("word") < LONG).select(
        F.concat(tail, F.lit(TERMINATOR), F.expr("substring(word, 1, at)")).alias("key"),
        "rank",
        F.lit(True).alias("whole"),
        F.lit(False).alias("leads"),
    )
    cut = at.filter("at > 0").select(
        F.concat(tail, F.lit(TERMINATOR), F.expr("substring(word, 1, at - 1)")).alias("key"),
        "rank",
        F.lit(False).alias("whole"),
        F.expr("at = 1 OR substring(word, at, 1) <> substring(word, at - 1, 1)").alias("leads"),
    )
    long = words.filter(F.length("word") >= LONG).mapInArrow(long_entries, ENTRIES)
    return whole.union(cut).union(long)


ENTRIES = "key string, rank long, whole boolean, leads boolean"


def powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), prime)) % U(prime)])
    return out[:n]


def rotation_hashes(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a word's code points the hashes (a row of four 31-bit numbers each) of its whole rotations, by where
    they start, and of its rotations without a letter, by that letter. The hash of a rotation is one of the letters
    behind its start and of those before it, so all of them come from running sums."""
    n = len(letters)
    whole, cut = np.zeros((n + 1, len(PRIMES)), U), np.zeros((n, len(PRIMES)), U)
    for k, prime in enumerate(PRIMES):
        p = U(prime)
        up, down = powers(BASE, n + 1, prime), powers(pow(BASE, -1, prime), n + 1, prime)
        sums = np.zeros(n + 1, U)
        np.cumsum(letters.astype(U) * up[:n] % p, dtype=U, out=sums[1:])
        sums %= p
        before = sums
        behind = (sums[n] + p - sums) % p * down % p
        whole[:, k] = (before * U(MIX) + behind) % p
        cut[:, k] = (before[:n] * U(MIX) + behind[1:]) % p
    return whole, cut


def long_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of words of ``LONG`` code points or more whose text has more than ``LONG``, each with a hash
    of 124 bits for the rotation: a word of a million letters is two million short entries, not their texts."""
    for batch in batches:
        for rank, word in zip(batch["rank"].to_pylist(), batch["word"]):
            letters = np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32)
            whole, cut = rotation_hashes(letters)
            leads = np.ones(len(letters), bool)
            leads[1:] = letters[1:] != letters[:-1]
            if len(letters) == LONG:
                # without a letter it is short
                cut, leads = cut[:0], leads[:0]
            hashes = np.concatenate([whole, cut]).astype(">u4")
            keys = np.frombuffer(hashes.tobytes().hex().encode(), "S32").astype("U32")
            for first in range(0, len(keys), HELD_WORDS):
                part = slice(first, first + HELD_WORDS)
                size = len(keys[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[part], pa.string()),
                        pa.array(np.full(size, rank, np.int64)),
                        pa.array((np.arange(len(keys)) < len(whole))[part]),
                        pa.array(np.concatenate([np.zeros(len(whole), bool), leads])[part]),
                    ],
                    names=["key", "rank", "whole", "leads"],
                )


def group_neighbours(rows: pa.Table) -> pa.RecordBatch:
    """rank, n_near, best (a rank) for each row of the groups of two or more words; ``rows`` holds whole
    groups in order, each by rank."""
    key = rows["key"].combine_chunks()
    new = np.ones(len(key), bool)
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    group = np.cumsum(new) - 1
    rank, whole, leads = (rows[c].to_numpy() for c in ("rank", "whole", "leads"))
    # near words of a cut entry: the other cut ones, and the whole one once for a row of equal letters
    cut = np.add.reduceat(~whole, start, dtype=np.int64)[group]
    led = np.add.reduceat(leads, start, dtype=np.int64)[group]
    near = np.where(whole, led, cut - 1 + leads * (size[group] - cut))
    first = start[group]
    keep = np.flatnonzero(size[group] > 1)
    best = (first + (np.arange(len(key)) == first))[keep]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rank[keep], near[keep], rank[best])], names=["rank", "n_near", "best"])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition; the last group of a batch waits for the next batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held else rows
        last = rows["key"][-1]
        ends = pc.equal(rows["key"], last)
        yield from in_groups(rows.filter(pc.invert(ends)))
        held = rows.filter(ends)
    if held:
        yield from in_groups(held)


def in_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if len(rows):
        yield group_neighbours(rows)


def near_words(words: DataFrame) -> DataFrame:
    """rank, n_near, best for each of ``words`` (rank, word) that has near words: the number of words one
    edit away, and the smallest of their ranks."""
    entries = rotations(words).repartitionByRange("key").sortWithinPartitions("key", "rank")
    found = entries.mapInArrow(scanned, "rank long, n_near long, best long")
    return found.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """word, root for each of ``links`` (word, form; a written table): the last word of its chain of forms. Every
    round doubles the steps; as counts grow tenfold a step, few rounds do for any table."""
    roots = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = broadcast_if_small(ahead, 64)
        roots = cut_lineage(roots.join(ahead, "root", "left").select("word", "root", "next"), "spelling-roots")
        if not roots.filter("next IS NOT NULL").limit(1).count():
            return roots.select("word", "root")
        roots = roots.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (word, n; words distinct and not null).

    Two words are near if one character inserted, deleted or replaced makes one of the other. A word's form is
    its near word of largest n (ties: the smallest in code-point order), if that n is ``ratio`` (2 or more)
    times the word's own at least; else null. ``root`` follows the forms to the last and is the word itself
    without a form. An empty table gives no rows.
    """
    # a word's rank is its place by falling n and then by code points: numbers that rise over sorted partitions
    words = words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id())
    words = cut_lineage(words, "spelling-words")
    near = cut_lineage(near_words(words.select("rank", "word")), "near-words")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = near.join(best, "best")
    linked = F.col("form_n") >= ratio * F.col("n")
    forms = words.join(known, "rank", "left").select(
        "word",
        F.when(linked, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(linked, F.col("form_n")).alias("form_n"),
    )
    forms = cut_lineage(forms, "spelling-forms")
    roots = roots_of(cut_lineage(forms.filter("form IS NOT NULL").select("word", "form"), "spelling-links"))
    every = forms.join(broadcast_if_small(roots, 64), "word", "left")
    return every.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """``spelling_variants`` of the words of ``docs`` (doc_id, text); null and empty texts have no words, repeated
    rows and ids count as often as they stand, other columns are ignored."""
    return spelling_variants(word_counts(docs, misspell=misspell))
