"""Texts of an Arrow batch as one array of bytes, and hashes of their words, without a loop
over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
# Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# words of letters, digits and bytes beyond ASCII; all else separates
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (
                np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)]), dtype=U)
                for b in (BASE, BASE_INVERSE)
            )


POWERS = Powers()


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about ``CHUNK`` bytes; a null
    text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    # the batch's own buffers are read, not copied
    texts = column.fill_null("") if column.null_count else column
    _, offset_buffer, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, int(offsets[row]) + CHUNK, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        at = offsets[row : end + 1].astype(np.int64)
        yield row, flat[at[0] : at[-1]], at - at[0]
        row = end


def word_spans(flat: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """(start, end, row) of each word of the texts, in order. A word is a run of bytes that
    ``separator`` does not mark, and never reaches over the end of a text."""
    inside = ~separator[flat]
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(flat)]
    before[heads] = False
    after[heads[heads > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(flat: np.ndarray):
    """A function (start, end) -> hashes of these spans of bytes, lower-cased in ASCII."""
    n = len(flat)
    POWERS.upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE_VALUE[LOWER[flat]] * POWERS.up[:n], dtype=U, out=sums[1:])
    return lambda start, end: mix64((sums[end] - sums[start]) * POWERS.down[start])


def words_of(flat: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """(hash, row) of each word of the texts, in order."""
    start, end, row = word_spans(flat, offsets, separator)
    return span_hashes(flat)(start, end), row


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; run i starts at word i."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    total = np.zeros(count, U)
    for i in range(n):
        total = mix64(total + words[i : i + count])
    return total
