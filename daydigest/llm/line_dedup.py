"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at both ends, lower-cased in ASCII; a 128-bit hash
stands for it: 64 bits of place and 64 bits of fingerprint. The documents of each key are counted. The
distinct hashes of the keys of enough documents are dealt to shards by their first bits, and each shard
becomes a minimal perfect hash: levels of bit arrays in which every key has a bit of its own, the
rank of that bit being the key's place in an array of fingerprints and one of counts. Documents
probe those arrays line by line; a key that is not in the index fails the fingerprint.

Keys of fewer documents are left out of the index, as they lose no line: it holds at most a
``least``-th of all lines. So that no line outside is taken for one inside, fingerprints have all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from daydigest.llm.bytes import mix64
from daydigest.llm.common import BROADCAST_BYTES, anonymous, bounded_batches
from daydigest.session import cut_lineage

# A key of so many documents loses its lines.
LEAST_DOCS = 10
# Keys of fewer code points are left alone.
LEAST_CHARS = 1
SPACE = b" \t\n\v\f\r"
# Keys of a shard on average, and the bits of a level for each key that is left.
SHARD_KEYS = 1 << 16
LEVEL_BITS = 2
MAX_LEVELS = 40
# Keys that a task counts before it hands them on.
HELD_KEYS = 500_000
# Probe rows of a task where the index is too large to be sent to every task.
PROBE_ROWS = 20_000
U = np.uint64


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def split_lines(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All lines of the texts, and the first line of each text and the end; a null text is one
    empty line."""
    lines, ends = [], [0]
    for text in texts:
        lines += (text or b"").split(b"\n")
        ends.append(len(lines))
    return lines, np.array(ends)


def key_hashes(lines: list[bytes], least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's key, and whether the key is long enough."""
    keys = [line.strip(SPACE).lower() for line in lines]
    packed = np.frombuffer(b"".join(map(xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    if least_chars > 1:
        return packed, np.array([len(k.decode()) >= least_chars for k in keys], bool)
    return packed, np.fromiter((len(k) >= least_chars for k in keys), bool, len(keys))


def summed_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``h`` with the sum of their ``n``."""
    if not len(h):
        return h, n
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)]))
    return h[first], np.add.reduceat(n, first)


def line_counts(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """place, print, n: the hash of each key and the number of documents (rows) that hold it.

    A task counts a key once a document and adds up before anything is shuffled, so a line of
    all documents is a row a task.
    """
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(h, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(n)], names=["place", "print", "n"]
            )

        held_h, held_n = np.zeros((0, 2), U), np.zeros(0, np.int64)
        for batch in batches:
            lines, ends = split_lines(text_bytes(batch["text"]))
            h, long_enough = key_hashes(lines, least_chars)
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[long_enough]
            h = h[long_enough]
            order = np.lexsort((owner, h[:, 1], h[:, 0]))
            h, owner = h[order], owner[order]
            # once a document
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1) | (owner[1:] != owner[:-1])
            more = h[new]
            held_h, held_n = summed_keys(
                np.concatenate([held_h, more]), np.concatenate([held_n, np.ones(len(more), np.int64)])
            )
            if len(held_h) > HELD_KEYS:
                yield packed(held_h, held_n)
                held_h, held_n = np.zeros((0, 2), U), np.zeros(0, np.int64)
        yield packed(held_h, held_n)

    counted = docs.select("text").mapInArrow(work, "place long, print long, n long")
    return counted.groupBy("place", "print").agg(F.sum("n").alias("n"))


def level_places(h: np.ndarray, level: int) -> np.ndarray:
    """The hash of each key for one level, from both halves of its hash."""
    return mix64(h[:, 0] + h[:, 1] * U(2 * level + 1) + U(level))


def build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard: bits of each level, all levels' bits, and fingerprints and counts in
    the order of the keys' bits."""
    h = np.stack([rows[c].to_numpy(np.int64).view(U) for c in ("place", "print")], axis=1)
    n = np.minimum(rows["n"].to_numpy(np.int64), np.iinfo(np.uint32).max).astype(np.uint32)
    left = np.arange(len(h))
    sizes, words, order = [], [], []
    while len(left) and len(sizes) < MAX_LEVELS:
        size = -(-LEVEL_BITS * len(left) // 64) * 64
        spot = (level_places(h[left], len(sizes)) % U(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        mine = alone[spot]
        words.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        order.append(left[mine][np.argsort(spot[mine])])
        left = left[~mine]
    if len(left):
        raise RuntimeError("the distinct hashes of a shard found no bits of their own")
    order = np.concatenate(order)
    out = {"shard": [key[0]], "sizes": [sizes], "bits": [np.concatenate(words).tobytes()]}
    out |= {"prints": [h[order, 1].tobytes()], "counts": [n[order].tobytes()]}
    return pd.DataFrame(out)


ARRAYS = "shard int, sizes array<long>, bits binary, prints binary, counts binary"


class LineIndex:
    """The arrays of several shards, probed together."""

    def __init__(self, shards: list, shard_bits: int):
        shards = sorted(shards, key=lambda s: s["shard"])
        self.shard_bits = shard_bits
        self.prints = np.frombuffer(b"".join(s["prints"] for s in shards), U)
        self.counts = np.frombuffer(b"".join(s["counts"] for s in shards), np.uint32)
        self.words = np.frombuffer(b"".join(s["bits"] for s in shards), U)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        levels = max((len(s["sizes"]) for s in shards), default=0)
        self.sizes = np.zeros((1 << shard_bits, levels), np.int64)
        for s in shards:
            self.sizes[s["shard"], : len(s["sizes"])] = s["sizes"]
        flat = self.sizes.reshape(-1)
        self.starts = (np.cumsum(flat) - flat).reshape(self.sizes.shape)

    def documents(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 where it is not in the index."""
        found = np.zeros(len(h), np.int64)
        todo = np.arange(len(h))
        shard = shard_of(h[:, 0], self.shard_bits)
        for level in range(self.sizes.shape[1]):
            todo = todo[self.sizes[shard[todo], level] > 0]
            if not len(todo):
                break
            size = self.sizes[shard[todo], level]
            spot = (level_places(h[todo], level) % size.astype(U)).astype(np.int64) + self.starts[shard[todo], level]
            word, bit = self.words[spot >> 6], (spot & 63).astype(U)
            here = (word >> bit & U(1)) == 1
            below = np.bitwise_count(word[here] & ((U(1) << bit[here]) - U(1)))
            at, who = self.rank[spot[here] >> 6] + below, todo[here]
            same = self.prints[at] == h[who, 1]
            found[who[same]] = self.counts[at[same]]
            todo = todo[~here]
        return found


def shard_of(place: np.ndarray, shard_bits: int) -> np.ndarray:
    return (place >> U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(place), np.int64)


def build_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """The arrays of every shard (a written table) and the bits of a shard's number. ``keys`` is a
    written table of place, print, n. Hashes are evenly spread, so shards are of one size whatever
    the lines are."""
    shard_bits = max(0, -(-keys.count() // SHARD_KEYS) - 1).bit_length()
    # the first bits of the hash; a shift by 64 would be one by 0
    shard = F.shiftrightunsigned("place", 64 - shard_bits).cast("int") if shard_bits else F.lit(0)
    arrays = keys.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, ARRAYS)
    return cut_lineage(arrays, "line-index"), shard_bits


def text_hashes(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), F.col(text)).alias("u")


def routed_hits(docs: DataFrame, index: DataFrame, shard_bits: int, parts: int, least: int, least_chars: int) -> DataFrame:
    """t, u (hashes of a text), hits (packed hashes): which keys of each text are in the index, for an
    index that is too large to be sent to every task. The shards lie in ``parts``; each text's distinct
    hashes go, packed, to the parts they belong to and are probed there. Copies of a text go once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, ends = split_lines(text_bytes(batch["text"]))
            h, long_enough = key_hashes(lines, least_chars)
            whose, part, packed = [], [], []
            for row, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                mine = np.unique(h[a:b][long_enough[a:b]], axis=0)
                to = shard_of(mine[:, 0], shard_bits) * parts >> shard_bits
                for p in np.unique(to):
                    whose.append(row)
                    part.append(p)
                    packed.append(mine[to == p].tobytes())
            took = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["t"].take(took), batch["u"].take(took), pa.array(part, pa.int32()), pa.array(packed, pa.binary())],
                names=["t", "u", "part", "hashes"],
            )

    rows = docs.select(*text_hashes("text"), "text")
    probes = cut_lineage(rows.mapInArrow(pack, "t long, u long, part int, hashes binary").distinct(), "line-probes")
    salts = max(1, -(-probes.count() // (parts * PROBE_ROWS)))
    salted = probes.withColumn("salt", F.pmod("u", F.lit(salts)).cast("int"))
    placed = index.withColumn("part", F.shiftright(F.col("shard") * F.lit(parts), shard_bits).cast("int"))
    placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(key: tuple, some: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        arrays = LineIndex(shards.to_dict("records"), shard_bits)
        sizes = some["hashes"].map(len).to_numpy(np.int64) // 16
        h = np.frombuffer(b"".join(some["hashes"]), U).reshape(-1, 2)
        hit = arrays.documents(h) >= least
        ends = np.cumsum(sizes)
        hits = [h[b - n : b][hit[b - n : b]].tobytes() for b, n in zip(ends, sizes)]
        some = some[["t", "u"]].assign(hits=hits)
        return some[[len(x) > 0 for x in hits]]

    found = (
        salted.groupBy("part", "salt")
        .cogroup(placed.groupBy("part", "salt"))
        .applyInPandas(probe, "t long, u long, hits binary")
    )
    # at most the text's own lines
    return found.groupBy("t", "u").agg(F.collect_list("hits").alias("hits"))


ADDED = {"kept_text": "string", "n_lines": "long", "n_dropped": "long"}


def without_repeated_lines(
    docs: DataFrame, least: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with ``kept_text`` (the text without its repeated lines), ``n_lines`` (lines of the whole
    text) and ``n_dropped``.

    A key of at least ``least_chars`` (1 or more) code points that at least ``least`` documents hold loses
    all its lines in every document, in the document of its first use too; the other lines stay as they are,
    joined by a line feed. A null or empty text is one empty line, whose key is too short to count. A line that
    a document repeats counts once for it. Repeated rows and ids are documents of their own. Input
    columns of the three names are replaced; all others come through. An empty table stays empty.

    The index goes to the tasks as it is while its arrays take at most ``limit`` bytes; beyond that the
    texts' hashes go, packed, to the parts of the index.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED])
    keys = cut_lineage(line_counts(docs, least_chars).filter(F.col("n") >= least), "line-keys")
    index, shard_bits = build_index(keys)
    size = index.agg(F.sum(F.octet_length("bits") + F.octet_length("prints") + F.octet_length("counts"))).first()[0] or 0

    plain, at = anonymous(docs)
    text = at["text"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema]
    if size <= limit:
        sent = spark.sparkContext.broadcast((index.collect(), shard_bits))
    else:
        sent = None
        # a part for each ``limit``, but no more parts than shards
        hits = routed_hits(docs, index, shard_bits, min(1 << shard_bits, -(-size // max(1, limit))), least, least_chars)
        t, u = text_hashes(text)
        plain = plain.join(hits, (t == F.col("t")) & (u == F.col("u")), "left").select(*plain.columns, "hits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = LineIndex(*sent.value) if sent else None
        for batch in batches:
            texts = text_bytes(batch[text])
            lines, ends = split_lines(texts)
            h, long_enough = key_hashes(lines, least_chars)
            if arrays:
                drop = long_enough & (arrays.documents(h) >= least)
            else:
                drop = np.zeros(len(lines), bool)
                for row, hits in enumerate(batch["hits"].to_pylist()):
                    if hits:
                        known = set(map(tuple, np.frombuffer(b"".join(hits), U).reshape(-1, 2).tolist()))
                        a, b = ends[row], ends[row + 1]
                        drop[a:b] = [tuple(x) in known for x in h[a:b].tolist()]
            gone = np.add.reduceat(drop, ends[:-1], dtype=np.int64) if texts else np.zeros(0, np.int64)
            kept = [
                b"\n".join([lines[i] for i in range(a, b) if not drop[i]]) if n else t or b""
                for t, a, b, n in zip(texts, ends[:-1], ends[1:], gone)
            ]
            columns = [batch[c] for c in batch.schema.names if c != "hits"]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(ends)), pa.array(gone)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(k.split()[0] for k in kinds), *ADDED])

    done = plain.mapInArrow(work, ", ".join([*kinds, *(f"{c} {kind}" for c, kind in ADDED.items())]))
    return done.toDF(*docs.columns, *ADDED)


def line_dedup(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each document; see ``without_repeated_lines``."""
    done = without_repeated_lines(docs.select("doc_id", "text"), least)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
