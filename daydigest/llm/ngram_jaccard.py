"""N-gram Jaccard join: exact links between texts, and the groups they make.

Texts are sets of hashed word shingles; equal sets are one. A link needs an overlap that only sets
of close sizes can have, and then the sets must share one of their rarest shingles: that shingle
and the band of sizes are the tile in which two sets meet. In a tile the positions of the shared
shingle, then the bits of hashed bitmap signatures, bound the overlap from above, and what is
left is decided by intersecting the sorted arrays. Sets of a tile that few share meet as rows; a crowded
tile is compared in blocks inside tasks (``tile_blocks``), so that rows grow with the sets and not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daydigest.llm import tile_blocks
from daydigest.llm.bytes import SPACE, mix64, run_hashes, text_chunks, words_of
from daydigest.llm.common import anonymous, bounded_batches, broadcast_if_small
from daydigest.llm.graphs import components
from daydigest.session import cut_lineage

WORDS = 5
# A link: 100 * overlap >= PERCENT * union.
PERCENT = 75
# Shingles are counted in so many buckets; the counts only order them, from rare to frequent.
COUNT_BITS = 20
COUNT_SLICES = 16
# Keys by which near copies find each other before the exact search, of two minima each.
QUICK_KEYS = 8
# Sets of a group and tile that are looked at before all others, and sets of a part of a crowded tile.
DRAWN = 64
PART_SETS = 16
U = np.uint64
ODD = mix64(np.arange(1, 2 * QUICK_KEYS + 1, dtype=U)) | U(1)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first place of each text and the end): the distinct shingles of each text, sorted."""
    rows = len(offsets) - 1
    words, row = words_of(flat, offsets, SPACE)
    runs = run_hashes(words, WORDS)
    whole = row[: len(runs)] == row[WORDS - 1 :] if len(runs) else np.zeros(0, bool)
    hashes, owner = [runs[whole]], [row[: len(runs)][whole]]
    count = np.bincount(row, minlength=rows)
    start = np.cumsum(count) - count
    for n in range(1, WORDS):
        short = np.flatnonzero(count == n)
        total = np.full(len(short), U(n))
        for i in range(n):
            total = mix64(total + words[start[short] + i])
        hashes.append(total)
        owner.append(short)
    h, of = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(h)
    order = order[by_row(of[order], rows)]
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(rows + 1))


def by_row(row: np.ndarray, rows: int) -> np.ndarray:
    """Order by row that keeps the order within a row."""
    return np.argsort(row.astype(np.uint16) if rows <= 1 << 16 else row, kind="stable")


def signature_bits(n: np.ndarray) -> np.ndarray:
    """Width of a set's bitmap: the power of two from twice its size on, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))


def describe_sets(h: np.ndarray, place: np.ndarray):
    """For each text with shingles: size, two digests of the set, quick keys and bitmap."""
    n = np.diff(place)
    at = np.flatnonzero(n)
    first, size = place[:-1][at], n[at]
    if not len(at):
        return at, size, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, QUICK_KEYS), np.int64), b"", np.zeros(1, np.int64)
    digest = [np.add.reduceat(mix64(h ^ U(c)), first).view(np.int64) for c in (0x5BD1E995, 0xC2B2AE3D)]
    least = [mix64(np.minimum.reduceat(h * m, first) + U(i)) for i, m in enumerate(ODD)]
    keys = np.stack([mix64(least[i] + least[i + 1]) for i in range(0, 2 * QUICK_KEYS, 2)], axis=1)
    width = signature_bits(size)
    ends = np.cumsum(width)
    shift = (64 - np.log2(width)).astype(U)
    spot = (h[first[0] :] >> np.repeat(shift, size)).astype(np.int64) + np.repeat(ends - width, size)
    bits = np.zeros(ends[-1], np.uint8)
    bits[spot] = 1
    return at, size, digest[0], digest[1], keys.view(np.int64), np.packbits(bits).tobytes(), np.concatenate([[0], ends // 8])


PROFILE = "n int, a long, b long, keys array<long>, sig binary, slice int"


def profile(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, t: hash of the text, n, a, b: digests of the set, keys,
    sig), and for each task the slices of its shingle counts (slice, sig)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        ids = None
        for batch in batches:
            ids = batch["doc_id"].type
            for row, flat, offsets in text_chunks(batch["text"]):
                h, place = shingle_sets(flat, offsets)
                counts += np.bincount((h >> U(8) & U((1 << COUNT_BITS) - 1)).astype(np.int64), minlength=1 << COUNT_BITS)
                at, size, a, b, keys, bits, ends = describe_sets(h, place)
                total = len(offsets) - 1
                have = np.zeros(total, bool)
                have[at] = True
                full = [np.zeros(total, np.int64) for _ in range(3)]
                for to, what in zip(full, (size, a, b)):
                    to[at] = what
                long_ends = np.zeros(total + 1, np.int32)
                long_ends[1:][have] = np.diff(ends)
                long_ends = np.cumsum(long_ends).astype(np.int32)
                key_ends = np.concatenate([[0], np.cumsum(have * QUICK_KEYS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, total),
                        batch["t"].slice(row, total),
                        pa.array(full[0].astype(np.int32)),
                        pa.array(full[1]),
                        pa.array(full[2]),
                        pa.ListArray.from_arrays(key_ends, keys.reshape(-1)),
                        pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(long_ends), pa.py_buffer(bits)]),
                        pa.nulls(total, pa.int32()),
                    ],
                    names=["doc_id", "t", "n", "a", "b", "keys", "sig", "slice"],
                )
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts.astype(np.uint32), COUNT_SLICES)]
            none = lambda kind: pa.nulls(COUNT_SLICES, kind)
            yield pa.RecordBatch.from_arrays(
                [none(ids), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())),
                 pa.array(parts, pa.binary()), pa.array(np.arange(COUNT_SLICES, dtype=np.int32))],
                names=["doc_id", "t", "n", "a", "b", "keys", "sig", "slice"],
            )

    return rows.mapInArrow(work, f"doc_id {kind}, t long, {PROFILE}")


def shingle_order(described: DataFrame) -> np.ndarray:
    """For each bucket of shingles its rank in steps of the logarithm of its count over all
    documents. The table has a fixed size."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << COUNT_BITS) // COUNT_SLICES, np.int64)
        for part in rows["sig"]:
            total += np.frombuffer(part, np.uint32)
        return pd.DataFrame({"slice": [key[0]], "sig": [total.tobytes()]})

    summed = described.filter("slice IS NOT NULL").select("slice", "sig").groupBy("slice").applyInPandas(add, "slice int, sig binary")
    counts = np.zeros((COUNT_SLICES, (1 << COUNT_BITS) // COUNT_SLICES), np.int64)
    for r in summed.collect():
        counts[r["slice"]] = np.frombuffer(r["sig"], np.int64)
    return np.rint(1024 * np.log2(counts.reshape(-1) + 1.0)).astype(np.uint16)


def rare_shingles(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """a, n, rare: for each text its rarest shingles, rare first, as many as a set linked with it
    must share one of: n - ceil(PERCENT / 100 * n) + 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, offsets in text_chunks(batch["text"]):
                h, place = shingle_sets(flat, offsets)
                at, size, a, *_ = describe_sets(h, place)
                if not len(at):
                    continue
                of = np.repeat(np.arange(len(at)), size)
                by = np.argsort(order[(h >> U(8) & U((1 << COUNT_BITS) - 1)).astype(np.int64)], kind="stable")
                by = by[by_row(of[by], len(at))]
                rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                wanted = size - -(-size * PERCENT // 100) + 1
                kept = h[by][rank < np.repeat(wanted, size)].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, kept)], names=["a", "n", "rare"]
                )

    return docs.select("text").mapInArrow(work, "a long, n int, rare array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """a, shingles (sorted) of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, offsets in text_chunks(batch["text"]):
                h, place = shingle_sets(flat, offsets)
                at, _, a, *_ = describe_sets(h, place)
                ends = np.concatenate([[0], place[1:][at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.ListArray.from_arrays(ends, h.view(np.int64))], names=["a", "shingles"]
                )

    return docs.select("text").mapInArrow(work, "a long, shingles array<long>")


def least_overlap(n: Column, m: Column) -> Column:
    """The smallest overlap of linked sets of sizes ``n`` and ``m``."""
    return F.ceil((n + m) * F.lit(PERCENT) / F.lit(100.0 + PERCENT))


def overlap_bound(x: bytes, y: bytes, n: int, m: int) -> int:
    """No more than so many shingles can be in both sets: those whose bit the other set lacks are
    not. The wider bitmap is folded to the width of the other."""
    width = min(len(x), len(y))
    p, q = (folded(np.frombuffer(s, np.uint8), width).view(np.uint64) for s in (x, y))
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A packed bitmap at a smaller power of two of bytes: neighbouring bits are one."""
    while len(bits) > width:
        bits = np.packbits(np.unpackbits(bits).reshape(-1, 2).any(axis=1))
    return bits


def linked(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def arrays_of(named: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """a, shingles (sorted), written, of the sets that ``named`` (a; a written table) names: of each its lowest row's text
    is read again."""
    ends = sets.join(named, "a", "left_semi").select("low.id", "low.t").distinct()
    ends = broadcast_if_small(cut_lineage(ends, "near-rows"), 32)
    some = docs.select("doc_id", "text").join(
        ends, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("t")), "left_semi"
    )
    # copies of one row are read once
    return cut_lineage(whole_sets(some).groupBy("a").agg(F.any_value("shingles").alias("shingles")), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (x, y: digests; a written table) that are links. The bitmaps rule out most;
    of the rest the texts are read again and the sorted shingles intersected."""

    @F.pandas_udf("boolean")
    def may_link(xs: pd.Series, ys: pd.Series, ns: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([linked(overlap_bound(x, y, n, m), n, m) for x, y, n, m in zip(xs, ys, ns, ms)], dtype=bool)

    @F.pandas_udf("boolean")
    def do_link(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            out.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("a").alias("x"), F.col("n").alias("n"), F.col("sig").alias("s"))
    other = sets.select(F.col("a").alias("y"), F.col("n").alias("m"), F.col("sig").alias("r"))
    near = one.join(broadcast_if_small(pairs, 16), "x").join(other, "y").filter(may_link("s", "r", "n", "m"))
    near = cut_lineage(near.select("x", "y"), "near-pairs")
    named = near.select(F.col("x").alias("a")).union(near.select("y")).distinct()
    arrays = arrays_of(named, sets, docs)
    ends = broadcast_if_small(near, 16)
    met = arrays.select(F.col("a").alias("x"), F.col("shingles").alias("p")).join(ends, "x")
    met = met.join(arrays.select(F.col("a").alias("y"), F.col("shingles").alias("q")), "y")
    return met.filter(do_link("p", "q")).select("x", "y")


def quick_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of each set with one set for each quick key it has, drawn by hash: few pairs for
    any group, and with other partners for each key, so that a group of near copies becomes one
    before the exact search."""
    keyed = sets.select("a", "n", F.explode("keys").alias("key"))
    drawn = F.min(F.struct(F.xxhash64("key", "a").alias("h"), "a", "n"))
    centre = keyed.groupBy("key").agg(drawn.alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = keyed.join(centre, "key").filter("a <> c.a")
    close = met.filter((F.least("n", "c.n") * 100) >= F.greatest("n", "c.n") * PERCENT)
    return close.select(F.least("a", "c.a").alias("x"), F.greatest("a", "c.a").alias("y")).distinct()


def size_band(n: Column) -> Column:
    """The band of a set's size: linked sets are of one band or of two neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int")


def tiles_of(rare: DataFrame) -> DataFrame:
    """Each set in each tile (``key`` and size ``band``) of its rare shingles, with the shingle's ``place``."""
    listed = rare.select("*", size_band(F.col("n")).alias("band"), F.posexplode("rare").alias("place", "key"))
    return listed.drop("rare")


def grouped_sets(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (a, ...) with ``group``: the group that the links found so far give the set."""
    known = groups.select(F.col("node").alias("a"), "root")
    return rows.join(known, "a", "left").withColumn("group", F.coalesce("root", "a")).drop("root")


def renamed_groups(groups: DataFrame, joined: DataFrame) -> DataFrame:
    """``groups`` (node, root) after links between groups (p, q) were found."""
    names = cut_lineage(components(joined.select(F.col("p").alias("x"), F.col("q").alias("y"))), "joined-groups")
    new = names.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = groups.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    # sets that were alone so far
    first = names.join(groups.select("node"), "node", "left_anti").select("node", "root")
    return cut_lineage(moved.union(first), "groups")


def contested(rare: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of tiles in which sets of several groups meet, written; most tiles hold one set.

    A tile's lowest and highest group are found on the map side first, so that no tile is gathered;
    then the sets are read again for the tiles that are left.
    """
    ends = tiles_of(grouped_sets(rare, groups)).groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    keys = cut_lineage(ends.filter("low <> high").select("key"), "contested-keys")
    return cut_lineage(tiles_of(rare).join(broadcast_if_small(keys, 16), "key", "left_semi"), "contested")


def drawn_sets(tiles: DataFrame) -> DataFrame:
    """Up to ``DRAWN`` sets of each group in each tile, drawn and numbered from 1 by hash."""
    order = Window.partitionBy("key", "group").orderBy(F.xxhash64("key", "a"), "a")
    return tiles.withColumn("drawn", F.row_number().over(order)).filter(F.col("drawn") <= DRAWN)


def rare_pairs(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets of different groups (p, q) that meet in a tile and may be linked by their
    sizes and by where the shared shingle stands. The sets of a band meet those of it and of the next.

    Crowded tiles (``sizes``) give few rows a set: with ``drawn`` sets, those whose hash puts them in the same one of
    its parts meet, and of a part sets whose numbers multiply to ``DRAWN`` at most (a set alone in its group
    meets all that are drawn of another); without, crowded tiles are left to ``tile_blocks``.
    """
    drawn = "drawn" in tiles.columns
    # a tile's number of parts, null where it is not crowded
    cut = F.ceil(F.sqrt(F.col("homes") * F.col("guests")) / PART_SETS).alias("parts")
    parts = broadcast_if_small(cut_lineage(sizes.select("key", "band", cut), "crowded-parts"), 24)
    left, right = (tiles.select(*[F.col(c).alias(s + c) for c in tiles.columns]) for s in ("l_", "r_"))
    right = right.withColumn("r_band", F.explode(F.array("r_band", F.col("r_band") - 1)))

    def dealt(rows: DataFrame, s: str) -> DataFrame:
        mine = parts.select(F.col("key").alias(s + "key"), F.col("band").alias(s + "band"), F.col("parts").alias(s + "parts"))
        rows = rows.join(mine, [s + "key", s + "band"], "left")
        if not drawn:
            return rows.filter(F.col(s + "parts").isNull()).withColumn(s + "part", F.lit(0).cast("long"))
        part = F.pmod(F.xxhash64(s + "a", s + "key"), F.coalesce(s + "parts", F.lit(1)))
        return rows.withColumn(s + "part", part.cast("long"))

    left, right = dealt(left, "l_"), dealt(right, "r_")
    n, m = F.col("l_n"), F.col("r_n")
    smaller = (n < m) | ((n == m) & (F.col("l_a") < F.col("r_a")))
    # the shared shingle and those behind it in the smaller of both rests
    most = F.least(n - F.col("l_place"), m - F.col("r_place"))
    meet = (
        (F.col("l_key") == F.col("r_key"))
        & (F.col("l_band") == F.col("r_band"))
        & (F.col("l_part") == F.col("r_part"))
        & (F.col("l_group") != F.col("r_group"))
        & smaller
        & (n * 100 >= m * PERCENT)
        & (most >= least_overlap(n, m))
    )
    if drawn:
        meet = meet & (F.col("l_drawn") * F.col("r_drawn") <= DRAWN)
    names = {"l_a": "x", "r_a": "y", "l_group": "p", "r_group": "q"}
    return left.join(right.hint("merge"), meet).select(*[F.col(c).alias(x) for c, x in names.items()]).distinct()


def link_groups(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, grouped, root for each document.

    Documents link where 100 * overlap >= 75 * union of their sets of distinct 5-word shingles
    (lower-cased in ASCII, split at white space; of fewer words the whole sequence). A document
    without words (or a null text) links with nothing. ``component_id`` is the smallest doc_id of a
    document's group; a null id counts only where a group has no other. As ids may repeat, several
    groups can have one ``component_id``; ``root`` (a digest; null where not ``grouped``) is the
    identity of a group. Repeated rows and ids are documents of their own; other columns are
    ignored; an empty table gives no rows.

    Two 64-bit hashes identify a set; should sets differ in one of them alone, an error is raised.
    """
    bounded_batches(docs.sparkSession)
    described = cut_lineage(profile(docs), "profile")
    rows = described.filter("slice IS NULL")
    sets = (
        rows.filter("n > 0")
        .groupBy("a")
        .agg(
            F.min("b").alias("b"),
            F.max("b").alias("other_b"),
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t")).alias("low"),
            F.any_value("n").alias("n"),
            F.any_value("keys").alias("keys"),
            F.any_value("sig").alias("sig"),
        )
    )
    sets = cut_lineage(sets, "sets")
    if sets.filter("b <> other_b").limit(1).count():
        raise RuntimeError("two shingle sets share a 64-bit digest")
    links = cut_lineage(verified(cut_lineage(quick_pairs(sets), "quick-pairs"), sets, docs), "quick-links")
    groups = cut_lineage(components(links), "quick-groups")

    # one row for each set: rows alone in their set as they stand, of the others the lowest row
    many = sets.filter("copies > 1")
    copied = rows.select("doc_id", "t", "a").join(many.select("a"), "a", "left_semi").select(
        F.col("doc_id").alias("id"), "t"
    ).distinct()
    copied = broadcast_if_small(cut_lineage(copied, "copies"), 32)
    lowest = broadcast_if_small(cut_lineage(many.select("low.id", "low.t"), "lowest"), 32)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("t"))
    texts = docs.select("doc_id", "text")
    alone = texts.join(copied, same, "left_anti").select("text")
    once = texts.join(lowest, same, "left_semi").dropDuplicates(["text"]).select("text")
    rare = rare_shingles(alone.union(once), shingle_order(described))
    tiles = contested(rare, groups)
    # first some sets of each group and tile, as most groups that belong together are joined by one of
    # their links; then all pairs between the groups that are left
    placed = cut_lineage(grouped_sets(tiles, groups), "placed")
    some = cut_lineage(rare_pairs(drawn_sets(placed), tile_blocks.crowded(placed)), "drawn-pairs")
    found = cut_lineage(verified(some.select("x", "y"), sets, docs), "drawn-links")
    links = links.union(found)
    groups = renamed_groups(groups, some.join(found, ["x", "y"], "left_semi"))
    placed = cut_lineage(grouped_sets(tiles, groups), "placed")
    crowd = tile_blocks.crowded(placed)
    rest = cut_lineage(rare_pairs(placed, crowd).select("x", "y"), "rare-pairs")
    links = links.union(verified(rest, sets, docs))
    if crowd.filter("mixed").limit(1).count():
        blocks = tile_blocks.block_rows(placed, crowd, sets)
        links = links.union(tile_blocks.block_links(blocks, lambda named: arrays_of(named, sets, docs), PERCENT, folded, linked))
    links = cut_lineage(links, "links")

    roots = components(links)
    joined = sets.select("a", "low", "copies").join(roots.select(F.col("node").alias("a"), "root"), "a", "left")
    grouped = joined.filter("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "a"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("least"))
    named = grouped.select("a", "root").join(lows, "root").select("a", "root", F.col("least.id").alias("component_id"))
    named = cut_lineage(named, "components")
    out = rows.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("a")).alias("a"))
    out = out.join(named.withColumn("found", F.lit(True)), "a", "left")
    return out.select(
        "doc_id",
        "t",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("found", F.lit(False)).alias("grouped"),
        "root",
    )


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; see ``link_groups``."""
    return link_groups(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id, and of several such
    rows the one of the smallest hash of the text. Documents without words stay. Columns are as
    they are; only ids and hashes are shuffled, and of rows that occur more than once the row."""
    found = cut_lineage(link_groups(docs).filter("grouped"), "grouped")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t"))
    keep = found.groupBy("root").agg(F.min(order).alias("w"))
    keep = keep.select(F.col("w.doc_id").alias("id"), "w.t")
    every = found.select(F.col("doc_id").alias("id"), "t").distinct()
    every = broadcast_if_small(cut_lineage(every, "grouped-rows"), 32)
    keep = broadcast_if_small(cut_lineage(keep, "kept-rows"), 32)
    columns = docs.columns
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_t") == F.col("t"))
    plain, at = anonymous(docs)
    plain = plain.withColumn("_id", F.col(at["doc_id"])).withColumn("_t", F.xxhash64(at["text"]))
    alone = plain.join(every, same, "left_anti")
    firsts = plain.join(keep, same, "left_semi").dropDuplicates(["_id", "_t"])
    return alone.union(firsts).drop("_id", "_t").toDF(*columns)
