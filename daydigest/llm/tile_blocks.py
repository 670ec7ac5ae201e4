"""Crowded tiles of the n-gram Jaccard join, compared block by block inside tasks.

A tile (a rare shingle and a band of sizes) that many sets share is cut into parts of its home sets (those of the
band) and of its guests (those of the band and the next), and every part of the one meets every part of the other in a
task of its own. The task holds the bitmaps, and then the sorted arrays of the sets that the bitmaps leave in
question; it writes the links that join two groups, of which there are fewer than sets. No pair is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daydigest.llm.common import broadcast_if_small
from daydigest.session import cut_lineage

# A tile of more pairs of home sets and guests than this is crowded.
CROWDED_PAIRS = 4096
# Sets of a part, and shingles that its largest sets may have together.
PART_SETS = 2048
PART_SHINGLES = 1 << 20
# Pairs and words of bitmaps that are looked at together, and shingles that are intersected together.
STEP_PAIRS = 1 << 18
STEP_WORDS = 1 << 21
# Crowded tiles that a set remembers it was in before; a pair is left to the first tile that both remember.
REMEMBERED = 32
TILE = ["key", "band"]


def roles(tiles: DataFrame) -> DataFrame:
    """Each row of ``tiles`` (key, a, n, place, band, ...) in the tiles it takes part in: at home in its own band, a guest
    in its own and in the one before."""
    part = F.array(
        F.struct(F.col("band").alias("band"), F.lit(True).alias("home")),
        F.struct(F.col("band").alias("band"), F.lit(False).alias("home")),
        F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("home")),
    )
    rest = [c for c in tiles.columns if c != "band"]
    return tiles.select(*rest, F.explode(part).alias("_part")).select(*rest, "_part.band", "_part.home")


def crowded(tiles: DataFrame) -> DataFrame:
    """key, band, homes, guests, mixed, widest of the crowded tiles, written; ``mixed`` if it has sets of several groups."""
    found = roles(tiles).groupBy(*TILE).agg(
        F.count_if("home").alias("homes"),
        F.count_if(~F.col("home")).alias("guests"),
        (F.min("group") < F.max("group")).alias("mixed"),
        F.max("n").alias("widest"),
    )
    return cut_lineage(found.filter(F.col("homes") * F.col("guests") > CROWDED_PAIRS), "crowded-tiles")


def block_rows(tiles: DataFrame, tile_sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of the mixed ones of ``tile_sizes`` with their bitmaps, in the blocks (key, band, i, j) they take part in,
    written."""
    size = F.least(F.lit(PART_SETS), F.greatest(F.lit(64), F.floor(F.lit(PART_SHINGLES) / F.col("widest"))))
    cut = tile_sizes.filter("mixed").select(
        *TILE, F.ceil(F.col("homes") / size).alias("home_parts"), F.ceil(F.col("guests") / size).alias("guest_parts")
    )
    rows = roles(tiles).join(broadcast_if_small(cut_lineage(cut, "tile-parts"), 32), TILE)
    before = Window.partitionBy("a", "band", "home").orderBy("place").rowsBetween(-REMEMBERED, -1)
    rows = rows.withColumn("earlier", F.collect_list("key").over(before))
    h = F.xxhash64("a", F.lit(1))
    mine = F.pmod(h, F.when(F.col("home"), F.col("home_parts")).otherwise(F.col("guest_parts")))
    others = F.when(F.col("home"), F.col("guest_parts")).otherwise(F.col("home_parts"))
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    placed = rows.select(
        *TILE,
        F.when(F.col("home"), F.col("_mine")).otherwise(F.col("_other")).alias("i"),
        F.when(F.col("home"), F.col("_other")).otherwise(F.col("_mine")).alias("j"),
        "home", "a", "n", "place", "group", "earlier",
    )
    return cut_lineage(placed.join(sets.select("a", "sig"), "a"), "block-rows")


def bit_rows(signatures: list[bytes], folded: Callable) -> np.ndarray:
    """The bitmaps, folded to the width of the narrowest, as rows of 64-bit words."""
    width = min(map(len, signatures))
    return np.stack([folded(np.frombuffer(s, np.uint8), width).view(np.uint64) for s in signatures])


def remembered(home: pd.DataFrame, guest: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each side a matrix of which earlier tiles its sets remember, of the tiles that both sides do."""
    lists = [side["earlier"].map(list).to_list() for side in (home, guest)]
    both = set().union(*lists[0]) & set().union(*lists[1])
    column = {key: k for k, key in enumerate(both)}
    out = []
    for side in lists:
        matrix = np.zeros((len(side), len(both)), np.float32)
        for row, keys in zip(matrix, side):
            row[[column[k] for k in keys if k in column]] = 1
        out.append(matrix)
    return out[0], out[1]


def candidates(home: pd.DataFrame, guest: pd.DataFrame, percent: int, folded: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``home``, places in ``guest``) of the pairs of different groups that sizes, the shared shingle's places and
    the bitmaps do not rule out, and that meet in no earlier crowded tile. Both sides are sorted by group."""
    bits = bit_rows([*home["sig"], *guest["sig"]], folded)
    p, q = bits[: len(home)], bits[len(home) :]
    ours, theirs = remembered(home, guest)
    (n, a, at, g), (m, b, to, f) = ([side[c].to_numpy(np.int64) for c in ("n", "a", "place", "group")] for side in (home, guest))
    words = bits.shape[1]
    rows = max(1, STEP_PAIRS // max(1, len(guest)))
    for first in range(0, len(home), rows):
        x = slice(first, first + rows)
        if g[x].min() == g[x].max() == f.min() == f.max():
            continue
        least = np.ceil((n[x, None] + m) * percent / (100.0 + percent))
        meet = (n[x, None] < m) | ((n[x, None] == m) & (a[x, None] < b))
        meet &= (g[x, None] != f) & (n[x, None] * 100 >= m * percent)
        meet &= np.minimum(n[x, None] - at[x, None], m - to) >= least
        if ours.shape[1]:
            meet &= ours[x] @ theirs.T == 0
        xs, ys = np.nonzero(meet)
        least = least[xs, ys]
        xs = xs + first
        for k in range(0, len(xs), max(1, STEP_WORDS // words)):
            i, j = xs[k : k + STEP_WORDS // words], ys[k : k + STEP_WORDS // words]
            most = np.minimum(
                n[i] - np.bitwise_count(p[i] & ~q[j]).sum(axis=1, dtype=np.int64),
                m[j] - np.bitwise_count(q[j] & ~p[i]).sum(axis=1, dtype=np.int64),
            )
            left = most >= least[k : k + STEP_WORDS // words]
            yield i[left], j[left]


def sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    rows = rows.sort_values(["group", "a"], kind="stable")
    return rows[rows["home"]].reset_index(drop=True), rows[~rows["home"]].reset_index(drop=True)


def block_links(rows: DataFrame, arrays_of: Callable[[DataFrame], DataFrame], percent: int, folded: Callable, linked: Callable) -> DataFrame:
    """(x, y): links that join two groups, from every block of ``rows`` (a table of ``block_rows``). ``arrays_of`` gives the
    sorted arrays (a, shingles) of the sets named in a table (a); they are read for those sets alone that some bitmap
    leaves in question."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    block = [*TILE, "i", "j"]

    def doubt(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        home, guest = sides(some)
        found = np.zeros(len(home), bool), np.zeros(len(guest), bool)
        if len(home) and len(guest):
            for i, j in candidates(home, guest, percent, folded):
                found[0][i], found[1][j] = True, True
        left = pd.concat([home[found[0]], guest[found[1]]])[["home", "a"]]
        return left.assign(**dict(zip(block, key)))[[*block, "home", "a"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*block, "home", "a"))
    open_rows = cut_lineage(rows.groupBy(*block).applyInPandas(doubt, schema), "sets-in-question")
    arrays = arrays_of(open_rows.select("a").distinct())
    again = rows.join(open_rows, [*block, "home", "a"], "left_semi").join(arrays, "a")

    def decide(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        home, guest = sides(some)
        out = []
        if len(home) and len(guest):
            names, root = np.unique(np.concatenate([home["group"], guest["group"]]), return_inverse=True)
            mine, theirs, root = root[: len(home)], root[len(home) :], np.arange(len(names))
            # sorted as unsigned numbers
            x, y = ([np.asarray(v).view(np.uint64) for v in side["shingles"]] for side in (home, guest))
            size = np.array([len(v) for v in y], np.int64)
            ids, others = home["a"].to_numpy(), guest["a"].to_numpy()
            for i, j in candidates(home, guest, percent, folded):
                for at, first in zip(*np.unique(i, return_index=True)):
                    them = j[first : np.searchsorted(i, at, "right")]
                    own = x[at]
                    while len(them):
                        them = them[root[theirs[them]] != root[mine[at]]]
                        # so many of them at once as bring one step's shingles
                        now, them = np.split(them, [max(1, int(np.searchsorted(np.cumsum(size[them]), STEP_PAIRS)))])
                        if not len(now):
                            break
                        flat = np.concatenate([y[k] for k in now])
                        spot = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                        both = np.add.reduceat(own[spot] == flat, np.cumsum(size[now]) - size[now], dtype=np.int64)
                        for k in now[linked(both, len(own), size[now])]:
                            one, other = root[mine[at]], root[theirs[k]]
                            if one != other:
                                root[root == other] = one
                                out.append((ids[at], others[k]))
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64") if out else pd.DataFrame()

    return again.groupBy(*block).applyInPandas(decide, "x long, y long")
