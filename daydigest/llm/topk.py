"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are dealt into blocks. In a block every non-zero component is a posting (vector, impact) of
its axis; postings lie in levels of descending size of the impact and, within a level, in one
segment for each axis. A query adds up whole levels. What a vector may still gain or lose in
the levels left is bounded by the norms of query and remaining components; a block stops when
that proves that few vectors can be among the k best, and scores those exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daydigest.session import cut_lineage

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
LEVELS = 8
# Queries whose scores are held at once, for all vectors of a block.
AT_ONCE = 128


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """True where a vector is there and all components are finite numbers."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return F.coalesce(finite, F.lit(False))


def number_type(size: int, left: int, right: int):
    """The fastest type that holds sums of ``size`` products exactly."""
    most = size * left * right
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def build_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The index of one block: a row for its vectors (level -1) and a row for each level of
    postings, largest impacts first."""
    size, block = key
    rows = rows.sort_values(["vec_id", "tag"], kind="stable")
    dense = np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), size)
    head = {
        "ids": rows["vec_id"].to_numpy(np.int64).tobytes(),
        "tags": rows["tag"].to_numpy(np.int64).tobytes(),
        "values": dense.tobytes(),
        "starts": rows["copies"].to_numpy(np.int64).tobytes(),
        "level": -1,
    }
    out = [head]
    at, axis = np.nonzero(dense)
    impact = dense[at, axis]
    order = np.argsort(-np.abs(impact), kind="stable")
    for level, part in enumerate(np.array_split(order, LEVELS)):
        part = part[np.lexsort((at[part], axis[part]))]
        out.append(
            {
                "ids": at[part].astype(np.int32).tobytes(),
                "tags": b"",
                "values": impact[part].tobytes(),
                "starts": np.searchsorted(axis[part], np.arange(size + 1)).astype(np.int64).tobytes(),
                "level": level,
            }
        )
    return pd.DataFrame(out).assign(dims=size, block=block)


INDEX = "dims int, block int, level int, ids binary, tags binary, values binary, starts binary"
FOUND = "query_id long, query_tag long, query_copies long, vec_id long, score long, copies long"


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= floor)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


def search_block(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of one block for each query."""
    if index.empty or queries.empty:
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype("int64")
    index = index.sort_values("level")
    head = index.iloc[0]
    size = int(head["dims"])
    ids = np.frombuffer(head["ids"], np.int64)
    tags = np.frombuffer(head["tags"], np.int64)
    copies = np.frombuffer(head["starts"], np.int64)
    dense = np.frombuffer(head["values"], np.int64).reshape(len(ids), size)
    asked = np.array(queries["vector"].tolist(), np.int64).reshape(len(queries), size)
    most = [int(np.abs(x).max(initial=0)) for x in (dense, asked)]
    kind = number_type(max(size, 1), *most)
    levels = []
    left = (dense.astype(np.float64) ** 2).sum(axis=1)
    for row in index.iloc[1:].itertuples():
        at, impact = np.frombuffer(row.ids, np.int32), np.frombuffer(row.values, np.int64)
        left = left - np.bincount(at, impact.astype(np.float64) ** 2, minlength=len(ids))
        rest = np.sqrt(np.maximum(left, 0)) * (1 + 1e-6) + 1e-3
        levels.append((at, impact.astype(kind), np.frombuffer(row.starts, np.int64), rest))
    exact = dense.astype(kind)
    out = []
    for first in range(0, len(asked), AT_ONCE):
        part = asked[first : first + AT_ONCE].astype(kind)
        who = queries.iloc[first : first + AT_ONCE]
        norms = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
        # a query's own row counts once less: without copies it takes no part
        own = (ids[:, None] == who["vec_id"].to_numpy()[None, :]) & (tags[:, None] == who["tag"].to_numpy()[None, :])
        gone = own & (copies[:, None] == 1)
        sums = np.zeros((len(ids), len(part)), kind)
        possible = None
        for n, (at, impact, starts, rest) in enumerate(levels):
            for axis in range(size):
                seg = slice(starts[axis], starts[axis + 1])
                sums[at[seg]] += impact[seg, None] * part[None, :, axis]
            if n + 1 == len(levels) or 2 * (n + 1) < len(levels) or len(ids) <= 8 * k or kind is object:
                continue
            slack = rest[:, None] * norms[None, :]
            low = np.where(gone, -np.inf, sums - slack)
            kth = np.partition(low, len(ids) - k, axis=0)[len(ids) - k]
            reach = (sums + slack >= kth[None, :]) & ~gone
            if reach.sum() <= reach.size // 8:
                possible = reach
                break
        for j, row in enumerate(who.itertuples()):
            there = np.flatnonzero(~gone[:, j] if possible is None else possible[:, j])
            scores = sums[there, j] if possible is None else exact[there] @ part[j]
            # what a long holds
            scores = scores.astype(np.int64) if kind is not object else np.array(
                [max(min(int(s), 2**63 - 1), -(2**63) + 1) for s in scores], np.int64
            )
            pick = best_of(scores, ids[there], k)
            out.append(
                pd.DataFrame(
                    {
                        "query_id": row.vec_id,
                        "query_tag": row.tag,
                        "query_copies": row.copies,
                        "vec_id": ids[there][pick],
                        "score": scores[pick],
                        "copies": copies[there][pick] - own[there, j][pick],
                    }
                )
            )
    return pd.concat(out)


def prepared(vectors: DataFrame) -> DataFrame:
    """Distinct rows (vec_id, vector, dims, tag, copies); tag is a hash of the vector. Rows without
    an id or a usable vector are left out."""
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("vector")).filter(
        F.col("vec_id").isNotNull() & usable(vectors["embedding"])
    )
    counted = rows.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "vector",
        F.size("vector").alias("dims"),
        F.xxhash64("vector").alias("tag"),
        "copies",
    )


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The index table of prepared rows, a few rows for each of ``blocks`` blocks."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", "block").applyInPandas(build_block, INDEX)


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) where
    ``is_query`` holds, the ``k`` rows of highest inner product but the row itself.

    Ties go to the smaller vec_id. Repeated rows are candidates and queries each; rows of equal
    id and other vector are too. Vectors of different length are not compared. Scores beyond a
    long are set to its ends. Blocks of vectors meet blocks of queries on equal keys, and each
    meeting returns k rows a query; the blocks' sizes bound a task's memory at every scale.
    """
    rows = cut_lineage(prepared(vectors), "vectors")
    asked = rows.filter(is_query)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    index = cut_lineage(build_index(rows, blocks), "impact-index")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("tag", "vec_id"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keys = ["dims", "block", "part"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(lambda a, b: search_block(a, b, k), FOUND)
    )
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id", "query_tag").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies"))).select(
        "query_id", "rank", "vec_id", "score"
    )
