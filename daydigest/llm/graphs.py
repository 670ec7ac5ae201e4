"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.session import BROADCAST_BYTES, cut_lineage


# Rows of the edge table that one task of a round takes.
EDGES_A_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (x, y: long); root is the smallest node that links
    reach. Large and small stars in turn until the edges are stars: each round sends every edge to
    the smallest neighbour of one of its ends, and is written, so that a lost executor costs one
    round. Edges run from the larger node to the smaller one. A node's neighbours are never
    gathered, only their minimum. The rounds run in as many tasks as their edges need."""
    oriented = links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    edges = cut_lineage(oriented.filter("x <> y").distinct(), "edges")
    n, loose = measure(edges)
    while loose:
        tasks = max(8, -(-n // EDGES_A_TASK))
        # no table of a round has more rows than twice its edges
        side = F.broadcast if 2 * n * 16 <= BROADCAST_BYTES else lambda table: table
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy(F.col("x").alias("u")).agg(F.least(F.min("y"), F.min("x")).alias("m"))
        # the larger neighbours of u go to the least one
        large = both.filter("y > x").join(side(least), F.col("x") == F.col("u"))
        large = large.select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        large = cut_lineage(large.distinct().coalesce(tasks), "edges")
        # u and its smaller neighbours go to the least of them
        lowest = large.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m"))
        small = large.join(side(lowest), F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = small.union(lowest.select("u", "m")).filter("x <> y")
        edges = cut_lineage(small.distinct().coalesce(tasks), "edges")
        n, loose = measure(edges)
    stars = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def measure(edges: DataFrame) -> tuple[int, int]:
    """Number of the edges (x larger than y), and of the nodes that keep them from being stars: those
    with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("x").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("y", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    loose = F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), loose).first())
