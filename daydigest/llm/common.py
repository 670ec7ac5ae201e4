"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only when its rows times its row width stay below this.
BROADCAST_BYTES = 16 * 1024 * 1024
# Rows that a Python worker gets at once; texts are long, so the default would take hundreds of MB.
BATCH_ROWS = 1000
# Rows of a group that one task numbers on average.
BUCKET_ROWS = 5_000
# Copies of one row that one task writes out.
COPY_BLOCK = 65_536


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of ``BATCH_ROWS`` from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def anonymous(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each column, so that no name of its own
    meets one that an operator adds."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), {c: f"c{i}" for i, c in enumerate(docs.columns)}


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows times ``row_bytes`` stay below the
    limit; else unmarked, so that the join shuffles both sides. Give a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dense_positions(rows: DataFrame, group: str, order: list[str], out: str, total: int) -> DataFrame:
    """``rows`` with ``out``, their gapless number from 0 within ``group``, in the order of a
    hash of ``order`` and then of ``order`` itself.

    ``rows`` holds ``group`` and ``order`` only. Equal rows are counted before the shuffle and
    written out again behind it, in blocks; a group is cut into ranges of the hash that are
    numbered apart, and only their row counts are summed up. So neither a hot group nor a hot
    row meets in one task. ``total`` is the number of rows.
    """
    buckets = max(1, -(-total // BUCKET_ROWS))
    # the top 31 bits of the hash, cut into equal ranges: the order of the buckets is that of the hash
    spot = F.shiftrightunsigned(F.xxhash64(*order), 33)
    counted = (
        rows.select(group, *order)
        .groupBy(group, *order)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_spot", spot)
        .withColumn("_bucket", F.shiftright(F.col("_spot") * F.lit(buckets), 31))
    )
    within = Window.partitionBy(group, "_bucket").orderBy("_spot", *order)
    numbered = counted.withColumn(
        "_before", F.coalesce(F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    sizes = counted.groupBy(group, "_bucket").agg(F.sum("_copies").alias("_rows"))
    across = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("_group"),
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_offset"),
    )
    placed = numbered.join(
        offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of"))
    ).withColumn("_first", F.col("_offset") + F.col("_before"))
    blocks = placed.withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPY_BLOCK).cast("long")))
    )
    if placed.filter(F.col("_copies") > COPY_BLOCK).limit(1).count():
        blocks = blocks.repartition(F.xxhash64("_start", *order))
    last = F.least(F.col("_start") + COPY_BLOCK, F.col("_copies")) - 1
    return blocks.select(
        group, *order, F.explode(F.sequence(F.col("_first") + F.col("_start"), F.col("_first") + last)).alias(out)
    )
