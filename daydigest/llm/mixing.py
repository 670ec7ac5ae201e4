"""Mixing sources to target weights by Pfair scheduling. Only DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daydigest.llm.common import anonymous, broadcast_if_small, dense_positions
from daydigest.session import cut_lineage

# Slots of the schedule after which it repeats; weights are multiples of one slot.
PERIOD = 1000
# Slots times sources up to which one row folds the schedule; beyond, it is made from rows.
FOLD_STEPS = 1_000_000
# Halvings of the schedule's blocks between two written tables.
HALVINGS = 5
# Rows of a block, the unit that is scheduled.
BLOCK_ROWS = 50
# Power of a source's row count that is its target weight, and the share of all weight at which the mixture ends: as soon
# as sources of so much weight have run out. At 1 it ends with the last source, and no row is left out.
EXPONENT = 0.75
END = 0.5


def target_units(counts: DataFrame, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """Slots of a period for each source: source, rows, units (at least 1, ``period`` in all).

    The target weight is a source's row count to the power ``exponent``: below 1 large sources give
    way to small ones, at 1 each has its own share, at 0 all have the same. Counts are rounded to whole units by
    largest remainder (ties: name). ``counts`` (source, rows) has a row for each source, fewer than ``period``.
    """
    one = Window.partitionBy(F.lit(0))
    if exponent == 0.75:
        # roots are rounded alike on every machine
        size = (F.sqrt("rows") * F.sqrt(F.sqrt("rows")) * 1000).cast("long")
    else:
        size = (F.pow("rows", F.lit(float(exponent))) * 1000).cast("long")
    spare = period - F.count(F.lit(1)).over(one)
    share = counts.withColumn("_size", size).withColumn("_spare", spare)
    exact = share.withColumn("_product", F.col("_size") * F.col("_spare")).withColumn("_all", F.sum("_size").over(one))
    whole = exact.withColumn("_units", F.expr("_product div _all")).withColumn("_rest", F.col("_product") % F.col("_all"))
    place = F.row_number().over(one.orderBy(F.desc("_rest"), F.asc_nulls_first("source")))
    more = (place <= F.col("_spare") - F.sum("_units").over(one)).cast("long")
    return whole.select("source", "rows", (F.col("_units") + more + 1).alias("units"))


def schedule(units: DataFrame, period: int = PERIOD) -> DataFrame:
    """One period by earliest deadline first: slot, source, turn (which of the source's blocks).

    Block j (from 0) of a source with u units may run from slot floor(j * period / u) and has
    the deadline ceil((j + 1) * period / u). Each slot takes, of the blocks released by then,
    the one of the earliest deadline (ties: by the sources' order), so that no source is ever a
    block or more away from its weight. One row holds all sources: for few of them, see
    ``schedule_rows``.
    """
    sources = units.agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("all"))
    fold = f"""aggregate(
        sequence(0, {period - 1}),
        named_struct('done', transform(all, x -> 0L), 'picks', cast(array() as array<int>)),
        (s, t) -> element_at(transform(
            array(array_min(transform(
                filter(sequence(0, size(all) - 1), i ->
                    s.done[i] < all[i].units and (s.done[i] * {period}L) div all[i].units <= t),
                i -> named_struct(
                    'deadline', ((s.done[i] + 1L) * {period}L + all[i].units - 1L) div all[i].units,
                    'i', i)))),
            best -> named_struct(
                'done', transform(s.done, (n, i) -> if(i = best.i, n + 1L, n)),
                'picks', concat(s.picks, array(best.i)))), 1),
        s -> s.picks)"""
    picks = sources.filter(F.size("all") > 0).select("all", F.posexplode(F.expr(fold)).alias("slot", "pick"))
    turn = F.row_number().over(Window.partitionBy("pick").orderBy("slot")) - 1
    return picks.select(
        "slot",
        F.expr("all[pick].source").alias("source"),
        F.expr("all[pick].units").alias("units"),
        turn.cast("long").alias("turn"),
    )


def schedule_rows(units: DataFrame, period: int = PERIOD) -> DataFrame:
    """The table of ``schedule`` for any number of sources, from a row for each block and slot.

    By earliest deadline first the slots of the blocks of the earlier deadlines do not depend on
    the others: a slot is theirs if one of them is released and still waits there. So the blocks,
    numbered by deadline and source, are halved, the first half gets its slots and the second the
    rest, and both halves go on alone until each block has one slot. What waits is a running sum
    over releases and slots that starts anew at its least value.
    """
    j = F.explode(F.expr("sequence(0L, units - 1L)")).alias("turn")
    blocks = units.filter("units > 0").select("source", F.col("units").cast("long").alias("units")).select("source", "units", j)
    deadline = F.expr(f"((turn + 1L) * {period}L + units - 1L) div units")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(deadline, F.asc_nulls_first("source"))) - 1
    blocks = cut_lineage(blocks.withColumn("rank", rank.cast("long")), "blocks")
    spark, none = units.sparkSession, F.lit(None).cast("long")
    rows = blocks.select(F.expr(f"(turn * {period}L) div units").alias("time"), "rank")
    rows = rows.union(spark.range(period).select("id", none)).withColumn("node", F.lit(0).cast("long"))
    levels = (period - 1).bit_length()
    for level in range(levels):
        late = F.shiftright("rank", levels - level - 1).bitwiseAND(F.lit(1))
        # a release at a time comes before the slot
        order = Window.partitionBy("node").orderBy("time", F.col("rank").isNull())
        step = F.when(F.col("rank").isNull(), -1).otherwise(1 - late)
        rows = rows.withColumn("_sum", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        least = F.min("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_least", F.least(least, F.lit(0)))
        half = F.when(F.col("rank").isNotNull(), late).otherwise((F.col("_sum") < F.col("_least")).cast("long"))
        rows = rows.select("time", "rank", (2 * F.col("node") + half).alias("node"))
        if level % HALVINGS == HALVINGS - 1:
            rows = cut_lineage(rows, "halves")
    # the last halves are numbered as the blocks are
    slots = rows.filter("rank IS NULL").select(F.col("time").alias("slot"), F.col("node").alias("rank"))
    return cut_lineage(slots.join(blocks, "rank").select("slot", "source", "units", "turn"), "slots")


def narrow_rows(docs: DataFrame) -> DataFrame:
    """source, doc_id, digest (hash of the text) of each document, written once: all that is planned and numbered
    comes from this table, and the texts are read no more for it."""
    return cut_lineage(docs.select("source", "doc_id", F.xxhash64("text").alias("digest")), "mixed-rows")


def source_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))


def plan(rows: DataFrame, units: DataFrame | None, period: int, block_rows: int, exponent: float = EXPONENT, end: float = END):
    """The period, its schedule, and for each source its units and how many of its first rows the
    mixture takes (``quota``); both tables grow with the sources alone. Without given ``units`` the
    period grows to four slots for each source. ``rows`` is a written table."""
    if not 0 < end <= 1:
        raise ValueError("the mixture ends at a share of the weight above 0 and up to 1")
    counts = cut_lineage(source_counts(rows), "source-counts")
    n = counts.count()
    if units is None:
        period = max(period, 4 * n)
    elif units.agg(F.sum("units")).first()[0] != period:
        raise ValueError(f"the units of all sources are {period} together")
    shares = target_units(counts, period, exponent) if units is None else units.join(
        counts, units["source"].eqNullSafe(counts["source"])
    ).select(counts["source"], "rows", "units")
    few = n * period <= FOLD_STEPS
    if not few:
        shares = cut_lineage(shares, "shares")
    slots = (schedule if few else schedule_rows)(shares.select("source", "units"), period)
    blocks = F.expr(f"(rows + {block_rows - 1}) div {block_rows}")
    # a source has run out at the slot of the first block that it no longer has
    none = shares.withColumn("_blocks", blocks)
    final = none.join(
        slots.select(F.col("source").alias("_s"), "slot", "turn"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("turn") == F.col("_blocks") % F.col("units")),
    ).withColumn("_end", F.expr(f"(_blocks div units) * {period}L + slot"))
    # the mixture ends when the sources that have run out hold at least the share ``end`` of the weight
    by_end = Window.partitionBy(F.lit(0)).orderBy("_end").rangeBetween(Window.unboundedPreceding, 0)
    over = final.withColumn("_gone", F.sum("units").over(by_end))
    ends = over.withColumn(
        "_horizon",
        F.min(F.when(F.col("_gone") >= min(period, math.ceil(end * period)), F.col("_end"))).over(Window.partitionBy(F.lit(0))),
    )
    head = ends.select(F.col("source").alias("_s"), "rows", "units", "_horizon")
    full = F.expr(f"(_horizon div {period}) * units")
    counted = head.join(slots.select("source", "slot"), F.col("_s").eqNullSafe(F.col("source"))).groupBy(
        "_s", "rows", "units", "_horizon"
    ).agg(F.count_if(F.col("slot") < F.col("_horizon") % period).alias("_part"))
    quota = F.least(F.col("rows"), (full + F.col("_part")) * block_rows)
    return period, slots, counted.select(F.col("_s").alias("source"), "units", quota.alias("quota"))


def positions(rows: DataFrame) -> DataFrame:
    """Each document's place within its source (source, doc_id, digest, place), in hash order."""
    return dense_positions(rows, "source", ["doc_id", "digest"], "place", rows.count())


def mix(
    docs: DataFrame,
    units: DataFrame | None = None,
    period: int = PERIOD,
    block_rows: int = BLOCK_ROWS,
    exponent: float = EXPONENT,
    end: float = END,
) -> DataFrame:
    """When each document runs: source, doc_id, block, slot, release, deadline, row_in_block,
    in_mix; a row for each document.

    The rows of a source stand in hash order and are cut into blocks; the slots order the blocks of
    all sources (``slot``, then ``row_in_block``). While a source lasts, it is less than one block
    away from its weight after every slot. A source that has run out leaves its slots empty;
    ``in_mix`` is true up to the slot at which sources of the share ``end`` of the weight have run out;
    behind it the target can no longer be held. With ``end`` 1 it is true for every row. ``units`` (source, units;
    ``period`` in all) gives other weights than ``target_units``; sources without units are left out. A null source is a source, a null text is a text;
    repeated rows have places of their own; an empty table gives no rows.
    """
    rows = narrow_rows(docs)
    period, slots, quotas = plan(rows, units, period, block_rows, exponent, end)
    placed = positions(rows).withColumn("block", F.expr(f"place div {block_rows}"))
    run = slots.join(
        quotas.select(F.col("source").alias("_s"), "quota"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(F.col("source").alias("_source"), F.col("slot").alias("_slot"), "units", "turn", "quota")
    # one row for each source and turn
    run = cut_lineage(run, "turns")
    first = cut_lineage(run.select("_source", "units", "quota").distinct(), "quotas")
    with_units = placed.join(broadcast_if_small(first, 64), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    turns = run.select("_source", "_slot", "turn")
    met = with_units.join(
        broadcast_if_small(turns, 64),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") % F.col("units") == F.col("turn")),
    )
    return met.select(
        "source",
        "doc_id",
        "block",
        F.expr(f"(block div units) * {period}L + _slot").alias("slot"),
        F.expr(f"(block * {period}L) div units").alias("release"),
        F.expr(f"((block + 1) * {period}L + units - 1) div units").alias("deadline"),
        F.expr(f"place % {block_rows}").alias("row_in_block"),
        (F.col("place") < F.col("quota")).alias("in_mix"),
    )


def mixed_documents(
    docs: DataFrame,
    units: DataFrame | None = None,
    period: int = PERIOD,
    block_rows: int = BLOCK_ROWS,
    exponent: float = EXPONENT,
    end: float = END,
) -> DataFrame:
    """The documents of the mixture, all columns as they are; see ``mix``. With ``end`` 1 those are all documents of sources
    that have units.

    A source's rows stand in hash order, so its share ends at the hash of one row: the table of
    these ends is as small as that of the sources, and no text is shuffled. Copies of that last
    row stay together. A column is never added or changed.
    """
    rows = narrow_rows(docs)
    _, _, quotas = plan(rows, units, period, block_rows, exponent, end)
    want = cut_lineage(quotas.filter("quota > 0").select(F.col("source").alias("_s"), "quota"), "quotas")
    plain, at = anonymous(docs)
    doc_id, digest = F.col(at["doc_id"]), F.xxhash64(at["text"])
    order = [F.shiftrightunsigned(F.xxhash64(doc_id, digest), 33), doc_id, digest]
    last = positions(rows).join(
        broadcast_if_small(want, 64), F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("quota") - 1)
    )
    marks = last.select(
        F.col("_s"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "digest"), 33).alias("_m0"),
        F.col("doc_id").alias("_m1"),
        F.col("digest").alias("_m2"),
    )
    # nulls sort first in a window, so they do here
    before = (order[0] < F.col("_m0")) | (
        (order[0] == F.col("_m0"))
        & (
            (order[1].isNull() & F.col("_m1").isNotNull())
            | (order[1] < F.col("_m1"))
            | (order[1].eqNullSafe(F.col("_m1")) & (order[2] <= F.col("_m2")))
        )
    )
    marks = broadcast_if_small(cut_lineage(marks, "marks"), 64)
    kept = plain.join(marks, F.col(at["source"]).eqNullSafe(F.col("_s")) & before, "left_semi")
    return kept.toDF(*docs.columns)
