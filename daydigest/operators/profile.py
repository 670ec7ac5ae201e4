"""Profiling of the consolidated corpus and query tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from daydigest.session import cut_lineage, small_side

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
# Share of the rows by which a window reaches to either side of a wanted place; a sketch is off by a share of
# 1 / ACCURACY at most.
MARGIN = 0.001
ACCURACY = 10_000
# Distinct values of a window that one task numbers, and ranges into which a larger one is cut.
WINDOW_VALUES = 200_000
PARTS = 200


def days_per_event(df: DataFrame) -> DataFrame:
    """Distinct days per event; days are made distinct before they are counted."""
    days = df.select("event", "event_name", "date").filter(F.col("date").isNotNull()).distinct()
    return days.groupBy("event", "event_name").agg(F.count("*").alias("unique_days"))


def documents_per_event(df: DataFrame) -> DataFrame:
    return df.groupBy("event").agg(F.count("*").alias("document_count"))


def queries_per_event(queries: DataFrame) -> DataFrame:
    return queries.groupBy(F.col("event_id").alias("event")).agg(F.count("*").alias("query_count"))


def event_chart(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Days, queries and documents of each event."""
    chart = days_per_event(df).join(queries_per_event(queries), "event")
    return chart.join(documents_per_event(df), "event")


def time_range(df: DataFrame) -> DataFrame:
    times = F.timestamp_seconds("unix_timestamp")
    return df.groupBy("event").agg(F.min(times).alias("start_time"), F.max(times).alias("end_time"))


def _long(row: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One wide row of per-column values as (column_name, value) rows."""
    return row.unpivot([], [F.col(c) for c in columns], "column_name", name)


def missing(field) -> F.Column:
    """True for nulls, and in columns of floating numbers for NaN too."""
    column = F.col(field.name)
    if isinstance(field.dataType, (DoubleType, FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    counted = df.agg(*[F.count_if(missing(f)).alias(f.name) for f in df.schema.fields])
    return _long(counted, df.columns, "n_null")


def schema_info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of each column, and the number of rows."""
    counted = df.agg(
        *[F.count(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("n_rows_all")
    )
    types = dict(df.dtypes)
    named = F.create_map(*[F.lit(v) for c in df.columns for v in (c, types[c])])
    return counted.unpivot(
        ["n_rows_all"], [F.col(c) for c in df.columns], "column_name", "n_present"
    ).select(
        "column_name",
        named[F.col("column_name")].alias("data_type"),
        "n_present",
        F.col("n_rows_all").alias("n_rows"),
    )


def distinct_values(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """(column_name, value[, first_seen]) of each distinct value, in one pass over the rows."""
    keep = [F.col(order).alias("_seen")] if order else []
    wide = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    long = wide.unpivot(["_seen"] if order else [], columns, "column_name", "value")
    if not order:
        return long.distinct()
    return long.groupBy("column_name", "value").agg(F.min("_seen").alias("first_seen"))


def _positions(total: int) -> dict[str, tuple[int, int, float]]:
    """For each quartile the places (from 0) of the two values around it and the share of the way
    from one to the other."""
    wanted = {stat: q * (total - 1) for stat, q in QUARTILES.items()}
    return {stat: (math.floor(p), math.ceil(p), p - math.floor(p)) for stat, p in wanted.items()}


def _windows(wide: DataFrame, totals: dict[str, int]) -> dict[tuple[str, str], tuple[float, float, int]]:
    """(low, high, rows below low) of a window of values around each wanted place of each column.

    The bounds are taken from a sketch, a margin of rows to either side, and checked by counting the rows below
    and within: a bound that the sketch put too near is taken anew from twice the margin.
    """
    found: dict[tuple[str, str], tuple[float, float, int]] = {}
    margin = MARGIN
    while open_ := [(c, stat) for c, total in totals.items() if total for stat in QUARTILES if (c, stat) not in found]:
        names = list(dict.fromkeys(c for c, _ in open_))
        shares = [min(1.0, max(0.0, q + side)) for q in QUARTILES.values() for side in (-margin, margin)]
        sketched = wide.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in names]).first()
        bounds = {}
        for c, stat in open_:
            at = 2 * list(QUARTILES).index(stat)
            bounds[c, stat] = (sketched[c][at], sketched[c][at + 1]) if margin < 0.5 else (-math.inf, math.inf)
        counted = wide.agg(
            *[F.count_if(F.col(c) < bounds[c, stat][0]) for c, stat in open_],
            *[F.count_if(F.col(c) <= bounds[c, stat][1]) for c, stat in open_],
        ).first()
        for n, (c, stat) in enumerate(open_):
            first, last, _ = _positions(totals[c])[stat]
            if counted[n] <= first and last < counted[len(open_) + n]:
                found[c, stat] = (*bounds[c, stat], counted[n])
        margin *= 2
    return found


def _inside(wide: DataFrame, windows: dict[tuple[str, str], tuple[float, float, int]]) -> DataFrame:
    """(column_name, stat, value, n) of the values within the windows, counted on the map side."""
    within = {key: F.col(key[0]).between(low, high) for key, (low, high, _) in windows.items()}
    near = reduce(lambda a, b: a | b, [F.coalesce(w, F.lit(False)) for w in within.values()])
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(stat).alias("stat"), F.when(w, F.col(c)).alias("value"))
                for (c, stat), w in within.items()
            ]
        )
    )
    rows = wide.filter(near).select(each.alias("e")).select("e.*").filter("value is not null")
    return rows.groupBy("column_name", "stat", "value").agg(F.count("*").alias("n"))


KEYS = ["column_name", "stat"]


def _narrowed(inside: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after every window was cut into ``PARTS`` ranges of its distinct values and only the ranges of its
    wanted places were kept. Rows are summed up per range; no window is numbered whole."""
    shares = [i / PARTS for i in range(PARTS)]
    ends = inside.groupBy(*KEYS).agg(F.percentile_approx("value", shares, ACCURACY).alias("cuts"))
    cuts = ends.select(*KEYS, F.explode(F.array_distinct("cuts")).alias("low"))
    order = Window.partitionBy(*KEYS).orderBy("low")
    ranges = cut_lineage(cuts.withColumn("high", F.lead("low").over(order)), "value-ranges")
    ranges = small_side(ranges, ranges.count(), 64)
    within = (F.col("value") >= F.col("low")) & (F.col("high").isNull() | (F.col("value") < F.col("high")))
    same = (F.col("column_name") == F.col("of_column_name")) & (F.col("stat") == F.col("of_stat"))
    ranged = inside.join(ranges.withColumnsRenamed({c: f"of_{c}" for c in KEYS}), same & within)
    sums = cut_lineage(ranged.groupBy(*KEYS, "low", "high").agg(F.sum("n").alias("n")), "range-sums")
    seen = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("seen", seen).join(wanted, KEYS)
    end = F.col("seen") + F.col("n")
    kept = placed.filter((F.col("first") < end) & (F.col("last") >= F.col("seen")))
    kept = kept.groupBy(*KEYS, "first", "last").agg(
        F.min("low").alias("low"), F.max(F.struct("low", "high")).getField("high").alias("high"), F.min("seen").alias("seen")
    )
    kept = cut_lineage(kept, "kept-ranges")
    left = inside.join(small_side(kept, kept.count(), 128), KEYS).filter(within).select(*KEYS, "value", "n")
    moved = kept.select(*KEYS, (F.col("first") - F.col("seen")).alias("first"), (F.col("last") - F.col("seen")).alias("last"))
    return cut_lineage(left, "window-values"), moved


def _quartiles(wide: DataFrame, totals: dict[str, int]) -> dict[tuple[str, str], float]:
    """Exact interpolated quartiles of each column.

    A window of one value is the answer itself. Of the others only the values within are shuffled, counted,
    and numbered once they are few; so no task sees a whole column, or a window of unknown size.
    """
    windows = _windows(wide, totals)
    found = {key: low for key, (low, high, _) in windows.items() if low == high}
    several = {key: w for key, w in windows.items() if key not in found}
    if not several:
        return found
    places = {key: _positions(totals[key[0]])[key[1]] for key in several}
    wanted = wide.sparkSession.createDataFrame(
        [(*key, places[key][0] - below, places[key][1] - below) for key, (_, _, below) in several.items()],
        "column_name string, stat string, first long, last long",
    )
    inside = cut_lineage(_inside(wide, several), "window-values")
    while inside.groupBy(*KEYS).count().agg(F.max("count")).first()[0] > WINDOW_VALUES:
        inside, wanted = _narrowed(inside, wanted)
    order = Window.partitionBy(*KEYS).orderBy("value")
    numbered = inside.withColumn("end", F.sum("n").over(order)).join(small_side(wanted, len(several)), KEYS)

    def at(place: str) -> F.Column:
        return F.min(F.when(F.col(place) < F.col("end"), F.col("value"))).alias(place)

    for row in numbered.groupBy(*KEYS).agg(at("first"), at("last")).collect():
        key = (row["column_name"], row["stat"])
        low, high = row["first"], row["last"]
        found[key] = low if low == high else low + (high - low) * places[key][2]
    return found


def describe(df: DataFrame) -> DataFrame:
    """(column_name, stat, value): count, mean, std, min, quartiles and max of numbers. NaN is
    missing; a column without a number has the count 0 and nulls."""
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    names = {f"c{i}": f.name for i, f in enumerate(numeric)}
    wide = df.select(
        *[F.when(~missing(f), F.col(f.name)).cast("double").alias(c) for c, f in zip(names, numeric)]
    )
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    schema = "column_name string, stat string, value double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    row = wide.agg(*[of(c).alias(f"{c}_{stat}") for c in names for stat, of in moments.items()]).first()
    quartiles = _quartiles(wide, {c: row[f"{c}_count"] for c in names})
    rows = [(name, stat, row[f"{c}_{stat}"]) for c, name in names.items() for stat in moments]
    rows += [(name, stat, quartiles.get((c, stat))) for c, name in names.items() for stat in QUARTILES]
    return df.sparkSession.createDataFrame([(c, stat, None if v is None else float(v)) for c, stat, v in rows], schema)
