"""Publishing: cleaning by table, loading a folder, and the read views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.operators.context import ALL, of_request
from daydigest.operators.digest import by_date_and
from daydigest.sinks.writers import exists, insert_if_absent
from daydigest.sources.results import csv_tables, read_csv_table


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "request": F.col("event_name").cast("string"),
            "datetime": ids.moment_text("unix_timestamp"),
            "date": ids.day_text("unix_timestamp"),
        }
    )


def clean_summary(df: DataFrame) -> DataFrame:
    """Published form of summaries."""
    dated = _dated(df).withColumn("summary_xsum_detail", F.col("summary").cast("string"))
    return dated.select(
        "request", "date", "datetime", "question", "summary_xsum_detail", "avg_importance"
    )


def clean_original(df: DataFrame) -> DataFrame:
    """Published form of source documents."""
    return _dated(df).select(
        "query", "text", "request", "datetime", "date", "question", "importance", "source"
    )


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "summary": clean_summary,
    "original": clean_original,
}


def cleaned(df: DataFrame, table: str) -> DataFrame:
    """Clean by table name; other tables stay as they are."""
    return df.transform(CLEANERS.get(table, lambda same: same))


# What a published table is sorted by within a day, best first, and on ties.
ORDERS = {"summary": ("avg_importance", "question"), "original": ("importance", "query")}


def publish_folder(
    spark: SparkSession, folder: str, target: str, schemas: dict | None = None
) -> dict[str, str]:
    """Load every CSV table of a folder into ``target``, sorted once, unless it is there already;
    a table that is there is not read."""
    published = {}
    for table, path in csv_tables(spark, folder).items():
        published[table] = f"{target.rstrip('/')}/{table}"
        if exists(spark, published[table]):
            continue
        df = cleaned(read_csv_table(spark, path, (schemas or {}).get(table)), table)
        if table in ORDERS:
            df = by_date_and(df, *ORDERS[table])
        insert_if_absent(df, published[table])
    return published


def unique_requests(summary: DataFrame) -> DataFrame:
    return summary.select("request").distinct().orderBy("request")


def table_counts(summary: DataFrame, original: DataFrame) -> DataFrame:
    """Row counts of both published tables."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in (("summary", summary), ("original", original))
    ]
    return counts[0].unionByName(counts[1])


def rows_of_request(table: DataFrame, request: str = ALL) -> DataFrame:
    """Rows of one request, or of all, without a store id."""
    return of_request(table, request).drop("_id")
