"""Filters, projections and small-table joins around the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.session import checked_small_side

ALL = "All"


def with_text(df: DataFrame) -> DataFrame:
    return df.filter(F.col("text").isNotNull())


def of_request(df: DataFrame, request: str = ALL) -> DataFrame:
    return df if request == ALL else df.filter(F.col("request") == request)


def of_prefix(df: DataFrame, prefix: str, column: str = "request_id") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def of_event(df: DataFrame, event: str, column: str = "request_id") -> DataFrame:
    return df.filter(ids.event_before_last_hyphen(column) == event)


def reference_text(url: Column | str, text: Column | str) -> Column:
    """Only encyclopedia pages have a reference text; other events get an empty one."""
    url = F.col(url) if isinstance(url, str) else url
    return F.when(url.contains("wikipedia.org"), text).otherwise(F.lit(""))


def requests_with_queries(calendar: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query of an event with every day of it."""
    return calendar.join(checked_small_side(queries, 1024), "event_id")


def with_context(hits: DataFrame, calendar: DataFrame, queries: DataFrame) -> DataFrame:
    """Attach request, question, title and category to hits, and the platform of the id."""
    days = calendar.select("event_id", F.col("date").alias("request_date"), "request_id")
    needs = queries.select(
        "event_id",
        F.col("query_id").alias("q_id"),
        F.col("text").alias("question"),
        F.col("indicative_terms").alias("query"),
        "event_title",
        "trecis_category_mapping",
    )
    return (
        hits.join(checked_small_side(days), ["event_id", "request_date"])
        .join(checked_small_side(needs, 1024), ["event_id", "q_id"])
        .withColumn("source", ids.source_of("docno"))
    )


def with_event_name(df: DataFrame, events: DataFrame, key: str = "event_id", how: str = "left") -> DataFrame:
    """Event name by id; ``how='inner'`` drops rows of unknown events."""
    names = events.select(F.col("event_id").alias(key), "event_name")
    return df.join(checked_small_side(names), key, how)


def with_timestamp(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Time of each hit by document id; a repeated id in the corpus repeats the hit."""
    times = corpus.select("event_id", F.col("date").alias("request_date"), "docno", "unix_timestamp")
    return hits.join(times, ["event_id", "request_date", "docno"], "left")


def with_moments(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"datetime": ids.moment("unix_timestamp"), "date": ids.day("unix_timestamp")}
    )


def union_queries(parts: dict[str, DataFrame]) -> DataFrame:
    """Append the query tables of several events, tagged with the event id."""
    out = None
    for event, df in parts.items():
        df = df.withColumn("ID", F.lit(event))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
