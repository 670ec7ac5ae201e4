"""Importance per request and the grouping of texts into one row per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_range(ranked: DataFrame) -> DataFrame:
    """Lowest and highest rerank score per request."""
    return ranked.groupBy("request_id").agg(
        F.min("rerank_score").alias("min"), F.max("rerank_score").alias("max")
    )


def with_importance(ranked: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(score - min) / (max - min) per request, null when all scores are equal. ``scores`` are the rows of ``ranked`` in
    a narrower table, where there is one.

    Minimum and maximum are pre-aggregated and joined back, so that a request with
    very many rows is not gathered in one window.
    """
    ranked = ranked.join(request_range(ranked if scores is None else scores), "request_id", "left")
    low, high = F.col("min"), F.col("max")
    return ranked.withColumn("importance", F.try_divide(F.col("rerank_score") - low, high - low))


def by_importance(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("importance"), F.asc("docno"))


def by_date_and(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Days ascending, best first inside a day."""
    return df.orderBy(F.asc("date"), F.desc_nulls_last(column), *ties)


GROUP = ["request_id", "q_id", "event_id", "event_title"]


def group_documents(ranked: DataFrame) -> DataFrame:
    """One row per request and query: joined texts, document list, mean importance.

    Texts and documents stand in order of importance; rows with a null key are dropped.
    A group holds the reranked few of one request and query, so it is small.
    """
    entry = F.struct(
        F.coalesce(-F.col("importance"), F.lit(float("inf"))).alias("order"), "docno", "text"
    )
    grouped = (
        ranked.na.drop(subset=GROUP)
        .groupBy(*GROUP)
        .agg(
            F.array_sort(F.collect_list(entry)).alias("entries"),
            F.avg("importance").alias("avg_importance"),
            F.min("unix_timestamp").alias("unix_timestamp"),
            F.min("question").alias("question"),
            F.min("query").alias("query"),
        )
    )
    return grouped.select(
        "request_id",
        "q_id",
        F.col("event_id").alias("Event"),
        "event_title",
        F.array_join("entries.text", " ").alias("texts"),
        F.col("entries.docno").alias("docno_list"),
        "avg_importance",
        "unix_timestamp",
        "question",
        "query",
    )
