"""Second-stage scores of the first-stage candidates and the cut to the best few.

A scorer sees (query, text) pairs. The default is a column expression; a model is given
as a factory, called once per Python worker, whose product scores Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators.ranking import SCORE_DIGITS

RERANK_DEPTH = 5

PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms found in the text plus the share of the text's
    distinct terms they make up."""

    def score(wanted: Column, present: Column) -> Column:
        return T.bound(
            F.size(F.array_intersect(wanted, present)).cast("double"),
            lambda shared: F.coalesce(F.try_divide(shared, F.size(wanted)), F.lit(0.0))
            + F.coalesce(F.try_divide(shared, F.size(present)), F.lit(0.0)),
        )

    total = T.bound(
        F.array_distinct(T.tokens(query)),
        lambda wanted: T.bound(
            F.array_distinct(T.tokens(text)), lambda present: score(wanted, present)
        ),
    )
    # never null: a null check would make Spark score each candidate twice
    return F.coalesce(F.round(total, SCORE_DIGITS), F.lit(0.0))


def with_overlap_score(candidates: DataFrame, text: str = "text") -> DataFrame:
    return candidates.withColumn("rerank_score", overlap_score(F.col("query"), F.col(text)))


def with_model_score(
    candidates: DataFrame, factory: Callable[[], PairScorer], text: str = "text"
) -> DataFrame:
    """Score candidates with a model loaded once per worker, which gets (query, text) alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = factory()
        for queries, texts in batches:
            yield pd.Series(pd.Series(scorer(queries, texts)).astype("float64").to_numpy())

    scores = F.round(F.nanvl(score("query", text), F.lit(None)), SCORE_DIGITS)
    return candidates.withColumn("rerank_score", scores)


def join_scores(candidates: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Candidates with scores made elsewhere; a candidate without a score keeps null."""
    return candidates.join(scores.select(*key, "rerank_score"), key, "left")


def rerank_ranks(scored: DataFrame, request: list[str]) -> DataFrame:
    """1-based rank of the candidates (the first-stage few of a request and query) by
    rerank score; unscored rows get null."""
    best = Window.partitionBy(*request, "q_id").orderBy(
        F.desc_nulls_last("rerank_score"), F.asc("docno")
    )
    return scored.withColumn(
        "rerank_rank", F.when(F.col("rerank_score").isNotNull(), F.row_number().over(best))
    )


def rerank_cut(scored: DataFrame, request: list[str], depth: int = RERANK_DEPTH) -> DataFrame:
    """The best ``depth`` scored candidates of each request and query."""
    best = Window.partitionBy(*request, "q_id").orderBy(F.desc("rerank_score"), F.asc("docno"))
    return (
        scored.filter(F.col("rerank_score").isNotNull())
        .withColumn("rerank_rank", F.row_number().over(best))
        .filter(F.col("rerank_rank") <= depth)
    )
