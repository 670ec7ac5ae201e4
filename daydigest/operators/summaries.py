"""Answers and summaries of grouped texts.

A summarizer is a column expression, or a factory called once per Python worker whose
product turns a batch (columns prompt, texts, question) into a series of summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.functions import text as T
from daydigest.operators.digest import by_date_and

UNANSWERABLE = "unanswerable"
SENTENCE_END = r"[.!?]+\s+"

BatchSummarizer = Callable[[pd.DataFrame], pd.Series]


def first_words(text: Column, words: int | None) -> Column:
    """An output of at most ``words`` words; without a limit the text as it is."""
    if words is None:
        return text
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, words), " ")


def best_sentence(texts: Column, query: Column) -> Column:
    """(matches, position, sentence) of the sentence with most query terms, first on ties."""

    def rated(wanted: Column) -> Column:
        return F.transform(
            F.split(texts, SENTENCE_END),
            lambda sentence, position: F.struct(
                F.size(F.array_intersect(wanted, T.tokens(sentence))).alias("matches"),
                (-position).alias("position"),
                sentence.alias("sentence"),
            ),
        )

    return F.array_max(T.bound(F.array_distinct(T.tokens(query)), rated))


def extractive_answer(texts: Column, question: Column, max_words: int | None = None) -> Column:
    """The sentence that shares most terms with the question, else ``unanswerable``; the whole
    sentence, or its first ``max_words`` words."""
    best = best_sentence(texts, question)
    return F.when(
        best["matches"] > 0, first_words(best["sentence"], max_words)
    ).otherwise(F.lit(UNANSWERABLE))


def extractive_summary(texts: Column, query: Column, max_words: int | None = None) -> Column:
    """The best sentence of the cleaned text, whole or its first ``max_words`` words."""
    return first_words(best_sentence(T.clean_social(texts), query)["sentence"], max_words)


def with_prompt(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("prompt", T.prompt(F.col("texts"), F.col("question")))


def with_answers(grouped: DataFrame, max_words: int | None = None) -> DataFrame:
    answer = extractive_answer(F.col("texts"), F.col("question"), max_words)
    return grouped.withColumn("summary", answer)


def with_summaries(grouped: DataFrame, max_words: int | None = None) -> DataFrame:
    return grouped.withColumn("summary", extractive_summary(F.col("texts"), F.col("query"), max_words))


def with_batch_summaries(
    grouped: DataFrame,
    factory: Callable[[], BatchSummarizer],
    partitions: int | None = None,
    clean: bool = False,
) -> DataFrame:
    """Summaries by a model, which gets prompt, texts and question of a batch: rows are spread over
    ``partitions`` (two for each core, if not given).

    ``clean`` takes hashtags, links and mentions out of the text the model sees; the
    grouped row keeps its own text.
    """
    if partitions is None:
        partitions = 2 * grouped.sparkSession.sparkContext.defaultParallelism
    seen = T.clean_social("texts") if clean else F.col("texts")
    asked = grouped.repartition(partitions, "request_id", "q_id")

    @F.pandas_udf("string")
    def summarise(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for prompt, texts, question in batches:
            view = pd.DataFrame({"prompt": prompt, "texts": texts, "question": question})
            yield pd.Series(pd.Series(model(view)).to_numpy())

    prompt = T.prompt(F.col("texts"), F.col("question"))
    return asked.withColumn("summary", summarise(prompt, seen, F.col("question")))


def finalised(summarised: DataFrame) -> DataFrame:
    """Add request, datetime and date as text; days ascending, best first."""
    return by_date_and(
        summarised.withColumns(
            {
                "request": ids.event_before_request_mark("request_id"),
                "datetime": ids.moment_text("unix_timestamp"),
                "date": ids.day_text("unix_timestamp"),
            }
        ),
        "avg_importance",
        "request_id",
        "q_id",
    )


def compared(grouped: DataFrame, summarizers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The same groups under several summarizers, one row per group and summarizer."""
    out = None
    for name, summarise in summarizers.items():
        part = summarise(grouped).withColumn("summarizer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
