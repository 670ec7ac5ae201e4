"""The driver's tables in the shape of the domain: corpus, calendar, queries, runs.

documents become the corpus (event = lang), events give each document its time and its
importance, benchmark gives the queries, labels the judgements, embeddings the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.operators import embed
from daydigest.session import checked_small_side, cut_lineage, dealt_out

# The collections of the test corpus; every general query is asked of each of them.
LANGUAGES = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("unix_timestamp"),
        F.col("event_type"),
        F.col("value"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_out(table(spark, sf_dir, "documents"))


def timed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = documents(spark, sf_dir).join(times(spark, sf_dir), "doc_id")
    return timed.withColumns(
        {
            "docno": F.concat_ws("-", F.lit("Doc"), "lang", "source", "doc_id"),
            "event_id": F.col("lang"),
            "date": ids.day("unix_timestamp"),
        }
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_documents(spark, sf_dir).select(
        "event_id", "date", "docno", "text", "unix_timestamp"
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which an event has documents, numbered from 0; request ids count from 1."""
    days = timed_documents(spark, sf_dir).select("event_id", "date").distinct()
    order = Window.partitionBy("event_id").orderBy("date")
    numbered = days.withColumn("day_pos", F.row_number().over(order) - 1)
    named = numbered.withColumn(
        "request_id", F.concat("event_id", F.lit("-r"), (F.col("day_pos") + 1).cast("string"))
    )
    return cut_lineage(named, "calendar")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asked of every event; its whole text is the query."""
    return table(spark, sf_dir, "benchmark").select(
        F.format_string("q%03d", "item_id").alias("query_id"),
        "text",
        F.col("text").alias("indicative_terms"),
        F.concat(F.lit("Report-"), (F.col("item_id") % 5).cast("string")).alias(
            "trecis_category_mapping"
        ),
        F.explode(F.array(*[F.lit(x) for x in LANGUAGES])).alias("event_id"),
    ).withColumn("event_title", F.concat(F.lit("Event "), "event_id"))


def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = table(spark, sf_dir, "documents").select("lang").distinct()
    return languages.select(
        F.col("lang").alias("event_id"), F.concat(F.lit("Event "), "lang").alias("event_name")
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fact of the run its event type names, value as importance."""
    days = checked_small_side(calendar(spark, sf_dir).select("event_id", "date", "request_id"))
    return (
        timed_documents(spark, sf_dir)
        .join(days, ["event_id", "date"])
        .select(
            F.col("event_type").alias("run_id"),
            F.col("request_id").alias("requestID"),
            F.col("text").alias("factText"),
            F.col("unix_timestamp").alias("unixTimestamp"),
            F.col("value").alias("importance"),
            F.array("docno").alias("sources"),
            F.lit(None).cast("string").alias("streamID"),
            F.col("source").alias("informationNeeds"),
            F.col("doc_id").alias("position"),
        )
    )


def judged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that hold a document labelled good, with their place in the calendar."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    days = timed_documents(spark, sf_dir).join(good, "doc_id", "left_semi")
    days = days.select("event_id", "date").distinct()
    return (
        calendar(spark, sf_dir)
        .join(days, ["event_id", "date"], "left_semi")
        .select("request_id", F.col("day_pos").alias("request_pos"))
    )


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(docno, good) of the documents whose quality is labelled."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return timed_documents(spark, sf_dir).join(labels, "doc_id").select("docno", "good")


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference text per event: its good document of the highest value."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    documents = timed_documents(spark, sf_dir).join(good, "doc_id", "left_semi")
    return documents.groupBy("event_id").agg(
        F.max_by("text", F.struct("value", "doc_id")).alias("text")
    )


# Token vectors of a text, and every which text is a query.
TEXT_TOKENS, QUERY_EACH = 16, 20


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a token of a text of at most ``TEXT_TOKENS``, counted from 0 in it."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {TEXT_TOKENS}").alias("owner"),
        (F.col("vec_id") % TEXT_TOKENS).alias("pos"),
        F.col("embedding").alias("vector"),
    )


def some_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token vectors of the texts whose number ``QUERY_EACH`` divides."""
    return vectors(spark, sf_dir).filter(F.col("owner") % QUERY_EACH == 0)


def learned_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (owner, text) of the queries (owner: q_id) and of the documents (owner: docno), and the word vectors
    learned from all of them. Documents are joined with their times once, and written."""
    asked = table(spark, sf_dir, "benchmark").select(F.format_string("q%03d", "item_id").alias("owner"), "text")
    held = cut_lineage(timed_documents(spark, sf_dir).select(F.col("docno").alias("owner"), "text"), "texts")
    return asked, held, embed.word_vectors(asked.select("text").union(held.select("text")))
