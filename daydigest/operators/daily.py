"""An index that grows day by day.

The index lies in a folder of batches. A batch holds the entries of the days that were new when it was added (partitioned
by event and date), the sizes of their collections, and the stems of words that no earlier batch has. Collections are
days, so the statistics of all days are those of the batches side by side: a new day is tokenised, and nothing is
counted again. A batch appears in one step or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators import collection as C
from daydigest.session import checked_small_side, cut_lineage
from daydigest.sinks.writers import exists, renamed_if_absent

SIZES = "event_id string, date date, n_docs long, n_terms long"
FORMS = "surface string, term string"
ENTRIES = "event_id string, date date, docno string, row_id long, row_hash long, dl long, place int, surface string, tf long"


def batches(spark: SparkSession, path: str) -> int:
    """How many batches are there; they are numbered from 0."""
    n = 0
    while exists(spark, f"{path}/batch-{n}"):
        n += 1
    return n


def stored(spark: SparkSession, path: str, table: str, schema: str, n: int) -> DataFrame:
    """One table of the first ``n`` batches."""
    found = spark.createDataFrame([], schema)
    for k in range(n):
        batch = spark.read.schema(schema).parquet(f"{path}/batch-{k}/{table}")
        found = batch.select(*found.columns) if not k else found.unionByName(batch)
    return found


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, date, n_docs, n_terms, avg_length) of every day of the index."""
    known = stored(spark, path, "sizes", SIZES, batches(spark, path))
    return known.withColumn("avg_length", F.col("n_terms") / F.col("n_docs"))


def add_days(corpus: DataFrame, path: str, steps=C.STOP_THEN_STEM, stop_words=T.STOP_WORDS) -> int:
    """Add the days of ``corpus`` (event_id, date, docno, text, ...; date as a date) that the index has not;
    the number of them is returned. Days it has are left as they are, their texts unread. Of two writers that add at once
    the second looks again at what is new."""
    spark = corpus.sparkSession
    while True:
        n = batches(spark, path)
        known = stored(spark, path, "sizes", SIZES, n).select(*C.PART)
        days = cut_lineage(corpus.select(*C.PART).distinct().join(known, C.PART, "left_anti"), "new-days")
        added = days.count()
        if not added:
            return 0
        new = corpus.join(checked_small_side(days, 64), C.PART, "left_semi")
        index = C.build_index(new, steps, stop_words)
        staged = f"{path}/_batch-{uuid.uuid4().hex}"
        C.sizes_of(index).select(*C.PART, "n_docs", "n_terms").write.parquet(f"{staged}/sizes")
        forms = index.forms.select("surface", "term")
        forms.join(stored(spark, path, "forms", FORMS, n), "surface", "left_anti").write.parquet(f"{staged}/forms")
        index.entries.write.partitionBy(*C.PART).parquet(f"{staged}/entries")
        if renamed_if_absent(spark, staged, f"{path}/batch-{n}"):
            return added


def open_index(spark: SparkSession, path: str, steps=C.STOP_THEN_STEM, stop_words=T.STOP_WORDS) -> C.Index:
    """The index of all days, for the models and statistics of ``collection`` and ``ranking``. Give the steps that the days
    were added with; a filter on event or date reads the days it names alone."""
    n = batches(spark, path)
    entries = stored(spark, path, "entries", ENTRIES, n).select(*C.DOC, "dl", "place", "surface", "tf")
    return C.Index(entries, stored(spark, path, "forms", FORMS, n), tuple(steps), tuple(stop_words))
