"""Evaluation of runs: event summaries, bigram overlap and greedy vector matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.functions import text as T
from daydigest.operators.collection import stemmed
from daydigest.session import BROADCAST_BYTES, checked_small_side, cut_lineage, rows_up_to

TOP_FACTS = 32
STEMMED_LENGTH = 3
# Size of a dictionary row, and rows that a word of a large dictionary has.
WORD_BYTES = 64
SALTS = 64


def judged(facts: DataFrame, requests: DataFrame, request: str = "requestID") -> DataFrame:
    """Facts of requests that were judged."""
    wanted = requests.select(F.col("request_id").alias(request)).distinct()
    return facts.join(checked_small_side(wanted), request, "left_semi")


def top_facts(facts: DataFrame, depth: int = TOP_FACTS, tie: str = "position") -> DataFrame:
    """The most important facts of each run and request; ties keep input order."""
    best = Window.partitionBy("run_id", "requestID").orderBy(
        F.desc_nulls_last("importance"), F.asc(tie)
    )
    return facts.withColumn("fact_rank", F.row_number().over(best)).filter(
        F.col("fact_rank") <= depth
    )


def event_summaries(facts: DataFrame, requests: DataFrame, depth: int = TOP_FACTS) -> DataFrame:
    """(run_id, event_id, n_facts, summary_text, n_chars): the top facts of an event's judged
    requests, in request order.

    ``requests`` has request_id and request_pos. A group holds ``depth`` facts per
    request of one event, whatever the size of the run.
    """
    best = top_facts(judged(facts, requests), depth)
    order = requests.select(F.col("request_id").alias("requestID"), "request_pos")
    entry = F.struct("request_pos", "fact_rank", "factText")
    grouped = (
        best.join(checked_small_side(order), "requestID")
        .groupBy("run_id", ids.event_before_last_hyphen("requestID").alias("event_id"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    return grouped.select(
        "run_id",
        "event_id",
        F.size("entries").cast("long").alias("n_facts"),
        T.joined_with_dots(F.col("entries.factText")).alias("summary_text"),
    ).withColumn("n_chars", F.length("summary_text").cast("long"))


def bigram_counts(texts: DataFrame, key: list[str], use_stems: bool = True) -> DataFrame:
    """(key, first, second, n): counted word pairs of each text, stems of longer words."""
    words = texts.select(*key, T.tokens("text").alias("words"))
    following = F.expr("slice(words, 2, size(words))")
    pairs = words.select(
        *key, T.each(F.arrays_zip(F.col("words").alias("first"), following.alias("second"))).alias("pair")
    ).filter("pair.second is not null")
    counted = pairs.groupBy(*key, "pair.first", "pair.second").agg(F.count("*").alias("n"))
    if not use_stems:
        return counted
    counted = cut_lineage(counted, "bigrams")
    words = counted.select(F.explode(F.array("first", "second")).alias("surface")).distinct()
    stems = cut_lineage(stemmed(words, STEMMED_LENGTH), "stems")
    # a dictionary that is small is sent to the pairs; of a large one each word has SALTS rows, and a pair meets the one
    # that its other word picks: no word, however frequent, gathers its pairs on one key
    limit = BROADCAST_BYTES // WORD_BYTES
    small = rows_up_to(stems, limit) <= limit
    salted = stems if small else stems.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for word, other in (("first", "second"), ("second", "first")):
        renamed = salted.withColumnsRenamed({"surface": word, "term": "_stem"})
        if small:
            counted = counted.join(F.broadcast(renamed), word)
        else:
            picked = F.pmod(F.xxhash64(other, *key), F.lit(SALTS)).cast("int")
            counted = counted.withColumn("_salt", picked).join(renamed, [word, "_salt"]).drop("_salt")
        counted = counted.drop(word).withColumnRenamed("_stem", word)
    return counted.groupBy(*key, "first", "second").agg(F.sum("n").alias("n"))


def rouge2(candidates: DataFrame, references: DataFrame, use_stems: bool = True) -> DataFrame:
    """(run_id, event_id, precision, recall, f1) of shared bigrams, counts clipped.

    Candidates are (run_id, event_id, text), references (event_id, text).
    """
    ours = cut_lineage(bigram_counts(candidates, ["run_id", "event_id"], use_stems), "bigrams")
    theirs = cut_lineage(bigram_counts(references, ["event_id"], use_stems), "bigrams")
    shared = ours.join(
        theirs.withColumnRenamed("n", "n_reference"), ["event_id", "first", "second"]
    )
    rows = (
        ours.select("run_id", "event_id", F.col("n").alias("ours"), F.lit(0).alias("hits"))
        .unionByName(
            shared.select(
                "run_id",
                "event_id",
                F.lit(0).alias("ours"),
                F.least("n", "n_reference").alias("hits"),
            )
        )
        .unionByName(
            candidates.select(
                "run_id", "event_id", F.lit(0).alias("ours"), F.lit(0).alias("hits")
            )
        )
    )
    per_run = rows.groupBy("run_id", "event_id").agg(
        F.sum("ours").alias("ours"), F.sum("hits").alias("hits")
    )
    reference_sizes = theirs.groupBy("event_id").agg(F.sum("n").alias("theirs"))
    precision = F.coalesce(F.try_divide("hits", "ours"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "theirs"), F.lit(0.0))
    scored = per_run.join(reference_sizes, "event_id", "left").select(
        "run_id", "event_id", precision.alias("precision"), recall.alias("recall")
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def long_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) rows of precision, recall and f1."""
    return scores.unpivot(keys, ["precision", "recall", "f1"], "metric", "value")
