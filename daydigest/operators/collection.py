"""Documents, terms and statistics of collections, one per (event, day).

A document is one row (event_id, date, docno, text, ...); rows of equal docno are documents of their
own. ``build_index`` reads the texts once: terms are counted batch by batch, so the narrow table it
writes (one row for each document and distinct term) needs no shuffle, and vocabulary, document
lengths, statistics and the postings of any query come from that table. Stems are made once for
each distinct form. Every model and both orders of the term steps use the same index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.functions.porter import porter_stem
from daydigest.session import checked_small_side, cut_lineage, small_side

PART = ["event_id", "date"]
KEY = [*PART, "docno"]
# A document of the index: its key, a number that its row got, and a hash of the row.
DOC = [*KEY, "row_id", "row_hash"]

# Order of the term steps in the two ranking paths.
STOP_THEN_STEM = ("stop", "stem")
STEM_THEN_STOP = ("stem", "stop")


def raw_terms(steps: tuple[str, ...], stop_words=T.STOP_WORDS, text: str = "text") -> Column:
    """Terms of a text before stemming; stop words go here only if they go first."""
    if steps[:1] == ("stop",):
        return T.terms_without_stop_words(text, stop_words)
    return T.tokens(text)


ENTRY = "dl long, place int, surface string, tf long"


def counted_terms(rows: DataFrame) -> DataFrame:
    """``rows`` (columns and ``terms``) as one row for each distinct term of each row, with the length of the
    list, a number within the row, the term and its count; one row with nulls for an empty list.

    A batch is counted at once, by numbers in place of words: nothing is shuffled, and no expression
    is interpreted for each word.
    """
    keys = [f for f in rows.schema if f.name != "terms"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["terms"]
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            known = max(1, len(words.dictionary))
            code = words.indices.to_numpy().astype(np.int64)
            found, tf = np.unique(np.repeat(np.arange(len(length)), length) * known + code, return_counts=True)
            # a list without words keeps its row
            bare = np.flatnonzero(length == 0)
            row = np.concatenate([found // known, bare])
            first = np.searchsorted(row[: len(found)], row[: len(found)], "left")
            empty = np.arange(len(row)) >= len(found)
            place = np.concatenate([np.arange(len(found)) - first, bare])
            term = pa.array(np.concatenate([found % known, bare]), mask=empty)
            columns = [batch[f.name].take(pa.array(row)) for f in keys]
            columns += [
                pa.array(length[row]),
                pa.array(place.astype(np.int32), mask=empty),
                words.dictionary.take(term),
                pa.array(np.concatenate([tf, bare]), mask=empty),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in keys), "dl", "place", "surface", "tf"])

    listed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(work, f"{listed}, {ENTRY}")


def row_hash(corpus: DataFrame) -> Column:
    """A hash of all columns of a corpus row, by which hits find their text again."""
    return F.xxhash64(*[F.col(c) for c in sorted(corpus.columns)])


@dataclass(frozen=True)
class Index:
    """The written index of a corpus: ``entries`` (DOC, dl, place, surface, tf), with one row without a
    surface for a document without terms, and ``forms`` (surface, term). ``steps`` are the term steps
    in their order; where stop words go last, ``dl`` still counts them."""

    entries: DataFrame
    forms: DataFrame
    steps: tuple[str, ...]
    stop_words: tuple[str, ...]

    @property
    def stops_last(self) -> bool:
        return self.steps == STEM_THEN_STOP


def build_index(corpus: DataFrame, steps=STOP_THEN_STEM, stop_words=T.STOP_WORDS) -> Index:
    """Read the texts once and write what all ranking and statistics need."""
    terms = F.coalesce(raw_terms(steps, stop_words), F.array().cast("array<string>"))
    numbered = corpus.select(
        *KEY, F.monotonically_increasing_id().alias("row_id"), row_hash(corpus).alias("row_hash"), terms.alias("terms")
    )
    entries = cut_lineage(counted_terms(numbered), "index")
    if "stem" in steps:
        forms = cut_lineage(stemmed(vocabulary(entries)), "forms")
    else:
        forms = vocabulary(entries).withColumn("term", F.col("surface"))
    return Index(entries, forms, tuple(steps), tuple(stop_words))


def vocabulary(entries: DataFrame) -> DataFrame:
    """Distinct surface terms."""
    return entries.select("surface").distinct().filter("surface is not null")


def stemmed(words: DataFrame, short: int = 2) -> DataFrame:
    """(surface, term) of distinct words; words of up to ``short`` letters stay.

    The list is small in bytes but costly per row, so it is spread over all tasks
    instead of being coalesced by size.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = words.repartition(tasks, F.xxhash64("surface"))
    stem = F.when(F.length("surface") > short, porter_stem("surface")).otherwise(F.col("surface"))
    # never null: a null check would make Spark stem each form twice
    return spread.withColumn("term", F.coalesce(stem, F.lit("")))


def query_terms(queries: DataFrame, steps, stop_words=T.STOP_WORDS) -> DataFrame:
    """(event_id, q_id, term, qtf) of the indicative terms, treated like documents."""
    terms = queries.select(
        "event_id",
        F.col("query_id").alias("q_id"),
        T.each(raw_terms(steps, stop_words, "indicative_terms")).alias("term"),
    ).filter("term is not null")
    if "stem" in steps:
        terms = terms.withColumn("term", porter_stem("term"))
    if steps == STEM_THEN_STOP:
        terms = terms.filter(~T.is_stop_word("term", stop_words))
    counted = terms.groupBy("event_id", "q_id", "term").agg(F.count("*").alias("qtf"))
    return cut_lineage(counted, "query-terms")


def dropped_forms(index: Index) -> DataFrame:
    """Surface forms whose stem is a stop word; only where stop words go last."""
    return index.forms.filter(T.is_stop_word("term", index.stop_words)).select("surface")


def dropped_terms(index: Index) -> DataFrame:
    """(DOC, n_dropped) of documents that hold terms dropped after stemming."""
    stops = checked_small_side(dropped_forms(index), 64)
    return index.entries.join(stops, "surface", "left_semi").groupBy(*DOC).agg(F.sum("tf").alias("n_dropped"))


def with_final_length(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (with DOC and dl) with dl less the terms dropped after stemming."""
    if not index.stops_last:
        return rows
    less = dropped_terms(index)
    return rows.join(less, DOC, "left").withColumn("dl", F.col("dl") - F.coalesce("n_dropped", F.lit(0))).drop("n_dropped")


def all_postings(index: Index) -> DataFrame:
    """(DOC, dl, term, tf) of every term that the steps keep."""
    entries = index.entries.filter("surface is not null").select(*DOC, "dl", "surface", "tf")
    if "stem" in index.steps:
        entries = entries.join(index.forms, "surface").groupBy(*DOC, "dl", "term").agg(F.sum("tf").alias("tf"))
    else:
        entries = entries.withColumnRenamed("surface", "term")
    if index.stops_last:
        entries = entries.filter(~T.is_stop_word("term", index.stop_words))
    return with_final_length(entries, index).select(*DOC, "dl", "term", "tf")


def postings_of_terms(index: Index, wanted: DataFrame) -> DataFrame:
    """(DOC, dl, term, tf) of the ``wanted`` terms, written once: the forms that lead to them meet the
    index, and the aggregate combines on the map side."""
    targets = checked_small_side(wanted.select("term").distinct())
    forms = index.forms.join(targets, "term", "left_semi")
    found = index.entries.select(*DOC, "dl", "surface", "tf").join(
        checked_small_side(cut_lineage(forms, "wanted-forms"), 64), "surface"
    )
    merged = found.groupBy(*DOC, "dl", "term").agg(F.sum("tf").alias("tf"))
    return cut_lineage(with_final_length(merged, index).select(*DOC, "dl", "term", "tf"), "postings")


def sizes_of(index: Index) -> DataFrame:
    """(part, n_docs, n_terms): each document counts once, by its first entry."""
    first = F.coalesce("place", F.lit(0)) == 0
    sizes = index.entries.groupBy(*PART).agg(
        F.count_if(first).alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("n_terms")
    )
    if not index.stops_last:
        return sizes
    less = dropped_terms(index).groupBy(*PART).agg(F.sum("n_dropped").cast("long").alias("_less"))
    kept = F.col("n_terms") - F.coalesce("_less", F.lit(0))
    return sizes.join(less, PART, "left").select(*PART, "n_docs", kept.alias("n_terms"))


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(part, term, df, cf): documents and occurrences of a term in its collection."""
    return postings.groupBy(*PART, "term").agg(
        F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf")
    )


def collection_statistics(corpus: DataFrame, steps=("stop",), stop_words=T.STOP_WORDS):
    """All statistics of whole collections: (sizes, term frequencies, document lengths)."""
    return index_statistics(build_index(corpus, steps, stop_words))


def collection_sizes(corpus: DataFrame, steps=("stop",), stop_words=T.STOP_WORDS) -> DataFrame:
    """(part, n_docs, n_terms, avg_length) of whole collections. Where no step behind the stemmer drops terms,
    that takes the lengths of the lists alone: one pass that sums up before it shuffles, and no index."""
    if tuple(steps) == STEM_THEN_STOP:
        sizes = sizes_of(build_index(corpus, steps, stop_words))
    else:
        length = F.coalesce(F.size(raw_terms(steps, stop_words)), F.lit(0)).cast("long")
        sizes = corpus.groupBy(*PART).agg(F.count("*").alias("n_docs"), F.sum(length).alias("n_terms"))
    return sizes.withColumn("avg_length", F.col("n_terms") / F.col("n_docs"))


def index_statistics(index: Index):
    """(sizes, term frequencies, document lengths) of an index."""
    sizes = sizes_of(index).withColumn("avg_length", F.col("n_terms") / F.col("n_docs"))
    documents = index.entries.filter(F.coalesce("place", F.lit(0)) == 0).select(*DOC, "dl")
    return sizes, term_frequencies(all_postings(index)), with_final_length(documents, index).select(*KEY, "dl")


def weighted_query_terms(
    terms: DataFrame, postings: DataFrame, sizes: DataFrame, bound: int
) -> DataFrame:
    """Query terms with the statistics of each collection that holds them.

    ``bound`` is collections times query terms, the most rows this can have.
    """
    stats = term_frequencies(postings).join(small_side(sizes, bound), PART)
    weighted = stats.join(checked_small_side(terms), ["event_id", "term"])
    return small_side(weighted, bound, 256)


def join_postings(postings: DataFrame, weighted: DataFrame) -> DataFrame:
    """Query terms met with the documents of the collection that hold them."""
    return postings.join(weighted, [*PART, "term"])
