"""Lexical ranking: eight weighting models over query terms joined with postings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators import collection as C
from daydigest.session import checked_small_side, cut_lineage, small_side

FIRST_STAGE_DEPTH = 50
RESULT_DEPTH = 1000
SCORE_DIGITS = 6
# Documents scored in one group, at least and for each document kept; scores and matches held at once.
PART_DOCS, DOCS_A_RANK = 4096, 16
CELLS = 4_000_000
LOG2_E = math.log2(math.e)

# The published default parameters.
BM25_K1, BM25_B, BM25_K3 = 1.2, 0.75, 8.0
NORMALISATION_C = 1.0
DIRICHLET_MU = 2500.0
HIEMSTRA_LAMBDA = 0.15


@dataclass(frozen=True)
class Statistics:
    """Columns a weighting model may use."""

    tf: Column
    dl: Column
    qtf: Column
    df: Column
    cf: Column
    n_docs: Column
    n_terms: Column

    @classmethod
    def of_row(cls) -> "Statistics":
        return cls(*[F.col(c).cast("double") for c in cls.__dataclass_fields__])

    @property
    def average(self) -> Column:
        return self.n_terms / self.n_docs

    @property
    def length_factor(self) -> Column:
        """k1 (1 - b + b dl / avgdl), the length part of BM25 and TF_IDF."""
        return F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * self.dl / self.average)

    @property
    def normalised_tf(self) -> Column:
        return self.tf * F.log2(1 + F.lit(NORMALISATION_C) * self.average / self.dl)


def bm25(s: Statistics) -> Column:
    idf = F.log2((s.n_docs - s.df + 0.5) / (s.df + 0.5))
    document = (BM25_K1 + 1) * s.tf / (s.length_factor + s.tf)
    return idf * document * ((BM25_K3 + 1) * s.qtf / (BM25_K3 + s.qtf))


def tf_idf(s: Statistics) -> Column:
    return s.qtf * (BM25_K1 * s.tf / (s.tf + s.length_factor)) * F.log2(s.n_docs / s.df + 1)


def pl2(s: Statistics) -> Column:
    t, rate = s.normalised_tf, s.cf / s.n_docs
    information = (
        t * F.log2(1 / rate)
        + rate * LOG2_E
        + 0.5 * F.log2(2 * math.pi * t)
        + t * (F.log2(t) - LOG2_E)
    )
    return s.qtf / (t + 1) * information


def inl2(s: Statistics) -> Column:
    t = s.normalised_tf
    return s.qtf * t / (t + 1) * F.log2((s.n_docs + 1) / (s.df + 0.5))


def dph(s: Statistics) -> Column:
    share = s.tf / s.dl
    norm = (1 - share) * (1 - share) / (s.tf + 1)
    information = s.tf * F.log2(s.tf * (s.average / s.dl) * (s.n_docs / s.cf)) + 0.5 * F.log2(
        2 * math.pi * s.tf * (1 - share)
    )
    return F.when(s.tf < s.dl, s.qtf * norm * information).otherwise(F.lit(0.0))


def dirichlet_lm(s: Statistics) -> Column:
    seen = F.log2(1 + s.tf / (DIRICHLET_MU * s.cf / s.n_terms))
    return s.qtf * (seen + F.log2(DIRICHLET_MU / (s.dl + DIRICHLET_MU)))


def hiemstra_lm(s: Statistics) -> Column:
    odds = HIEMSTRA_LAMBDA * s.tf * s.n_terms / ((1 - HIEMSTRA_LAMBDA) * s.cf * s.dl)
    return s.qtf * F.log2(1 + odds)


def dfree(s: Statistics) -> Column:
    prior, posterior = s.tf / s.dl, (s.tf + 1) / (s.dl + 1)
    spread, gain = s.n_terms / s.cf, F.log2(posterior / prior)
    information = (
        -s.tf * F.log2(prior * spread)
        + (s.tf + 1) * F.log2(posterior * spread)
        + 0.5 * gain
    )
    return s.qtf * s.tf * gain * information


MODELS = {
    "BM25": bm25,
    "TF_IDF": tf_idf,
    "PL2": pl2,
    "InL2": inl2,
    "DPH": dph,
    "DirichletLM": dirichlet_lm,
    "Hiemstra_LM": hiemstra_lm,
    "DFRee": dfree,
}


def query_weight(model: str) -> Column:
    """The factor of ``qtf``: every model is this times its score with a ``qtf`` of 1."""
    qtf = F.col("qtf").cast("double")
    return (BM25_K3 + 1) * qtf / (BM25_K3 + qtf) if model == "BM25" else qtf


def checked_model(model: str):
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, choose one of {sorted(MODELS)}")
    return MODELS[model]


def score_documents(postings_with_terms: DataFrame, model: str) -> DataFrame:
    """Sum of term scores per query and document, rounded so that ties are ties."""
    term_score = checked_model(model)(Statistics.of_row())
    return postings_with_terms.groupBy("q_id", *C.DOC).agg(
        F.round(F.sum(term_score), SCORE_DIGITS).alias("score")
    )


def first_stage(scored: DataFrame, depth: int = FIRST_STAGE_DEPTH) -> DataFrame:
    """The best ``depth`` documents per collection and query, with their 0-based rank.

    The filter is on the plain row number, so Spark cuts each task's rows to ``depth``
    per query before the shuffle.
    """
    best = Window.partitionBy(*C.PART, "q_id").orderBy(F.desc("score"), F.asc("docno"), F.asc("row_id"))
    return (
        scored.withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= depth)
        .withColumn("rank", F.col("_n") - 1)
        .drop("_n")
    )


def request_terms(days: DataFrame, terms: DataFrame) -> int:
    """Days times query terms, summed over the events: the most weighted terms there can be."""
    per_event = days.groupBy("event_id").agg(F.count("*").alias("n_days")).join(
        terms.groupBy("event_id").agg(F.count("*").alias("n_query_terms")), "event_id"
    )
    total = per_event.agg(F.sum(F.col("n_days") * F.col("n_query_terms")).alias("n")).first()
    return total["n"] or 0


def corpus_index(
    corpus: DataFrame, calendar: DataFrame, steps=C.STOP_THEN_STEM, stop_words=T.STOP_WORDS
) -> C.Index:
    """The index of the calendar's collections."""
    days = calendar.select(*C.PART).distinct()
    return C.build_index(corpus.join(checked_small_side(days, 64), C.PART, "left_semi"), steps, stop_words)


def postings_of_queries(index: C.Index, queries: DataFrame, calendar: DataFrame) -> DataFrame:
    """Query terms joined with the postings and statistics of their collections."""
    days = calendar.select(*C.PART).distinct()
    terms = C.query_terms(queries, index.steps, index.stop_words)
    postings = C.postings_of_terms(index, terms)
    sizes = cut_lineage(C.sizes_of(index), "sizes")
    weighted = C.weighted_query_terms(terms, postings, sizes, request_terms(days, terms))
    return C.join_postings(postings, weighted)


def rounded(sums: np.ndarray) -> np.ndarray:
    """``sums`` to ``SCORE_DIGITS`` as Spark rounds: halves of the printed decimals go up."""
    scaled = sums * 10.0**SCORE_DIGITS
    out = np.where(np.abs(scaled) < 2.0**52, np.rint(scaled) / 10.0**SCORE_DIGITS, sums)
    with np.errstate(invalid="ignore"):
        close = (np.abs(scaled) < 2.0**52) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4)
    unit = Decimal(1).scaleb(-SCORE_DIGITS)
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(sums[i]))).quantize(unit, ROUND_HALF_UP))
    return out + 0.0


def document_runs(matches: np.ndarray, queries: int) -> Iterator[slice]:
    """Runs of documents of at most ``CELLS`` scores and matches, or of one document; ``matches`` are theirs."""
    most, begin = max(1, CELLS // queries), 0
    total = np.concatenate([[0], np.cumsum(matches)])
    while begin < len(matches):
        end = int(np.searchsorted(total, total[begin] + CELLS, "right")) - 1
        end = min(max(end, begin + 1), begin + most, len(matches))
        yield slice(begin, end)
        begin = end


def best_rows(query: np.ndarray, doc: np.ndarray, score: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ``depth`` best rows of each query: NaN first, then by falling score, rows without a score (None,
    given as masked) last; ties by document."""
    value = np.ma.getdata(score)
    kind = np.where(np.ma.getmaskarray(score), 2, np.where(np.isnan(value), 0, 1))
    order = np.lexsort((doc, np.where(kind == 1, -value, 0.0), kind, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
    return order[place < depth]


def best_of_part(depth: int):
    """The ``depth`` best documents of each query among some documents of a collection, from their postings (DOC, term,
    value) and the queries (q_id, term, weight): a score is the sum of value times weight over the terms of both."""

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        held, asked = held.combine_chunks(), asked.combine_chunks()
        terms = pc.unique(asked["term"])
        held = held.filter(pc.is_in(held["term"], value_set=terms))
        by = [("docno", "ascending"), ("row_id", "ascending"), ("row_hash", "ascending"), ("term", "ascending")]
        held = held.take(pc.sort_indices(held, sort_keys=by, null_placement="at_start")).combine_chunks()
        ids = [pc.fill_null(pc.index_in(held[c], value_set=pc.unique(held[c])), -1).to_numpy() for c in ("docno", "row_id", "row_hash")]
        new = np.ones(held.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
        # documents are numbered in the order of ties
        document, first = np.cumsum(new) - 1, np.flatnonzero(new)
        value = held["value"]
        known = pc.is_valid(value).to_numpy()
        value = pc.fill_null(value, 0.0).to_numpy()
        # the queries of each term stand together
        names = pc.unique(asked["q_id"])
        wanted = pc.index_in(asked["term"], value_set=terms).to_numpy()
        order = np.argsort(wanted, kind="stable")
        query = pc.index_in(asked["q_id"], value_set=names).to_numpy()[order].astype(np.int64)
        weight = asked["weight"].to_numpy()[order]
        at = np.searchsorted(wanted[order], np.arange(len(terms) + 1))
        term = pc.index_in(held["term"], value_set=terms).to_numpy()
        many = (at[1:] - at[:-1])[term]
        found = []
        for run in document_runs(np.add.reduceat(many, first) if len(first) else many, max(1, len(names))):
            begin, end = first[run.start], first[run.stop] if run.stop < len(first) else held.num_rows
            n, docs = many[begin:end], run.stop - run.start
            posting = np.repeat(np.arange(begin, end), n)
            entry = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[term[begin:end]], n)
            cell = query[entry] * docs + document[posting] - run.start
            cells = docs * len(names)
            sums = np.bincount(cell, value[posting] * weight[entry], cells)
            hit = np.flatnonzero(np.bincount(cell, minlength=cells))
            scored = np.ones(cells, bool)
            if not known[begin:end].all():
                scored = np.bincount(cell, known[posting], cells) > 0
            score = np.ma.masked_array(rounded(sums[hit]), ~scored[hit])
            q, d = hit // docs, hit % docs + run.start
            keep = best_rows(q, d, score, depth)
            found.append((q[keep], d[keep], score[keep]))
        q, d, score = (np.ma.concatenate(x) if x else np.ma.empty(0) for x in (list(zip(*found)) or [[], [], []]))
        q, d = np.asarray(q, np.int64), np.asarray(d, np.int64)
        keep = best_rows(q, d, score, depth)
        rows = held.select(C.DOC).take(pa.array(first[d[keep]], pa.int64()))
        score = pa.array(np.ma.getdata(score)[keep].astype(np.float64), mask=np.ma.getmaskarray(score)[keep])
        return rows.add_column(0, "q_id", names.take(pa.array(q[keep]))).append_column("score", score)

    return best


def best_documents(
    index: C.Index, queries: DataFrame, calendar: DataFrame, model: str = "BM25", depth: int = FIRST_STAGE_DEPTH
) -> DataFrame:
    """(q_id, DOC, score) of all documents that may be among the ``depth`` best of their request and query, and all that are.

    Every document that holds a query term is scored. Documents of a collection are dealt into groups of bounded
    size, and the queries of its event go to each of them, so that no pair of a query and a document is a row before
    the best of its group are known.
    """
    term_score = checked_model(model)(replace(Statistics.of_row(), qtf=F.lit(1.0)))
    days = calendar.select(*C.PART).distinct()
    terms = C.query_terms(queries, index.steps, index.stop_words)
    postings = C.postings_of_terms(index, terms)
    sizes = C.sizes_of(index).withColumn("parts", F.ceil(F.col("n_docs") / max(PART_DOCS, DOCS_A_RANK * depth)).cast("int"))
    sizes = cut_lineage(sizes, "sizes")
    bound = request_terms(days, terms)
    stats = cut_lineage(C.term_frequencies(postings).join(small_side(sizes, bound), C.PART), "term-statistics")
    held = postings.join(checked_small_side(stats), [*C.PART, "term"]).select(
        *C.DOC, F.pmod(F.xxhash64("docno", "row_id"), "parts").cast("int").alias("part"), "term", term_score.alias("value")
    )
    weights = terms.select("event_id", "q_id", "term", query_weight(model).alias("weight"))
    places = sizes.select(*C.PART, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = places.join(checked_small_side(weights), "event_id")
    group = [*C.PART, "part"]
    types = {f.name: f.dataType.simpleString() for f in [*held.schema, *asked.schema]}
    schema = ", ".join(f"{c} {types[c]}" for c in ["q_id", *C.DOC]) + ", score double"
    return held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(best_of_part(depth), schema)


def rank_index(
    index: C.Index, queries: DataFrame, calendar: DataFrame, model: str = "BM25", depth: int = FIRST_STAGE_DEPTH
) -> DataFrame:
    """(q_id, event_id, date, docno, row_id, row_hash, score, rank) of the best documents per request
    and query. Only documents with at least one query term are scored."""
    return first_stage(best_documents(index, queries, calendar, model, depth), depth)


def rank(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str = "BM25",
    steps=C.STOP_THEN_STEM,
    stop_words=T.STOP_WORDS,
    depth: int = FIRST_STAGE_DEPTH,
) -> DataFrame:
    """``rank_index`` over a new index of the calendar's collections."""
    return rank_index(corpus_index(corpus, calendar, steps, stop_words), queries, calendar, model, depth)
