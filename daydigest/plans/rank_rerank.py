"""The two ranking paths and the run from corpus to digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators import collection as C
from daydigest.operators import context, digest, embed, learned, ranking, rerank, summaries, vectors
from daydigest.session import checked_small_side, cut_lineage, small_side
from daydigest.sinks.writers import write_named_csv

REQUEST = ["event_id", "request_date"]
RANKED = [
    "event_id",
    "request_date",
    "request_id",
    "q_id",
    "docno",
    "text",
    "rank",
    "score",
    "rerank_rank",
    "rerank_score",
    "query",
    "question",
    "event_title",
    "trecis_category_mapping",
    "source",
    "unix_timestamp",
    "datetime",
    "date",
    "min",
    "max",
    "importance",
]


# Where the text of a hit is: its key and the hash of its row.
ADDRESS = ["event_id", "request_date", "docno", "row_hash"]


def texts_of_hits(corpus: DataFrame, hits: DataFrame, bound: int, stored_chars: int | None = None) -> DataFrame:
    """(ADDRESS, text, unix_timestamp) of the ``bound`` hits, written once; rows equal in all columns are one text, so that
    hits do not multiply. Rows of other hashes go in the scan as long as the hashes of the hits are few."""
    text = F.col("text") if stored_chars is None else T.cropped("text", stored_chars)
    named = F.col("date").alias("request_date")
    texts = corpus.select("event_id", named, "docno", text.alias("text"), "unix_timestamp", C.row_hash(corpus).alias("row_hash"))
    texts = context.with_text(texts).join(small_side(hits.select("row_hash").distinct(), bound, 32), "row_hash", "left_semi")
    texts = texts.join(small_side(hits.select(*ADDRESS).distinct(), bound), ADDRESS, "left_semi")
    return cut_lineage(texts.dropDuplicates(ADDRESS), "hit-texts")


def located(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str,
    steps: tuple[str, ...],
    stop_words=T.STOP_WORDS,
    depth: int = ranking.FIRST_STAGE_DEPTH,
    stored_chars: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """First-stage hits (with ADDRESS) with text, time and context, and the written texts that they come from."""
    hits = ranking.rank(corpus, queries, calendar, model, steps, stop_words, depth)
    hits = cut_lineage(hits.withColumnRenamed("date", "request_date"), "hits")
    bound = hits.count()
    texts = texts_of_hits(corpus, hits, bound, stored_chars)
    found = texts.join(small_side(hits, bound), ADDRESS).drop("row_id")
    return context.with_context(found, calendar, queries), texts


def candidates(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str,
    steps: tuple[str, ...],
    stop_words=T.STOP_WORDS,
    depth: int = ranking.FIRST_STAGE_DEPTH,
) -> DataFrame:
    """First-stage hits with text, time and context."""
    return located(corpus, queries, calendar, model, steps, stop_words, depth)[0].drop("row_hash")


def finished(scored: DataFrame, texts: DataFrame, rerank_depth: int) -> DataFrame:
    """The best ``rerank_depth`` candidates of each request and query with their texts, times and importance, in the
    column order of the ranked table. The cut is made without the texts, and written once."""
    best = cut_lineage(rerank.rerank_cut(scored.drop("text"), REQUEST, rerank_depth), "best")
    ranked = texts.select(*ADDRESS, "text").join(checked_small_side(best, 1024), ADDRESS)
    return digest.with_importance(context.with_moments(ranked), best).select(*RANKED)


def rank_rerank_colbert(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str = "BM25",
    vectors_of: tuple[DataFrame, DataFrame] | None = None,
    words_of: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    scorer: Callable | None = None,
    stop_words=T.STOP_WORDS,
    depth: int = ranking.FIRST_STAGE_DEPTH,
    rerank_depth: int = rerank.RERANK_DEPTH,
    stored_chars: int | None = None,
) -> DataFrame:
    """Lexical ranking of the best ``depth`` documents, then late interaction, which keeps
    ``rerank_depth`` of them.

    ``stored_chars`` crops the text of a hit, as an index does that stores only so much of it;
    without it the whole text goes on. ``vectors_of`` gives token vectors of queries (owner = q_id) and of documents
    (owner = docno), ``words_of`` the texts (owner, text) of either and the vectors (word, vector) of their words, of which
    those of hits alone are used; ``scorer`` is a factory of a pair scorer; without any, term
    overlap is used.
    """
    hits, texts = located(corpus, queries, calendar, model, C.STOP_THEN_STEM, stop_words, depth, stored_chars)
    if vectors_of is not None or words_of is not None:
        pairs = cut_lineage(hits.select(F.col("q_id").alias("left"), F.col("docno").alias("right")).distinct(), "pairs")
        if vectors_of is not None:
            scores = vectors.max_sim(pairs, *vectors_of)
        else:
            asked, held, words = words_of
            # other texts are not taken apart
            held = held.join(checked_small_side(pairs.select(F.col("right").alias("owner")).distinct(), 64), "owner", "left_semi")
            scores = vectors.max_sim_words(embed.token_words(asked), embed.text_words(held), words, pairs)
        # rounded, so that ties are ties
        scores = scores.withColumn("rerank_score", F.round("rerank_score", ranking.SCORE_DIGITS))
        scores = scores.withColumnsRenamed({"left": "q_id", "right": "docno"})
        scored = rerank.join_scores(hits, scores, ["q_id", "docno"])
    elif scorer is not None:
        scored = rerank.with_model_score(hits, scorer)
    else:
        scored = rerank.with_overlap_score(hits)
    return finished(scored, texts, rerank_depth)


def rank_rerank_t5(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str = "BM25",
    scorer: Callable | None = None,
    stop_words=T.STOP_WORDS,
    depth: int = ranking.FIRST_STAGE_DEPTH,
    rerank_depth: int = rerank.RERANK_DEPTH,
    judged: DataFrame | None = None,
) -> DataFrame:
    """Lexical ranking with stop words taken out after stemming, then a pairwise scorer on
    the full text: one that is learned from ``judged`` (docno, good), or that ``scorer`` makes; without either,
    term overlap is used."""
    hits, texts = located(corpus, queries, calendar, model, C.STEM_THEN_STOP, stop_words, depth)
    if judged is not None:
        scored = learned.learned_scorer(judged, [*REQUEST, "q_id"])(hits)
    elif scorer is not None:
        scored = rerank.with_model_score(hits, scorer)
    else:
        scored = rerank.with_overlap_score(hits)
    return finished(scored, texts, rerank_depth)


RERANKERS = {"COLBERT": rank_rerank_colbert, "T5": rank_rerank_t5}


def run_digest(
    corpus: DataFrame,
    queries: DataFrame,
    calendar: DataFrame,
    model: str = "BM25",
    reranker: str = "COLBERT",
    summarise: bool | Callable = False,
    save_to: str | None = None,
    **options,
) -> DataFrame:
    """Rank, rerank and group; then optionally summarise and save as CSV.

    ``summarise`` is True for the extractive answer, or a factory of a batch summarizer.
    """
    if model not in ranking.MODELS:
        raise ValueError(f"unknown model {model!r}, choose one of {sorted(ranking.MODELS)}")
    if reranker not in RERANKERS:
        raise ValueError(f"unknown reranker {reranker!r}, choose one of {sorted(RERANKERS)}")
    out = digest.group_documents(RERANKERS[reranker](corpus, queries, calendar, model, **options))
    if callable(summarise):
        out = summaries.finalised(summaries.with_batch_summaries(out, summarise))
    elif summarise:
        out = summaries.finalised(summaries.with_answers(out))
    if save_to:
        write_named_csv(out, save_to, model, reranker, bool(summarise))
    return out
