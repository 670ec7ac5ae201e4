"""Batch summarizers: sentences chosen by their place in a graph, or by use without repetition.

Both are factories for ``summaries.with_batch_summaries``: a group's texts are one row, cut into sentences; what is
computed for it is a matrix of the sentences of that row alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd

SENTENCE_END = re.compile(r"[.!?]+\s+")
TERM = re.compile("[a-z0-9]+")
WORD = re.compile(r"[^ \t\n\r\f\v]+")
# Steps of the walk over the graph, and the chance that it goes on along an edge.
STEPS = 10
DAMPING = 0.85
SENTENCES = 3
# Ratings are compared after so many digits, so that ties are ties.
DIGITS = 9
# Bounds of a short summary in words, and the weight of repetition against use.
LEAST_WORDS, MOST_WORDS = 10, 20
PENALTY = 0.5


def sentences_of(text: str | None) -> list[str]:
    return SENTENCE_END.split(text) if text else []


def term_sets(sentences: list[str]) -> list[set[str]]:
    return [set(TERM.findall(s.lower())) for s in sentences]


def term_matrix(sets: list[set[str]]) -> np.ndarray:
    """A row for each sentence, a column for each term, 1 where the sentence has it."""
    column = {t: i for i, t in enumerate(set().union(*sets))}
    matrix = np.zeros((len(sets), len(column)))
    for row, terms in zip(matrix, sets):
        row[[column[t] for t in terms]] = 1.0
    return matrix


def walk_ratings(sets: list[set[str]]) -> np.ndarray:
    """How often a walk over the sentences comes to each: from a sentence it goes to another in proportion to the
    cosine of their term sets, or starts anew at any."""
    matrix = term_matrix(sets)
    size = matrix.sum(axis=1)
    alike = matrix @ matrix.T / np.sqrt(np.maximum(np.outer(size, size), 1.0))
    np.fill_diagonal(alike, 0.0)
    degree = alike.sum(axis=1)
    chance = alike / np.where(degree > 0, degree, 1.0)[:, None]
    n = len(sets)
    rating = np.full(n, 1.0 / n)
    for _ in range(STEPS):
        rating = (1 - DAMPING) / n + DAMPING * (rating @ chance)
    return np.round(rating, DIGITS)


def central_sentences(text: str | None, most: int = SENTENCES) -> str | None:
    """The ``most`` sentences of the highest rating (ties: the first), in the order of the text, joined by '. ';
    a null text stays null, and an empty one is empty."""
    sentences = sentences_of(text)
    if not sentences:
        return text
    rating = walk_ratings(term_sets(sentences))
    best = sorted(sorted(range(len(sentences)), key=lambda i: (-rating[i], i))[:most])
    return ". ".join(sentences[i] for i in best)


def graph_summarizer(most: int = SENTENCES) -> Callable[[], Callable[[pd.DataFrame], pd.Series]]:
    """A factory of a batch model that answers with a group's central sentences."""

    def factory():
        return lambda batch: batch["texts"].map(lambda text: central_sentences(text, most))

    return factory


def fresh_sentences(
    text: str | None, query: str | None, least: int = LEAST_WORDS, most: int = MOST_WORDS, penalty: float = PENALTY
) -> str | None:
    """A summary of ``least`` to ``most`` words. Sentences are taken one by one, each time the one with the highest
    share of the query's terms less ``penalty`` times the share of its own terms that are taken already (ties: the
    first), until ``least`` words are reached or no sentence is left; they are joined in the order taken by one
    space and cut behind ``most`` words. Without a limit of words (None) the last sentence stays whole."""
    sentences = sentences_of(text)
    if not sentences:
        return text
    matrix = term_matrix(term_sets([query or "", *sentences]))
    wanted, have = matrix[0], matrix[1:]
    use = have @ wanted / max(1.0, wanted.sum())
    size = np.maximum(have.sum(axis=1), 1.0)
    seen = np.zeros(matrix.shape[1])
    left, words = np.ones(len(sentences), bool), []
    while left.any() and len(words) < least:
        rating = np.where(left, np.round(use - penalty * (have @ seen) / size, DIGITS), -np.inf)
        best = int(rating.argmax())
        left[best] = False
        seen = np.maximum(seen, have[best])
        words += WORD.findall(sentences[best])
    return " ".join(words[:most])


def short_summarizer(
    least: int = LEAST_WORDS, most: int = MOST_WORDS, penalty: float = PENALTY
) -> Callable[[], Callable[[pd.DataFrame], pd.Series]]:
    """A factory of a batch model that answers with ``fresh_sentences`` on a group's question."""

    def factory():
        return lambda batch: pd.Series(
            [fresh_sentences(t, q, least, most, penalty) for t, q in zip(batch["texts"], batch["question"])], dtype=object
        )

    return factory
