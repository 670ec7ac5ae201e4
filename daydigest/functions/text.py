"""Terms of a text: tokens, stop words, and small text expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an index stores of a text where it is told to crop it.
CROPPED_TEXT_LENGTH = 200

# One term: a run of letters and digits, whatever its length.
TERM = "[a-z0-9]+"

# Common English stop words as the tokenizer yields them.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now
    """.split()
)


def tokens(text: Column | str) -> Column:
    """Lower-case alphanumeric terms in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def terms_without_stop_words(text: str, stop_words=STOP_WORDS) -> Column:
    """Terms of column ``text`` that are not stop words, in text order."""
    listed = ", ".join(f"'{word}'" for word in stop_words)
    terms = f"regexp_extract_all(lower({text}), r'{TERM}', 0)"
    return F.expr(f"filter({terms}, term -> term NOT IN ({listed}))")


def coded_terms(lowered: pa.Array, stop_words=STOP_WORDS) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """``terms_without_stop_words`` of a batch of texts that are in lower case already: of each term in order its text,
    counted from 0, and its place among the different terms, which come last. A null text has no terms."""
    lowered = pc.fill_null(lowered.cast(pa.large_string()), "")
    _, offsets, data = lowered.buffers()
    ends = np.frombuffer(offsets, np.int64)[lowered.offset : lowered.offset + len(lowered) + 1] if len(lowered) else np.zeros(1, np.int64)
    first, ends = ends[0], ends - ends[0]
    data = np.frombuffer(data or b"", np.uint8)[first : first + ends[-1]]
    # letters and digits are one byte each, and no other character has such a byte
    in_term = (data - ord("a") < 26) | (data - ord("0") < 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    begins, lasts = in_term.copy(), in_term.copy()
    begins[1:] &= ~in_term[:-1] | edge[1:-1]
    lasts[:-1] &= ~in_term[1:] | edge[1:-1]
    begins = np.flatnonzero(begins)
    offsets = np.append(0, np.cumsum(np.flatnonzero(lasts) - begins + 1))
    terms = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[in_term])).cast(pa.string())
    terms = terms.dictionary_encode()
    kept = ~pc.is_in(terms.dictionary, value_set=pa.array(stop_words, pa.string())).to_numpy(zero_copy_only=False)
    codes = np.where(kept, np.cumsum(kept) - 1, -1)[terms.indices.to_numpy()]
    text = np.repeat(np.arange(len(lowered)), np.diff(np.searchsorted(begins, ends)))
    return text[codes >= 0], codes[codes >= 0], terms.dictionary.filter(pa.array(kept))


def is_stop_word(term: str, stop_words=STOP_WORDS) -> Column:
    return F.expr(f"{term} IN ({', '.join(repr(word) for word in stop_words)})")


def each(listed: Column | str) -> Column:
    """One row per entry, and one null row for an empty list.

    The plain ``explode`` makes Spark check the size of the list in the scan, which
    would tokenise every text again; callers drop the null rows afterwards.
    """
    return F.explode_outer(listed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cropped(text: Column | str, chars: int = CROPPED_TEXT_LENGTH) -> Column:
    """The first ``chars`` characters of a text, as an index stores them that is told to."""
    return F.substring(text, 1, chars)


# Fixed value: hashtags, links and mentions.
SOCIAL_MARKS = r"#\S+|https?://\S+|@\S+"


def clean_social(text: Column | str) -> Column:
    return F.regexp_replace(text, SOCIAL_MARKS, "")


def joined_with_dots(texts: Column) -> Column:
    """Texts joined by '. ', with doubled dots made single."""
    return F.replace(F.array_join(texts, ". "), F.lit(".."), F.lit("."))


# The instruction given to the answering model.
PROMPT_HEAD = """
            You are a helpful assistant. Answer the question based only on the text provided below. 
            If no answers can be found at all, return "unanswerable"

            Don't make the responses conversational.
            Expressions like hundreds of thousands can be answers to questions asking how many or how much.
            Do not line break the text and just give me the output.

            Text:
            """
PROMPT_MIDDLE = """

            Question:
            """
PROMPT_TAIL = """
            """


def as_question(question: Column | str) -> Column:
    return F.concat(question, F.lit("?"))


def prompt(texts: Column | str, question: Column | str) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD), texts, F.lit(PROMPT_MIDDLE), as_question(question), F.lit(PROMPT_TAIL)
    )
