"""Porter's stemmer (1980) as column expressions, so that it stays in the JVM.

The conditions on the measure m of a stem are regular expressions over its consonant
and vowel runs. Each step is a SQL expression over its word, bound through a one-element
``transform``, so that the whole is one expression of linear size, however often a step
looks at the word. Apply it to distinct terms, not to running text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of consonants and vowels. A leading y is a consonant; it is held as Y while
# the steps run, so that [aeiouy] does not take it for a vowel.
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"

M_ABOVE_0 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
M_IS_1 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
M_ABOVE_1 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT_END = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLE_END = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx0123456789") + ")$"

# Suffix -> replacement, in the order of the paper.
STEP_1A = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "abli": "able",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
}
STEP_3 = {
    "icate": "ic",
    "ative": "",
    "alize": "al",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
}
STEP_4 = [
    "al",
    "ance",
    "ence",
    "er",
    "ic",
    "able",
    "ible",
    "ant",
    "ement",
    "ment",
    "ent",
    "ion",  # after s or t only
    "ou",
    "ism",
    "ate",
    "iti",
    "ous",
    "ive",
    "ize",
]


def suffix_pattern(suffixes) -> str:
    """Any of the suffixes at the end; the leftmost match is the longest suffix."""
    return f"(?:{'|'.join(suffixes)})$"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with ``value`` computed once under ``name``."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _split(suffixes, use: str) -> str:
    """``use`` of head and tail, tail being the longest matching suffix or empty."""
    tail = f"regexp_extract(word, '{suffix_pattern(suffixes)}', 0)"
    head = "substring(word, 1, length(word) - length(tail))"
    return _let("tail", tail, _let("head", head, use))


def _replace_suffix(rules: dict[str, str], condition: str) -> str:
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in rules.items())
    new = f"concat(head, CASE tail {cases} END)"
    return _split(rules, f"CASE WHEN tail <> '' AND {condition} THEN {new} ELSE word END")


SHORTER = "substring(word, 1, length(word) - 1)"

STEP_1B = _split(
    ["eed", "ed", "ing"],
    f"""CASE
        WHEN tail = 'eed' THEN IF(head RLIKE '{M_ABOVE_0}', concat(head, 'ee'), word)
        WHEN tail = '' OR NOT head RLIKE '{HAS_VOWEL}' THEN word
        WHEN head RLIKE '{DOUBLE_END}' THEN substring(head, 1, length(head) - 1)
        WHEN head RLIKE '(at|bl|iz)$' OR head RLIKE '{SHORT_END}' THEN concat(head, 'e')
        ELSE head END""",
)
STEP_1C = f"IF(word LIKE '%y' AND {SHORTER} RLIKE '{HAS_VOWEL}', concat({SHORTER}, 'i'), word)"
DROP_SUFFIX = _split(
    STEP_4,
    f"""CASE WHEN tail = '' OR (tail = 'ion' AND NOT head RLIKE '[st]$') THEN word
        WHEN head RLIKE '{M_ABOVE_1}' THEN head ELSE word END""",
)
FINAL_E = _let(
    "head",
    SHORTER,
    f"""CASE WHEN NOT word LIKE '%e' THEN word
        WHEN head RLIKE '{M_ABOVE_1}' THEN head
        WHEN head RLIKE '{M_IS_1}' AND NOT head RLIKE '{SHORT_END}' THEN head
        ELSE word END""",
)
FINAL_DOUBLE_L = f"IF(word LIKE '%ll' AND word RLIKE '{M_ABOVE_1}', {SHORTER}, word)"

STEPS = [
    _replace_suffix(STEP_1A, "true"),
    STEP_1B,
    STEP_1C,
    _replace_suffix(STEP_2, f"head RLIKE '{M_ABOVE_0}'"),
    _replace_suffix(STEP_3, f"head RLIKE '{M_ABOVE_0}'"),
    DROP_SUFFIX,
    FINAL_E,
    FINAL_DOUBLE_L,
]


def porter_stem(term: str) -> Column:
    """The Porter stem of lower-case column ``term``; words of one or two letters stay."""
    word = f"regexp_replace({term}, '^y', 'Y')"
    for step in STEPS:
        word = _let("word", word, step)
    return F.expr(f"IF(length({term}) > 2, lower({word}), {term})")
