"""Building blocks of the DuckDB twins: common tables, terms, stems and scores."""

from __future__ import annotations

from daydigest.functions import porter as P
from suite.tables import LANGUAGES

# The common English stop words, written out a second time on purpose.
STOPS = ", ".join(
    f"'{w}'"
    for w in """
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
LANGS = ", ".join(f"'{x}'" for x in LANGUAGES)

DOCS = """docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.event_type, e.value,
    epoch_us(e.ts) // 1000000 AS unix_timestamp, strftime(e.ts, '%Y-%m-%d') AS date,
    strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS moment,
    'Doc-' || d.lang || '-' || d.source || '-' || d.doc_id AS docno, d.lang AS event_id
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""
CALENDAR = """days AS (SELECT DISTINCT event_id, date FROM docs),
calendar AS (
  SELECT event_id, date, day_pos, event_id || '-r' || (day_pos + 1) AS request_id
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY date) - 1 AS INTEGER)
        AS day_pos FROM days))"""
QUERIES = f"""queries AS (
  SELECT printf('q%03d', item_id) AS query_id, text, text AS indicative_terms,
    'Report-' || (item_id % 5) AS trecis_category_mapping, event_id,
    'Event ' || event_id AS event_title
  FROM benchmark, (SELECT unnest([{LANGS}]) AS event_id))"""
FACTS = """facts AS (
  SELECT d.event_type AS run_id, c.request_id AS "requestID", d.text AS "factText",
    d.unix_timestamp AS "unixTimestamp", d.value AS importance, d.docno,
    d.source AS "informationNeeds", d.doc_id AS position
  FROM docs d JOIN calendar c USING (event_id, date))"""
JUDGED = """judged AS (
  SELECT request_id, day_pos AS request_pos FROM calendar SEMI JOIN (
    SELECT event_id, date FROM docs SEMI JOIN (
      SELECT doc_id FROM labels WHERE quality = 1) g USING (doc_id)) j USING (event_id, date))"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def plain_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def terms(text: str) -> str:
    return plain_tokens(text)


def _cases(rules: dict[str, str]) -> str:
    return "CASE tail " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def stems(source: str, column: str, name: str = "stems") -> str:
    """Tables that end in ``name`` (surface, term): the Porter stem of each distinct word."""
    short = "left(w, length(w) - 1)"
    m0 = has("head", P.M_ABOVE_0)
    long_head = f"({has('head', P.M_ABOVE_1)} OR ({has('head', P.M_IS_1)} AND NOT {has('head', P.SHORT_END)}))"
    steps = [
        (P.STEP_1A, f"CASE WHEN tail <> '' THEN head || {_cases(P.STEP_1A)} ELSE w END"),
        (
            ["eed", "ed", "ing"],
            f"""CASE WHEN tail = 'eed' THEN CASE WHEN {m0} THEN head || 'ee' ELSE w END
            WHEN tail = '' OR NOT {has('head', P.HAS_VOWEL)} THEN w
            WHEN {has('head', P.DOUBLE_END)} THEN left(head, length(head) - 1)
            WHEN {has('head', '(at|bl|iz)$')} OR {has('head', P.SHORT_END)} THEN head || 'e'
            ELSE head END""",
        ),
        (["y"], f"CASE WHEN tail = 'y' AND {has('head', P.HAS_VOWEL)} THEN head || 'i' ELSE w END"),
        (P.STEP_2, f"CASE WHEN tail <> '' AND {m0} THEN head || {_cases(P.STEP_2)} ELSE w END"),
        (P.STEP_3, f"CASE WHEN tail <> '' AND {m0} THEN head || {_cases(P.STEP_3)} ELSE w END"),
        (
            P.STEP_4,
            f"""CASE WHEN tail = '' OR (tail = 'ion' AND NOT {has('head', '[st]$')}) THEN w
            WHEN {has('head', P.M_ABOVE_1)} THEN head ELSE w END""",
        ),
        (["e"], f"CASE WHEN tail = 'e' AND {long_head} THEN head ELSE w END"),
        (["ll"], f"CASE WHEN tail = 'll' AND {has('w', P.M_ABOVE_1)} THEN {short} ELSE w END"),
    ]
    out = [
        f"{name}_0 AS (SELECT surface, regexp_replace(surface, '^y', 'Y') AS w "
        f"FROM (SELECT DISTINCT {column} AS surface FROM {source}))"
    ]
    for i, (suffixes, case) in enumerate(steps, 1):
        out.append(
            f"""{name}_{i} AS (SELECT surface, {case} AS w FROM (
            SELECT *, left(w, length(w) - length(tail)) AS head FROM (
            SELECT *, regexp_extract(w, '{P.suffix_pattern(suffixes)}') AS tail
            FROM {name}_{i - 1})))"""
        )
    out.append(
        f"{name} AS MATERIALIZED (SELECT surface, CASE WHEN length(surface) > 2 THEN lower(w) "
        f"ELSE surface END AS term FROM {name}_{len(steps)})"
    )
    return ",\n".join(out)


def statistics(steps: tuple[str, ...]) -> str:
    """tf, dl, df, cf, sizes of the corpus and qtf of the queries."""
    parts = [
        f"doc_words AS MATERIALIZED (SELECT event_id, date, docno, unnest({terms('text')}) AS surface FROM docs)",
        f"query_words AS (SELECT event_id, query_id AS q_id, unnest({terms('indicative_terms')}) AS surface FROM queries)",
        "words AS (SELECT surface FROM doc_words UNION ALL SELECT surface FROM query_words)",
    ]
    if "stem" in steps:
        parts.append(stems("words", "surface"))
    else:
        parts.append("stems AS (SELECT DISTINCT surface, surface AS term FROM words)")
    stop = {"stop": "surface", "stem": "term"}[steps[0]]
    keep = f"WHERE {stop} NOT IN ({STOPS})" if "stop" in steps else ""
    parts += [
        f"doc_terms AS MATERIALIZED (SELECT event_id, date, docno, term FROM doc_words JOIN stems USING (surface) {keep})",
        f"qterms AS (SELECT event_id, q_id, term, count(*) AS qtf FROM query_words JOIN stems USING (surface) {keep} GROUP BY ALL)",
        "tfs AS (SELECT event_id, date, docno, term, count(*) AS tf FROM doc_terms GROUP BY ALL)",
        "dls AS (SELECT event_id, date, docno, count(term) AS dl FROM docs LEFT JOIN doc_terms USING (event_id, date, docno) GROUP BY ALL)",
        "dfs AS (SELECT event_id, date, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tfs GROUP BY ALL)",
        "sizes AS (SELECT event_id, date, count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_terms FROM dls GROUP BY ALL)",
    ]
    return ",\n".join(parts)


# The models' published default parameters, written out here so that the twins stand on their own.
K = "(1.2 * (0.25 + 0.75 * dl / avgdl))"
TN = "(tf * log2(1 + 1.0 * avgdl / dl))"
LE = "1.4426950408889634"
FORMULAS = {
    "BM25": f"log2((n_docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / ({K} + tf) * 9.0 * qtf / (8.0 + qtf)",
    "TF_IDF": f"qtf * 1.2 * tf / (tf + {K}) * log2(n_docs / df + 1)",
    "PL2": f"qtf / ({TN} + 1) * ({TN} * log2(n_docs / cf) + cf / n_docs * {LE}"
    f" + 0.5 * log2(2 * pi() * {TN}) + {TN} * (log2({TN}) - {LE}))",
    "InL2": f"qtf * {TN} / ({TN} + 1) * log2((n_docs + 1) / (df + 0.5))",
    "DPH": "CASE WHEN tf < dl THEN qtf * (1 - tf / dl) * (1 - tf / dl) / (tf + 1)"
    " * (tf * log2(tf * (avgdl / dl) * (n_docs / cf)) + 0.5 * log2(2 * pi() * tf * (1 - tf / dl)))"
    " ELSE 0.0 END",
    "DirichletLM": "qtf * (log2(1 + tf / (2500.0 * cf / n_terms)) + log2(2500.0 / (dl + 2500.0)))",
    "Hiemstra_LM": "qtf * log2(1 + 0.15 * tf * n_terms / (0.85 * cf * dl))",
    "DFRee": "qtf * tf * log2(((tf + 1) / (dl + 1)) / (tf / dl)) * (-tf * log2(tf / dl * (n_terms / cf))"
    " + (tf + 1) * log2((tf + 1) / (dl + 1) * (n_terms / cf))"
    " + 0.5 * log2(((tf + 1) / (dl + 1)) / (tf / dl)))",
}


def ranked(model: str = "BM25", steps=("stop", "stem"), depth: int = 50, name: str = "hits") -> str:
    """Tables that end in ``name`` (event_id, date, q_id, docno, score, rank)."""
    return f"""{DOCS},
{CALENDAR},
{QUERIES},
{statistics(steps)},
joined AS (
  SELECT event_id, date, q_id, docno, CAST(tf AS DOUBLE) AS tf, CAST(dl AS DOUBLE) AS dl,
    CAST(qtf AS DOUBLE) AS qtf, CAST(df AS DOUBLE) AS df, CAST(cf AS DOUBLE) AS cf,
    CAST(n_docs AS DOUBLE) AS n_docs, CAST(n_terms AS DOUBLE) AS n_terms,
    CAST(n_terms AS DOUBLE) / n_docs AS avgdl
  FROM tfs JOIN qterms USING (event_id, term) JOIN dls USING (event_id, date, docno)
  JOIN dfs USING (event_id, date, term) JOIN sizes USING (event_id, date)),
scored AS (SELECT event_id, date, q_id, docno, round(sum({FORMULAS[model]}), 6) AS score
  FROM joined GROUP BY ALL),
{name} AS MATERIALIZED (SELECT *, CAST(n - 1 AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, date, q_id ORDER BY score DESC, docno) AS n
  FROM scored) WHERE n <= {depth})"""


def overlap(query: str, text: str) -> str:
    """Coverage of the query plus share of the text, over distinct terms."""
    q, t = f"list_distinct({query})", f"list_distinct({text})"
    return f"""round(coalesce(len(list_intersect({q}, {t})) / nullif(len({q}), 0), 0.0)
    + coalesce(len(list_intersect({q}, {t})) / nullif(len({t}), 0), 0.0), 6)"""


def context(path: str = "COLBERT", model: str = "BM25") -> str:
    """Tables that end in ``context``: the first-stage hits with text, time and query."""
    steps = ("stop", "stem") if path == "COLBERT" else ("stem", "stop")
    return f"""{ranked(model, steps)},
context AS (
  SELECT h.*, d.unix_timestamp, d.moment, d.text, c.request_id, q.text AS question,
    q.indicative_terms AS query, q.event_title, q.trecis_category_mapping, d.source
  FROM hits h JOIN docs d USING (event_id, date, docno) JOIN calendar c USING (event_id, date)
  JOIN queries q ON q.event_id = h.event_id AND q.query_id = h.q_id)"""


def reranked(path: str = "COLBERT", model: str = "BM25", depth: int = 5) -> str:
    """Tables that end in ``ranked``, the whole ranked table of one path."""
    return f"""{context(path, model)},
term_lists AS (SELECT *, {terms('query')} AS qt, {terms('text')} AS dt FROM context),
rescored AS (SELECT * EXCLUDE (qt, dt), {overlap('qt', 'dt')} AS rerank_score FROM term_lists),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY event_id, date, q_id ORDER BY rerank_score DESC, docno) AS INTEGER) AS rerank_rank
  FROM rescored) WHERE rerank_rank <= {depth}),
ranked AS MATERIALIZED (
  SELECT *, date AS request_date, (rerank_score - low) / nullif(high - low, 0) AS importance
  FROM best JOIN (SELECT request_id, min(rerank_score) AS low, max(rerank_score) AS high
    FROM best GROUP BY ALL) USING (request_id))"""


def grouped(path: str = "COLBERT", model: str = "BM25") -> str:
    return f"""{reranked(path, model)},
grouped AS MATERIALIZED (
  SELECT request_id, q_id, event_id AS "Event", event_title,
    string_agg(text, ' ' ORDER BY importance DESC NULLS LAST, docno) AS texts,
    string_agg(docno, '|' ORDER BY importance DESC NULLS LAST, docno) AS docno_list,
    avg(importance) AS avg_importance, min(unix_timestamp) AS unix_timestamp,
    min(question) AS question, min(query) AS query
  FROM ranked GROUP BY request_id, q_id, event_id, event_title)"""


def best_sentence(texts: str, query: str) -> str:
    """Struct (m, p, s): matches, minus position, sentence, over the split text."""
    sentences = f"regexp_split_to_array({texts}, '[.!?]+\\s+')"
    return f"""list_max(list_transform({sentences}, lambda s, i: {{
      'm': len(list_filter(list_distinct({plain_tokens(query)}), lambda t: list_contains({plain_tokens('s')}, t))),
      'p': -i, 's': s}}))"""
