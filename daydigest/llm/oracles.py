"""DuckDB SQL that gives the same rows as the queries of this subpackage."""

from __future__ import annotations

CONTAMINATION = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), gram AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM gram
), win AS (
    SELECT row_id, n, i, w[i:i + n - 1] AS g
    FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
), hit AS (
    SELECT row_id, i, gram.n, item_id FROM win JOIN gram ON win.n = gram.n AND win.g = gram.g
), hit_words AS (
    SELECT row_id, count(DISTINCT p) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY row_id
), hit_items AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM hit) GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sizes AS (
    SELECT *, length('<|im_start|>' || regexp_replace(
            replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')
        || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) AS chars
    FROM turns
), conv AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
            ORDER BY turn NULLS FIRST, role, text), '') AS loss
    FROM sizes GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
    sha256(loss) AS loss_sha256, formatted_chars
FROM conv
"""

TOP_K = """
WITH v AS (
    SELECT row_number() OVER () AS row_id, vec_id,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, q.row_id AS q, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.row_id <> c.row_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
WHERE rank <= 5
"""

LINES = r"""
WITH doc AS (
    SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), line AS (
    SELECT row_id, i, l[i] AS line, translate(
        regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT row_id, l, unnest(range(1, len(l) + 1)) AS i FROM doc)
), frequent AS (
    SELECT key FROM line WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_id) >= 10
), marked AS (
    SELECT row_id, i, line, frequent.key IS NOT NULL AS gone FROM line LEFT JOIN frequent USING (key)
), kept AS (
    SELECT row_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY row_id
)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(text) AS kept_sha256
FROM doc JOIN kept USING (row_id)
"""

SPELLING = r"""
WITH RECURSIVE crc_table AS (
    -- the checksum of each byte, by its eight bits
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), run AS (
    SELECT id, run, count(*) AS n
    FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
    WHERE length(run) >= 7 GROUP BY id, run
), coded AS (
    SELECT run, n, hex(id || ':' || run) AS h FROM run
), summed AS (
    SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
        lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
    FROM coded, crc_table
), word AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN crc % 31 <> 0 THEN run
            ELSE substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) END AS word FROM summed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT cut.word, word.word FROM cut JOIN word ON cut.d = word.word
    UNION SELECT word.word, cut.word FROM cut JOIN word ON cut.d = word.word
), best AS (
    SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n
    FROM near JOIN word ON other = word.word GROUP BY near.word
), form AS (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
        CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
    FROM word LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM form
    UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.root = form.word WHERE form.form IS NOT NULL
), last AS (
    SELECT chain.word, root FROM chain JOIN form ON root = form.word WHERE form.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM form JOIN last USING (word)
"""

JACCARD = r"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingled AS (
    SELECT row_id, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS l
    FROM doc
), member AS (
    -- documents of equal sets are one node
    SELECT doc_id, l, len(l) AS n, min(row_id) OVER (PARTITION BY l) AS s FROM shingled
), node AS (
    SELECT DISTINCT s, n, l FROM member WHERE n > 0
), gram AS (
    SELECT s, n, unnest(l) AS g FROM node
), link AS (
    SELECT a.s AS x, b.s AS y FROM gram a JOIN gram b ON a.g = b.g AND a.s <> b.s
    GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT s, s AS other FROM node
    UNION SELECT reach.s, link.y FROM reach JOIN link ON reach.other = link.x
), component AS (
    SELECT reach.s, min(doc_id) AS component_id FROM reach JOIN member ON other = member.s GROUP BY reach.s
)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM member LEFT JOIN component USING (s)
"""
