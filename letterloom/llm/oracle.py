"""SQL for the queries of this subpackage that SQL can express, for DuckDB over the same tables.

The others hold learned filters, XXH64, a tokenizer, HTML or a dynamic programme; tests hold them
against brute-force versions.
"""

from __future__ import annotations

_CHAT_RAW = r"""
all_turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
-- a text is escaped if it holds a control string or something that reading would unescape
turns AS (
    SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
        THEN length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) ELSE length(text) END AS shown
    FROM all_turns
)
"""

CHAT = rf"""
WITH {_CHAT_RAW}
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|>') + length(role) + 1 + shown + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
    TRUE AS round_trip
FROM turns GROUP BY conv_id
"""

CONTAMINATION = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
),
item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
item_starts AS (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0
),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS gram FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
    SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN windows USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs
) WHERE rank <= 5
"""

PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
spots AS (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m
),
f AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS p, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE m >= 2),
cuts AS (SELECT lang, m, p, f AS a, unnest(range(1, m)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.m, c.p, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.m)
    JOIN sizes s ON s.lang = c.lang
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
-- every phrase inside a candidate that is as frequent
parts AS (SELECT lang, m, p, f, unnest(range(2, m)) AS size FROM candidates),
insides AS (SELECT lang, p, f, size, unnest(range(1, m - size + 2)) AS i FROM parts),
dropped AS (SELECT DISTINCT x.lang, x.p FROM insides i JOIN candidates x ON x.lang = i.lang AND x.p = list_slice(i.p, i, i + size - 1) AND 100 * i.f >= 100 * x.f)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
        array_to_string(p, ' ') AS phrase, a, l, r, n, score
    FROM lowest ANTI JOIN dropped USING (lang, p)
) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op3_chat": CHAT,
    "op5_contamination": CONTAMINATION,
    "op9_top_k": TOP_K,
    "op11_phrases": PHRASES,
}
