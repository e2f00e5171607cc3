"""The SQL that each registered query must agree with, for DuckDB on the same tables."""

from __future__ import annotations

import re

# Written anew here, so that a wrong pattern in the engine shows: every run of letters and digits is a token.
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}\p{Nl}\p{No}]+')"

# Tokens, postings and statistics of documents.text, and the words of each benchmark text.
_BASE = f"""
WITH arrays AS (SELECT doc_id, {_W} AS w FROM documents),
toks AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM arrays),
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS len FROM toks GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, 1 + ln((SELECT count(*) FROM documents)::DOUBLE / (count(*) + 1)) AS idf FROM post GROUP BY ALL),
qarrays AS (SELECT item_id AS query_id, {_W} AS w FROM benchmark),
qtoks AS (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM qarrays),
qwords AS (SELECT query_id, term, count(*) AS times, 1.0::DOUBLE AS boost FROM qtoks GROUP BY ALL),
words AS (SELECT DISTINCT term AS word FROM qtoks)
"""

_WEIGHT = "boost * times * sqrt(tf) * idf * idf / sqrt(len)"

# From clauses (query_id, clause, occur, times) and hits (the same, doc_id, weight) to ranks.
_RANK = """
, totals AS (
  SELECT query_id, count(*) FILTER (occur = 'must') AS n_must,
         coalesce(sum(times) FILTER (occur <> 'must_not'), 0) AS n_scoring
  FROM clauses GROUP BY ALL),
summed AS (
  SELECT query_id, doc_id, sum(weight) FILTER (occur <> 'must_not') AS total,
         coalesce(sum(times) FILTER (occur <> 'must_not'), 0) AS matched,
         count(*) FILTER (occur = 'must') AS must, count(*) FILTER (occur = 'must_not') AS prohibited
  FROM hits GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, round(total * matched / n_scoring, 6) AS score
  FROM summed JOIN totals USING (query_id)
  WHERE must = n_must AND prohibited = 0 AND matched > 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, score, doc_id
  FROM scored)
"""
_TOP = "SELECT query_id, rank, score, doc_id FROM ranked WHERE rank <= 25"


# The stop words of the English list.
_STOP = """('a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'if', 'in', 'into', 'is', 'it', 'no', 'not', 'of',
  'on', 'or', 'such', 'that', 'the', 'their', 'then', 'there', 'these', 'they', 'this', 'to', 'was', 'will', 'with')"""


def _without_stop_words(sql: str) -> str:
    """The same search over texts and queries from which stop words are gone; positions stay."""
    for name in ("toks", "qtoks"):
        sql = re.sub(rf"(?m)^({name} AS \()(.*)(\),)$", rf"\1SELECT * FROM (\2) WHERE term NOT IN {_STOP}\3", sql)
    return sql


def _word_search(occur: str = "'should'", boost: str = "boost") -> str:
    return (
        _BASE
        + f""", clauses AS (
  SELECT query_id, term AS clause, {occur} AS occur, times, {boost} AS boost
  FROM qwords JOIN (SELECT query_id, min(term) AS first FROM qtoks GROUP BY ALL) USING (query_id)),
hits AS (
  SELECT query_id, clause, occur, times, doc_id, {_WEIGHT} AS weight
  FROM clauses JOIN post ON clause = post.term JOIN dfs ON dfs.term = post.term JOIN lens USING (doc_id))"""
        + _RANK
    )


_FIELD = (
    _BASE
    + f""", folders AS (SELECT source, count(*) AS df FROM documents GROUP BY ALL),
clauses AS (
  SELECT query_id, term AS clause, 'should' AS occur, times, boost FROM qwords
  UNION ALL SELECT item_id, 'src' || item_id, 'must', 1, 1.0 FROM benchmark),
hits AS (
  SELECT query_id, clause, occur, times, doc_id, {_WEIGHT} AS weight
  FROM clauses JOIN post ON clause = post.term JOIN dfs ON dfs.term = post.term JOIN lens USING (doc_id)
  WHERE occur = 'should'
  UNION ALL
  SELECT query_id, clause, occur, times, doc_id,
         pow(1 + ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)), 2)
  FROM clauses JOIN documents ON clause = source JOIN folders USING (source) WHERE occur = 'must')"""
    + _RANK
    + _TOP
)

# Every text as one phrase: its i-th word at position start + i, for all of them.
_PHRASE = (
    _BASE
    + """, sizes AS (SELECT query_id, sum(idf) AS idf FROM qtoks JOIN dfs USING (term) GROUP BY ALL),
qsizes AS (SELECT query_id, count(*) AS m FROM qtoks GROUP BY ALL),
places AS (
  SELECT query_id, doc_id, pos - i AS start
  FROM qtoks JOIN toks USING (term) JOIN qsizes USING (query_id)
  GROUP BY query_id, doc_id, pos - i HAVING count(*) = any_value(m)),
freqs AS (SELECT query_id, doc_id, count(*) AS freq FROM places GROUP BY ALL),
clauses AS (SELECT item_id AS query_id, 0 AS clause, 'should' AS occur, 1 AS times FROM benchmark),
hits AS (
  SELECT query_id, 0 AS clause, 'should' AS occur, 1 AS times, doc_id, sqrt(freq) * idf * idf / sqrt(len) AS weight
  FROM freqs JOIN sizes USING (query_id) JOIN lens USING (doc_id))"""
    + _RANK
    + _TOP
)

_SLOP = (
    _BASE
    + """, pairs AS (
  SELECT a.query_id, a.i AS clause, a.term AS a, b.term AS b
  FROM qtoks a JOIN qtoks b ON a.query_id = b.query_id AND b.i = a.i + 1),
distinct_pairs AS (SELECT DISTINCT a, b FROM pairs),
freqs AS (
  SELECT a, b, ta.doc_id, count(DISTINCT ta.pos) AS freq
  FROM distinct_pairs JOIN toks ta ON ta.term = a
  JOIN toks tb ON tb.doc_id = ta.doc_id AND tb.term = b AND abs(tb.pos - ta.pos - 1) <= 2 AND tb.pos <> ta.pos
  GROUP BY ALL),
clauses AS (SELECT query_id, clause, 'should' AS occur, 1 AS times FROM pairs),
hits AS (
  SELECT query_id, clause, 'should' AS occur, 1 AS times, doc_id,
         sqrt(freq) * (da.idf + db.idf) * (da.idf + db.idf) / sqrt(len) AS weight
  FROM pairs JOIN freqs USING (a, b) JOIN dfs da ON da.term = a JOIN dfs db ON db.term = b JOIN lens USING (doc_id))"""
    + _RANK
    + _TOP
)


def _pattern_search(condition: str) -> str:
    """A clause for every word of a query; a document counts once for it however many terms match."""
    return (
        _BASE
        + f""", clauses AS (SELECT query_id, term AS clause, 'should' AS occur, times FROM qwords),
found AS (SELECT word, term FROM words JOIN dfs ON left(term, 1) = left(word, 1) AND {condition}),
matched AS (SELECT DISTINCT word, doc_id FROM found JOIN post USING (term)),
hits AS (
  SELECT query_id, clause, occur, times, doc_id, times::DOUBLE AS weight FROM clauses JOIN matched ON word = clause)"""
        + _RANK
        + _TOP
    )


# This DuckDB's levenshtein counts bytes. Distance depends only on which letters are equal, so
# the accented letters of the query words become capitals (terms hold none) and any other one ~.
def _ascii(column: str) -> str:
    return f"regexp_replace(translate({column}, 'éèêçüäößóñíàâîôûùëïáúæœ', 'ABCDEFGHIJKLMNOPQRSTUVWX'), '[^\\x00-\\x7F]', '~', 'g')"


def _fuzzy_hits(edits: int) -> str:
    return f""", spelt AS (SELECT word, {_ascii('word')} AS plain, length(word) AS size FROM words),
terms AS (SELECT term, {_ascii('term')} AS plain, length(term) AS size FROM dfs),
near AS (
  SELECT word, term FROM spelt JOIN terms
  ON abs(spelt.size - terms.size) <= {edits} AND levenshtein(spelt.plain, terms.plain) <= {edits}),
clauses AS (SELECT query_id, term AS clause, 'should' AS occur, times FROM qwords),
units AS (
  SELECT word, doc_id, sum(round(idf * idf * sqrt(tf) / sqrt(len) * 1e9)::BIGINT)::DOUBLE / 1e9 AS unit
  FROM near JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) GROUP BY ALL),
hits AS (
  SELECT query_id, clause, occur, times, doc_id, times * unit AS weight FROM clauses JOIN units ON word = clause)"""


_NESTED = f"""
WITH words AS ({_word_search()} SELECT query_id, doc_id, score FROM scored),
near AS ({_BASE}{_fuzzy_hits(1)}{_RANK} SELECT query_id, doc_id, score FROM scored)
SELECT query_id, doc_id, round(words.score + near.score, 6) AS score FROM words JOIN near USING (query_id, doc_id)
"""

_UNIT_NAMES = "KMGTPE"


def _size_text(column: str, si: bool = False) -> str:
    base = 1000 if si else 1024
    cases = [f"WHEN {column} < {base} THEN {column} || ' B'"]
    for power, letter in enumerate("kMGTPE" if si else _UNIT_NAMES, start=1):
        unit = f"{letter}{'' if si else 'i'}B"
        bound = f"WHEN {column} < {base ** (power + 1)}" if power < 6 else "WHEN TRUE"
        cases.append(f"{bound} THEN printf('%.1f', round({column} / {float(base ** power)!r}::DOUBLE, 1)) || ' {unit}'")
    return f"CASE {' '.join(cases)} END"


def _html_text(column: str) -> str:
    out = column
    for element in ("script", "style"):
        out = f"regexp_replace({out}, '(?is)<{element}[^>]*>.*?</{element}>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    # the inline elements of the pages; every other tag parts words
    out = f"regexp_replace({out}, '</?(a|b)( [^>]*)?>', '', 'g')"
    out = f"regexp_replace({out}, '<[!/]?[A-Za-z][^>]*>', ' ', 'g')"
    # the references that occur in the pages; & comes last so that nothing is decoded twice
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_DUPES = """
SELECT {columns} FROM (
  SELECT md5(text) AS hash, octet_length(encode(text)) AS bytes, sha256(text) AS digest, doc_id,
         count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first_key
  FROM documents WHERE text <> '')
WHERE n > 1
"""
_DUPES_PLAIN = _DUPES.format(columns="doc_id, n, first_key")

_OLD = "SELECT doc_id, source || '/' || doc_id || '.eml' AS path, doc_id AS stamp FROM documents WHERE source <> 'src7'"
_NEW = """SELECT doc_id, source || '/' || doc_id || '.eml' AS path, doc_id + coalesce(toxic, 0) AS stamp
FROM documents LEFT JOIN labels USING (doc_id) WHERE source <> 'src3'"""
_LISTINGS = f"WITH old AS ({_OLD}), new AS ({_NEW})"

_EVENT_ROWS = """WITH rows AS (SELECT event_type AS folder, event_id AS uid, value AS size, epoch_us(ts) AS us FROM events),
mid AS (SELECT (min(us) + max(us)) // 2 AS middle FROM rows)"""

_SENT = "strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%d %H:%M:%S')"

_EXACT = (
    _BASE
    + """, clauses AS (
  SELECT item_id AS query_id, 0 AS clause, 'should' AS occur, 1 AS times, 1.0 AS boost, 'id' AS field, item_id || '.eml' AS term FROM benchmark
  UNION ALL SELECT item_id, 1, 'should', 1, 2.0, 'path', 'src' || (item_id % 15) || '/' || item_id || '.eml' FROM benchmark),
named AS (
  SELECT doc_id, 'id' AS field, doc_id || '.eml' AS term FROM documents
  UNION ALL SELECT doc_id, 'path', source || '/' || doc_id || '.eml' FROM documents),
hits AS (
  SELECT query_id, clause, occur, times, doc_id,
    boost * pow(1 + ln((SELECT count(*) FROM documents)::DOUBLE / (count(*) OVER (PARTITION BY query_id, clause) + 1)), 2) AS weight
  FROM clauses JOIN named USING (field, term))"""
    + _RANK
    + _TOP
)

ORACLE_SQL: dict[str, str] = {
    "dupes_md5": "SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1",
    "dupes_members": _DUPES.format(columns="hash, doc_id, n, first_key"),
    "dupes_verified": _DUPES.format(columns="hash, bytes, digest, doc_id, n, first_key"),
    "dupes_prefix": """SELECT doc_id, n, first_key FROM (
  SELECT doc_id, count(*) OVER (PARTITION BY head) AS n, min(doc_id) OVER (PARTITION BY head) AS first_key
  FROM (SELECT doc_id, left(hex(encode(text)), 128) AS head FROM documents WHERE text <> '')) WHERE n > 1""",
    "dupes_staged": _DUPES_PLAIN,
    "dupes_crc32": _DUPES_PLAIN,
    "dupes_adler32": _DUPES_PLAIN,
    "dupes_fast64": _DUPES_PLAIN,
    "postings": f"""SELECT term, doc_id, count(*)::INTEGER AS tf, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos FROM (
  SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_W} AS w FROM documents))
GROUP BY term, doc_id""",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_W})) AS term FROM documents) GROUP BY term",
    "doc_len": f"SELECT doc_id, len({_W})::INTEGER AS len FROM documents",
    "search_any": _word_search() + _TOP,
    "search_all": _word_search("'must'") + _TOP,
    "search_not": _word_search("CASE WHEN term = first THEN 'must_not' ELSE 'should' END") + _TOP,
    "search_field": _FIELD,
    "search_boost": _word_search(boost="CASE WHEN length(term) > 4 THEN 3.0 ELSE 1.0 END::DOUBLE") + _TOP,
    "search_phrase": _PHRASE,
    "search_any_stop": _without_stop_words(_word_search() + _TOP),
    "search_all_stop": _without_stop_words(_word_search("'must'") + _TOP),
    "search_phrase_stop": _without_stop_words(_PHRASE),
    "search_phrase_slop": _SLOP,
    "search_prefix": _pattern_search("starts_with(term, left(word, 4))"),
    "search_wildcard": _pattern_search("ends_with(term, right(word, 2)) AND regexp_full_match(term, left(word, 2) || '..*' || right(word, 2))"),
    "search_regex": _pattern_search("starts_with(term, left(word, 2)) AND regexp_full_match(term, left(word, 2) || '[a-m]+' || right(word, 1) || '?')"),
    "search_fuzzy": _BASE + _fuzzy_hits(2) + _RANK + _TOP,
    "search_range": _pattern_search("term BETWEEN word AND left(word, 2) || 'z'"),
    "search_rejected": f"""{_BASE}, first AS (SELECT query_id, term, min(i) AS clause_id FROM qtoks GROUP BY ALL)
SELECT query_id, clause_id, CASE clause_id % 3 WHEN 0 THEN term || '(' ELSE '*' || term END AS term,
  CASE clause_id % 3 WHEN 0 THEN 'a bracket is not closed' ELSE 'nothing to repeat at 0' END AS reason
FROM first WHERE clause_id % 3 < 2""",
    "search_exact": _EXACT,
    "search_blank": (_word_search() + _TOP).replace("FROM benchmark", "FROM (SELECT * FROM benchmark WHERE item_id % 3 <> 0)"),
    "search_all_docs": f"""SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE NOT list_has_any({_W},
  (SELECT list(DISTINCT t) FROM (SELECT unnest({_W}) AS t FROM benchmark)))""",
    "search_nested": _NESTED,
    "search_results": _word_search()
    + f"""SELECT query_id, rank, score, doc_id, CASE lang WHEN 'fr' THEN '' ELSE lang END AS subject, source || '; ' || lang AS sender,
  {_SENT} AS sent, n_chars AS size,
  '?file=' || source || '%2F' || doc_id || '.eml' AS link, {_size_text('n_chars')} AS size_text
  FROM ranked JOIN documents USING (doc_id) WHERE rank <= 25""",
    "fetch_by_key": """SELECT e.event_id AS doc_id, d.source, d.n_chars,
  CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'found' END AS status
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id""",
    "fetch_few": """SELECT item_id * 7 - 20 AS doc_id, d.source, d.n_chars,
  CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'found' END AS status
  FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 7 - 20""",
    "refresh_classify": f"""{_LISTINGS} SELECT new.path, CASE WHEN old.stamp IS NULL THEN 'new'
  WHEN old.stamp >= new.stamp THEN 'unchanged' ELSE 'changed' END AS state FROM new LEFT JOIN old USING (path)""",
    "refresh_upsert": f"""{_LISTINGS} SELECT path, CASE WHEN new.stamp IS NULL OR old.stamp >= new.stamp THEN old.stamp ELSE new.stamp END AS stamp
  FROM old FULL JOIN new USING (path)""",
    "refresh_stale": f"{_LISTINGS} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)",
    "refresh_terms": f"""SELECT 'body' AS field, term, count(*) AS df
  FROM (SELECT unnest(list_distinct({_W})) AS term FROM documents WHERE source <> 'src3') GROUP BY term
  UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> 'src3' GROUP BY source""",
    "refresh_compact_search": (_word_search() + _TOP).replace("FROM documents", "FROM (SELECT * FROM documents WHERE source <> 'src3')"),
    "newest_version": """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""",
    "incremental_batch": f"""{_EVENT_ROWS}, marks AS (SELECT folder, max(uid) AS last_uid FROM rows, mid WHERE us <= middle GROUP BY folder)
  SELECT folder, uid, size FROM rows CROSS JOIN mid LEFT JOIN marks USING (folder)
  WHERE last_uid IS NULL OR uid > last_uid OR NOT (us <= middle AND size <= 200)""",
    "load_mark": "SELECT event_type AS folder, max(event_id) AS last_uid FROM events GROUP BY event_type",
    "load_running": """SELECT event_type AS folder, event_id AS uid,
  round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id), 2) AS running FROM events""",
    "tombstones": """SELECT event_id, event_type, value FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.event_id = e.event_id)""",
    "load_stream": f"{_EVENT_ROWS} SELECT folder, uid, size FROM rows, mid WHERE NOT (folder = 'error' AND us <= middle)",
    "load_once": "SELECT event_type AS folder, event_id AS uid, value AS size FROM events",
    "load_report": f"""SELECT folder, messages, bytes, {_size_text('bytes')} AS size_text FROM (
  SELECT source AS folder, count(*) AS messages, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source)""",
    "above_mark": f"""{_EVENT_ROWS} SELECT folder, uid, size FROM rows WHERE folder = 'purchase'
  AND uid > (SELECT max(uid) FROM rows, mid WHERE folder = 'purchase' AND us <= middle)""",
    "folder_counts": """SELECT source AS folder, upper(source) AS name, count(*) FILTER (source <> 'src2') AS messages
  FROM documents WHERE source <> 'src1' GROUP BY source""",
    "format_sizes": f"SELECT doc_id, {_size_text('n_chars')} AS binary_size, {_size_text('n_chars', si=True)} AS si_size FROM documents",
    "page_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
    "message_ingest": """SELECT doc_id || '.eml' AS id, lang AS subject, source || '@example.org' AS sender,
  'text/plain; charset=utf-8' AS content_type, text AS body, NULL::VARCHAR AS error FROM documents""",
    "mail_files": f"""SELECT doc_id, CASE lang WHEN 'fr' THEN '' ELSE lang END AS subject, 'The ' || source || ' <' || source || '@example.org>' AS sender,
  {_SENT} AS sent, text AS body, (octet_length(encode(text)) + 2 * length(source)
    + length('From: The  <@example.org>') + CASE lang WHEN 'fr' THEN 0 ELSE length('Subject: ') + length(lang) + 1 END
    + length('Date: Mon, 01 Jan 2024 00:00:00 +0000') + length('Content-Type: text/plain; charset=utf-8') + 5)::BIGINT AS size FROM documents""",
    "html_body": f"""WITH t AS (SELECT page_id, url, {_html_text('html')} AS body FROM pages),
fields AS (
  SELECT page_id, 'Subject' AS field, 'page' AS value FROM t
  UNION ALL SELECT page_id, 'Content-Type', 'multipart/mixed; boundary="=_part"' FROM t
  UNION ALL SELECT page_id, 'body-0', url FROM t
  UNION ALL SELECT page_id, 'body-1', body FROM t
  UNION ALL SELECT page_id, 'body_all', url || '|' || body FROM t)
SELECT 'mail/' || page_id || '.eml' AS path, field, value FROM fields""",
    "header_lines": "SELECT conv_id || '/' || turn AS path, 0 AS idx, role || ': ' || text AS line FROM conversations",
}
