"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""



CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS guarded, lag(role) OVER o AS before, row_number() OVER o AS n,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
    FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + length(role) + 2 + length(guarded) + 9) AS BIGINT) AS formatted_chars,
    bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
        AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM g GROUP BY conv_id
"""

MIXING = rf"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
    SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), l AS (
    SELECT *, 3.0 * source_size / weight AS ratio, coalesce(sum(3.0 * source_size) OVER w, 0) AS limited, coalesce(sum(weight) OVER w, 0) AS lighter, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS place, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
    FROM s WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
    SELECT source, source_size, CAST(least(3.0 * source_size, weight * (SELECT arg_min((total - limited) / (weights - lighter), place) FROM l WHERE (total - limited) / (weights - lighter) <= ratio)) AS DOUBLE) AS target FROM l
), p AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM v
), x AS (
    SELECT d.*, p.source_size, target, passes, target - passes * p.source_size AS rest, CAST('0x' || substr(h, 1, 3) AS BIGINT) AS b0, CAST('0x' || substr(h, 4, 3) AS BIGINT) AS b1, CAST('0x' || substr(h, 7, 4) AS BIGINT) AS b2
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), y AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY b0 RANGE UNBOUNDED PRECEDING) AS u0, sum(size) OVER (PARTITION BY source ORDER BY b0, b1 RANGE UNBOUNDED PRECEDING) AS u1,
        sum(size) OVER (PARTITION BY source ORDER BY b0, b1, b2 RANGE UNBOUNDED PRECEDING) AS u2, sum(size) OVER (PARTITION BY source, b0, b1, b2) AS cell FROM x
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, CAST(size * (passes + CASE WHEN u0 <= rest OR u1 <= rest OR u2 - cell / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM y
"""

def _quality() -> str:
    from .quality import STOP_WORDS

    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM documents
), g AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS again FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE again > 1) GROUP BY doc_id
), m AS (
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop,
        len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z][A-Z][^a-z]*$'))) AS n_upper
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.5 AND n_stop / n_words >= 0.02
        AND n_upper / n_words <= 0.6 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.6) AS kept
FROM m
"""


LINES = r"""
WITH l AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), k AS (SELECT *, trim(line, E' \t\r') AS key FROM l
), b AS (SELECT key, min({'doc_id': doc_id, 'pos': pos}) AS first FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(source, 'null')) >= 3
), m AS (SELECT k.*, b.key IS NOT NULL AND {'doc_id': k.doc_id, 'pos': k.pos} <> b.first AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id
"""


REPEATS = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), v AS (
    SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), g AS (
    SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM v JOIN (SELECT s FROM v GROUP BY s HAVING count(*) > 1) USING (s)
), x AS (
    SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d
), k AS (
    SELECT x.r, count(*) FILTER (g.j IS NOT NULL) AS n, string_agg(x, ' ' ORDER BY x.j) FILTER (g.j IS NULL) AS kept FROM x LEFT JOIN g ON x.r = g.r AND x.j = g.j GROUP BY x.r
)
SELECT doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT, "op6_source_mixing": MIXING, "op7_quality_rules": _quality(), "op9_ngram_jaccard_join": NGRAM_JOIN, "op10_line_dedup": LINES, "op13_substring_dedup": REPEATS}
