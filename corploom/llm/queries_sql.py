"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _coverage(size: int) -> str:
    return f"""
    SELECT doc_id, sum(length(ws[p]))::BIGINT AS chars, count(*)::BIGINT AS words FROM (
        SELECT DISTINCT doc_id, i + k AS p FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
            FROM (SELECT doc_id, i, ws[i:i + {size - 1}] AS gram
                  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM w WHERE len(ws) >= {size}))
        ), (SELECT unnest(range(0, {size})) AS k) WHERE n > 1
    ) JOIN w USING (doc_id) GROUP BY doc_id"""


QUALITY = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws, coalesce(text, '') AS t FROM documents),
lines AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
l AS (
    SELECT doc_id, count(*) AS n,
           sum(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))))::BIGINT AS chars
    FROM lines WHERE again GROUP BY doc_id
),
c3 AS ({_coverage(3)}), {", ".join(f"c{n} AS ({_coverage(n)})" for n in range(5, 11))},
m AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words,
           coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words,
           coalesce(l.chars, 0)::BIGINT AS dup_line_chars,
           [{", ".join(f"coalesce(c{n}.chars, 0)" for n in range(5, 11))}] AS dup_ngram_chars
    FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in range(5, 11))}
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"100 * dup_ngram_chars[{n - 4}] > {20 - n} * word_chars" for n in range(5, 11))}
           OR 100 * dup_line_chars > 20 * word_chars) AS kept,
       dup_line_chars, dup_ngram_chars
FROM b
"""


SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, (SELECT unnest(range(0, 13)) AS k)),
left_over AS (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) e
    LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""

MIXING = """
WITH RECURSIVE c AS (SELECT coalesce('s' || source, 'n') AS key, count(*) AS n FROM documents GROUP BY 1),
score AS (
    SELECT key, n, floor(sqrt(n::DOUBLE) * 1000)::BIGINT AS score, sum(floor(sqrt(n::DOUBLE) * 1000)::BIGINT) OVER ()::BIGINT AS total,
           greatest(1000, 2 * count(*) OVER ())::BIGINT AS ticks FROM c
),
w AS (SELECT key, n, greatest(1, (2 * ticks * score + total) // (2 * total))::BIGINT AS w FROM score),
t AS (SELECT sum(w)::BIGINT AS h FROM w),
s AS (SELECT list(w ORDER BY key) AS ws, list(key ORDER BY key) AS keys FROM w),
fold AS (
    SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM s
    UNION ALL
    SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + (i = pick2)::BIGINT), pick2
    FROM (
        SELECT slot, done, list_min(list_transform(list_filter(range(1, len(done) + 1), lambda i: done[i] * h < (slot + 1) * ws[i]),
               lambda i: {'due': ((done[i] + 1) * h + ws[i] - 1) // ws[i], 'i': i})).i AS pick2
        FROM fold, s, t WHERE slot < h
    )
),
plan AS (SELECT keys[pick] AS key, slot - 1 AS pos, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS r FROM fold, s WHERE pick IS NOT NULL),
lack AS (
    SELECT min((((n + 15) // 16) // w) * h + pos) AS least FROM w JOIN plan USING (key), t WHERE r = ((n + 15) // 16) % w
),
d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents)
SELECT doc_id, source, rank // 16 AS block, (rank % 16)::INT AS place, (rank // 16) * h // w AS release,
       (((rank // 16) + 1) * h + w - 1) // w AS deadline, ((rank // 16) // w) * h + pos AS slot, ((rank // 16) // w) * h + pos < least AS on_target
FROM d JOIN w USING (key) JOIN plan ON plan.key = d.key AND plan.r = (rank // 16) % w, t, lack
"""

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + len(regexp_extract_all(role, '[\\\n|]')) + 1
           + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

WARC = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
           row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id, url) = 1 AS stored
    FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN stored THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT stored THEN first END AS refers_to
FROM p
"""

NEAR = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END AS shingles FROM w
),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n, hash(list_sort(shingles)) AS h, list_sort(shingles) AS shingles FROM s),
r AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n, h, shingles FROM n WHERE n > 0 GROUP BY h, shingles),
e AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM r),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS least FROM r UNION SELECT arcs.b, reach.least FROM reach JOIN arcs ON arcs.a = reach.node WHERE reach.least < arcs.b),
label AS (SELECT node, min(least) AS least FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(label.least, n.doc_id) AS component_id, n.doc_id = coalesce(label.least, n.doc_id) AS kept
FROM n LEFT JOIN r ON n.h = r.h AND n.shingles = r.shingles LEFT JOIN label ON label.node = r.doc_id
"""
