"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING min(doc_id) < max(doc_id)
), judged AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id > f.first_doc AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op4_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), b AS (
    SELECT item_id, w, least(len(w), 13) AS width FROM (
        SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
        FROM benchmark)
    WHERE len(w) > 0
), bw AS (
    SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM b)
), widths AS (SELECT DISTINCT width FROM bw),
dw AS (
    SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
    FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)
), hits AS (SELECT doc_id, item_id, i, bw.width AS width FROM dw JOIN bw USING (width, win)),
places AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
    sha256(coalesce(i.list, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

SQL["op5_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM turns
), m AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) IS NOT DISTINCT FROM role AS same,
        length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS chars,
        length(role) + length(role)
            - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), chr(10), '')) AS head
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars + 7 + CASE WHEN same THEN 0 ELSE head + 6 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

SQL["op9_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
    SELECT doc_id, j, substr(h, 512 * j + 1, 610) AS b
    FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 - 50) // 256 + 1)) AS j FROM d WHERE length(h) >= 100)
), s AS (
    SELECT doc_id, 256 * j + i AS p, substr(b, 2 * i + 1, 100) AS bytes
    FROM (SELECT doc_id, j, b, unnest(range(0, least(256, length(b) // 2 - 49))) AS i FROM blocks)
), firsts AS (SELECT bytes, min(doc_id) AS first_doc FROM s GROUP BY bytes HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT s.doc_id, s.p FROM s JOIN firsts USING (bytes) WHERE s.doc_id > first_doc),
marked AS (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hits
), numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS after FROM spans),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY run) AS head
    FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""

SQL["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
    GROUP BY ALL
), c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
longer AS (
    SELECT lang, phrase, max(a) AS longest FROM (
        SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE size = 3) GROUP BY ALL
), cuts AS (
    SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT c.*, unnest(range(1, size)) AS k FROM c LEFT JOIN longer USING (lang, phrase)
        WHERE size = 3 OR longest IS NULL OR 100 * longest < 50 * a)
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, t.f AS r,
        CAST((a::HUGEINT * a::HUGEINT * 1000000) // (h.f::HUGEINT * t.f::HUGEINT) AS BIGINT) AS score
    FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE i = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1) USING (lang) WHERE rank <= 2000
"""
