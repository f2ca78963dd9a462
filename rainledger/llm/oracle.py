"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS txt FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(txt) AS text_sha256
FROM t WINDOW w AS (PARTITION BY txt)
"""

SQL["op2_url_filters"] = r"""
WITH p AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
    SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
           max_by(r.verdict, length(rhost || rpath)) AS verdict
    FROM p, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

SQL["op11_prefix_trie"] = r"""
WITH RECURSIVE o AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS s,
           list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (  -- bit by bit; a byte of the number's digits enters before every eighth step
    SELECT conv_id, s, 0 AS step, 4294967295::BIGINT AS v FROM o
    UNION ALL
    SELECT conv_id, s, step + 1, xor(x >> 1, (x & 1) * 3988292384)
    FROM (SELECT conv_id, s, step, CASE WHEN step % 8 = 0 THEN xor(v, ord(s[step // 8 + 1])::BIGINT) ELSE v END AS x
          FROM crc WHERE step < 8 * length(s))
), h AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE step = 8 * length(s)
), c AS (
    SELECT o.conv_id, list_concat(coalesce(b.own[1:h], []), o.own[h + 1:]) AS seq
    FROM o JOIN h ON h.conv_id = o.conv_id LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 20
), m AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM c
), nodes AS MATERIALIZED (
    SELECT depth, seq[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
           CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(seq[depth].t), '[^\x20\x09-\x0D]+')) END AS words,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256
    FROM m GROUP BY depth, seq[1:depth]
), kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
    SELECT nodes.*, coalesce(kids.n, 0) AS n_children
    FROM nodes LEFT JOIN kids ON kids.depth = nodes.depth AND kids.path = nodes.path
), up AS (SELECT *, unnest(range(0, depth + 1)) AS top FROM full_nodes
), sums AS (
    SELECT top AS depth, path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
    FROM up GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       n.ends_sha256
FROM full_nodes AS n JOIN sums AS s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""

SQL["op12_collocations"] = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), u AS MATERIALIZED (SELECT lang, unnest(ws) AS a1, unnest(ws[2:]) AS a2, unnest(ws[3:]) AS a3, unnest(ws[4:]) AS a4, unnest(ws[5:]) AS a5 FROM w
), g AS MATERIALIZED (
    SELECT lang, 1 AS k, a1 AS phrase, count(*) AS f FROM u GROUP BY ALL
    UNION ALL SELECT lang, 2, a1 || ' ' || a2, count(*) FROM u WHERE a2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 3, concat_ws(' ', a1, a2, a3), count(*) FROM u WHERE a3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 4, concat_ws(' ', a1, a2, a3, a4), count(*) FROM u WHERE a4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 5, concat_ws(' ', a1, a2, a3, a4, a5), count(*) FROM u WHERE a5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
), n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM g WHERE k >= 2 AND f >= 100
), inside AS (
    SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM c, range(2, 5) AS s(m), range(1, 5) AS t(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), cut AS MATERIALIZED (
    SELECT c.lang, c.phrase, a, j, array_to_string(words[1:j], ' ') AS x, array_to_string(words[j + 1:], ' ') AS y
    FROM c LEFT JOIN inside ON inside.lang = c.lang AND inside.phrase = c.phrase, range(1, 5) AS t(j)
    WHERE j < c.k AND (longer IS NULL OR 100 * longer < 100 * a)
), s AS (
    SELECT cut.lang, cut.phrase, a, n, gx.f AS l, gy.f AS r, j, (1000::HUGEINT * a * n) // (gx.f::HUGEINT * gy.f) AS score
    FROM cut JOIN n ON n.lang = cut.lang JOIN g AS gx ON gx.lang = cut.lang AND gx.phrase = cut.x
    JOIN g AS gy ON gy.lang = cut.lang AND gy.phrase = cut.y
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

SQL["op13_line_dedup"] = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
    SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, coalesce(k.doc_id <> f.keep, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
