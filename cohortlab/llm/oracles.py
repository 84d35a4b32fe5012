"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# space, tab, line feed, vertical tab, form feed, carriage return
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.top IS NOT NULL AND k.doc_id IS NOT NULL AND k.doc_id < h.top AS gone FROM k LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

# words: not space, tab, line feed, vertical tab, form feed, carriage return
OP2 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                            regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS ra, b.r AS rb, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT ra, rb FROM p JOIN n x ON x.r = ra JOIN n y ON y.r = rb WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT ra AS a, rb AS b FROM l UNION ALL SELECT rb, ra FROM l),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.t)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d o ON o.r = reach.t LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ALNUM}) AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM i),
o AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
h AS (SELECT o.r, o.p, g.k, g.item_id FROM o JOIN g ON g.k = o.k AND g.t = array_to_string(o.w[o.p:o.p + o.k - 1], ' ')),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
      FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

# filters A to E as bits 1 to 16; every order and step by joins over all states
OP11 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN lab USING (doc_id) GROUP BY part, mask),
f AS (SELECT chr(65 + i) AS filter, CAST(pow(2, i) AS INT) AS bit FROM (SELECT unnest(range(5))::INT AS i)),
o AS (SELECT '' AS filter_order, 0 AS seen UNION ALL
      SELECT filter_order || filter, seen + bit FROM o, f WHERE (seen & bit) = 0),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS filter,
             list_sum(list_transform(range(1, k), lambda j: CAST(pow(2, ascii(substr(filter_order, j, 1)) - 65) AS INT))) AS before
      FROM o, (SELECT unnest(range(1, 6))::INT AS k) WHERE seen = 31),
r AS (SELECT part, filter_order, step, filter,
             coalesce(sum(n) FILTER ((mask & (coalesce(before, 0) | bit)) = 0), 0) AS kept,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS removed,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & coalesce(before, 0)) = 0), 0) AS toxic_lost
      FROM s JOIN f USING (filter), h GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""

SQL = {"op11_filter_audit": OP11, "op2_ngram_jaccard": OP2, "op7_decontaminate": OP7, "op8_line_dedup": OP8}
