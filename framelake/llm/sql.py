"""DuckDB SQL for the registered queries that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {AZ}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
best AS (
  SELECT t.host, t.path, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule,
         arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) t JOIN r
    ON (t.host = r_host OR ends_with(t.host, '.' || r_host)) AND starts_with(t.path, r_path)
  GROUP BY t.host, t.path)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""

_CUT7 = rf"regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""
WITH i AS (SELECT item_id, {_CUT7} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_CUT7} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words_hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common.c >= 85 * (p.c + q.c - common.c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN first USING (s) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, count(gone.q) AS n_removed, string_agg(word, ' ' ORDER BY words.q) FILTER (gone.q IS NULL) AS t
         FROM words LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = rf"""
WITH raw AS (
  SELECT page_id, page_id * 10 + k AS record_id, page_id * 10 + k AS ts, k = 0 AS is_full,
         CASE WHEN k = 3 THEN url || '#again' ELSE url END AS url,
         CASE k WHEN 0 THEN substr(md5(html), 1, 16) WHEN 3 THEN CASE WHEN page_id % 4 = 0 THEN 'stale' ELSE substr(md5(html), 1, 16) END END AS tag,
         CASE WHEN k <> 3 THEN 'day ' || (page_id % 7) END AS modified, CASE WHEN k = 0 THEN strlen(html) ELSE 0 END AS size,
         CASE k WHEN 0 THEN 'max-age=60' WHEN 3 THEN 'max-age=90' END AS cache
  FROM pages, (VALUES (0), (3), (6)) AS v(k)),
parts AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {AZ}), ':[0-9]*$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') AS query
  FROM raw),
r AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM parts),
f AS (SELECT canonical, ts, record_id, tag, modified, size, cache FROM r WHERE is_full),
j AS (SELECT r.*, f.record_id AS f_id, f.tag AS f_tag, f.modified AS f_modified, f.size AS f_size, f.cache AS f_cache
      FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.ts > f.ts),
s AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN f_id IS NULL THEN 'orphan'
                     WHEN CASE WHEN tag IS NOT NULL THEN tag = f_tag ELSE coalesce(modified = f_modified, false) END THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, page_id, canonical, ts, status, CASE WHEN status = 'resolved' THEN f_id END AS refers_to,
       CASE WHEN status = 'full' THEN 'W/' || tag WHEN status = 'resolved' AND tag IS NULL THEN 'W/' || f_tag ELSE tag END AS etag,
       CASE WHEN status = 'resolved' THEN f_modified ELSE modified END AS last_modified,
       CAST(CASE WHEN status = 'resolved' THEN f_size ELSE size END AS VARCHAR) AS content_length,
       CASE WHEN status = 'resolved' THEN coalesce(cache, f_cache) ELSE cache END AS cache_control, CAST(ts AS VARCHAR) AS date
FROM s
"""

_WHOLE = "list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT))"
_APART = "list_sum(list_transform(range(1, 65), lambda j: (a.v[j] - b.v[j]) * (a.v[j] - b.v[j])))"


def _lloyd(rounds: int) -> str:
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, {_WHOLE} AS v FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT a.i, a.vec_id, a.v, b.c, {_APART} AS d FROM kept a, c{r} b
                 QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY d, b.c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
                     SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v
                     FROM (SELECT c, j, sum(v[j]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r}, range(1, 65) t(j) GROUP BY c, j) GROUP BY c) m USING (c))"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} z USING (c)
"""


OP13 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
f AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 6) t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, l.f AS l, r.f AS r, n, CAST(1000 AS HUGEINT) * c.f * n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN total ON total.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = best.lang AND g.m > len(string_split(best.phrase, ' '))
                                               AND g.f = best.a AND contains(' ' || g.phrase || ' ', ' ' || best.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLE = {
    "op1_url_filter": OP1, "op2_revisits": OP2, "op7_decontaminate": OP7, "op8_substring_dedup": OP8, "op10_near_dup": OP10,
    "op11_sharded_lloyd": _lloyd(3), "op13_phrases": OP13,
}
