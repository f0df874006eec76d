"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

OP1 = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts
"""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), gone AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(keep)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN keep IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM (SELECT lines.doc_id, i, line, gone.keep FROM lines LEFT JOIN gone ON lines.key = gone.key AND lines.doc_id <> gone.keep)
GROUP BY doc_id
"""

OP5 = r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), items AS (
  SELECT id, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.id AS u, b.id AS v FROM items a JOIN items b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), two_way AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT id, id AS to_id FROM classes UNION SELECT r.id, b.v FROM reach r JOIN two_way b ON r.to_id = b.u
), component AS (
  SELECT id, min(to_id) AS c FROM reach GROUP BY id
)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, sets.doc_id) AS component_id, coalesce(c, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN component USING (id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1,
    "op2_line_dedup": OP2,
    "op3_near_dedup": OP3,
    "op5_topk": OP5,
}
