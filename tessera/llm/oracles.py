"""The same rows in DuckDB SQL, for the operators that SQL expresses at the size of the correctness tables."""

#: Lower-case A-Z alone; lower() would change other letters too.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of the license and decontamination contracts.
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Smallest id reachable by links (pairs in ``link``, both ways), for every id of ``node``.
_COMPONENT = """reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP1 = f"""WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
node AS (SELECT DISTINCT vec_id AS id FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
{_COMPONENT}
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = e.vec_id"""

OP4 = f"""WITH iw AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format('text')} AS w FROM benchmark),
item_windows AS (SELECT item, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS g
  FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents),
starts AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM dw, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m),
found AS (SELECT doc_id, s, d.m, item FROM (SELECT doc_id, s, m, array_to_string(w[s:s + m - 1], ' ') AS g FROM starts) d JOIN item_windows i ON i.m = d.m AND i.g = d.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda s: array_to_string(w[s:s + 2], ' ')) END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
node AS (SELECT DISTINCT doc_id AS id FROM documents),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared s JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * s.n >= 90 * (p.n + q.n - s.n)),
{_COMPONENT}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN component c ON c.id = d.doc_id LEFT JOIN size USING (doc_id)"""

ORACLE_SQL = {"op1_embedding_range_join": OP1, "op4_benchmark_decontamination": OP4, "op10_ngram_jaccard_join": OP10}
