"""DuckDB SQL for those queries of queries.py that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

LINE_DEDUP = """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM raw),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, h + 3 * coalesce(lag(h, 1) OVER w, 0) + 9 * coalesce(lag(h, 2) OVER w, 0) AS rolled FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum((rolled % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
chunks AS (SELECT doc_id, k, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k),
placed AS (SELECT *, row_number() OVER (PARTITION BY chunk, size > 1 ORDER BY doc_id, k) AS nth FROM chunks),
marked AS (SELECT *, size > 1 AND nth > 1 AS gone FROM placed)
SELECT doc_id, sum(size)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed_chunks, coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM r
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n, words FROM d),
h AS (SELECT doc_id, word, i, CASE WHEN i + 34 <= n THEN array_to_string(list_slice(words, i, i + 34), ' ') END AS win FROM w),
c AS (SELECT doc_id, word, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS twice FROM h),
m AS (SELECT doc_id, word, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS shingle FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

MIX = rf"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS key, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS size FROM d GROUP BY key),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * size AS room FROM s),
f AS (SELECT *, row_number() OVER r AS place, coalesce(sum(room) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room_before, coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weight_before,
  1.5::DOUBLE * sum(size) OVER ()::BIGINT AS wanted, sum(weight) OVER ()::BIGINT AS weighed FROM w WINDOW r AS (ORDER BY room::DOUBLE / weight::DOUBLE, key)),
e AS (SELECT min(place) AS place, arg_min(wanted - room_before, place) AS words, arg_min((weighed - weight_before)::DOUBLE, place) AS weights FROM f WHERE room::DOUBLE * (weighed - weight_before) >= weight * (wanted - room_before)),
t AS (SELECT f.key, f.size AS source_size, CASE WHEN e.place IS NULL OR f.place < e.place THEN room::DOUBLE ELSE weight * e.words / e.weights END AS target FROM f, e),
p AS (SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(floor(target)::BIGINT - start, size)) + greatest(0, least(floor(target)::BIGINT - source_size - start, size)))::BIGINT AS taken FROM p JOIN t USING (key)
"""

VECTORS = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS uid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT uid, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM v, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, uid AS entry, x FROM p WHERE uid < 256),
"""
ASSIGNED = "a{k} AS MATERIALIZED (SELECT uid, part, min(256 * (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x))::BIGINT + b.entry) AS best, any_value(p.x) AS x FROM p JOIN b{k} b USING (part) GROUP BY uid, part),"
MOVED = """
s{k} AS (SELECT part, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS y FROM a{k}, range(1, 65) r(i) WHERE i <= len(x) GROUP BY 1, 2, 3),
b{n} AS MATERIALIZED (SELECT part, entry, coalesce(y, x) AS x FROM b{k} LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS y FROM s{k} GROUP BY 1, 2) USING (part, entry)),
"""
VECTOR_CODES = VECTORS + "".join(ASSIGNED.format(k=k) + MOVED.format(k=k, n=k + 1) for k in range(4)) + ASSIGNED.format(k=4) + """
c AS (SELECT uid, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY uid),
h AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM b4, range(1, 65) r(i) WHERE i <= len(x))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM c JOIN v USING (uid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op4_exact_dedup": EXACT_DEDUP, "op6_topk_search": TOPK, "op8_substring_dedup": SUBSTRING_DEDUP, "op10_near_dedup": NEAR_DEDUP, "op11_source_mix": MIX, "op13_vector_codes": VECTOR_CODES}
