"""DuckDB SQL of the queries that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, source, i, list_extract(string_split(text, chr(10)), i) AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)
  WHERE text IS NOT NULL
),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, trim(l.line, ' ') AS line
  FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line, ' ') <> ''
  GROUP BY l.source, trim(l.line, ' '), t.total
  HAVING count(DISTINCT l.doc_id) >= 5 AND count(DISTINCT l.doc_id) > t.total * 0.02
),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL) AS text,
         count(b.line) AS lines_dropped
  FROM lines l LEFT JOIN bad b
    ON b.source IS NOT DISTINCT FROM l.source AND b.line = trim(l.line, ' ')
  GROUP BY l.doc_id
)
SELECT d.doc_id, d.source,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.lines_dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

URL_FILTERS = r"""
WITH captures AS (
  SELECT page_id, url,
         CAST(TIMESTAMP '2024-01-01' + to_seconds(page_id * 104729 % 2592000) AS DATE) AS d
  FROM pages
),
entries AS (
  SELECT 'list_' || e.event_type AS list_name,
         lower(CASE WHEN e.event_id % 2 = 0 AND regexp_extract(p.url, '^https?://([^/?#]+/[^/?#]+)', 1) <> ''
              THEN regexp_extract(p.url, '^https?://([^/?#]+/[^/?#]+)', 1)
              ELSE regexp_extract(p.url, '^https?://([^/?#]+)', 1) END) AS pattern,
         CAST(e.ts AS DATE) AS d, (e.value > 50.0) AS adds
  FROM events e JOIN pages p ON p.page_id = e.user_id
),
days AS (
  SELECT list_name, pattern, d, bool_and(coalesce(adds, false)) AS adds
  FROM entries WHERE list_name IS NOT NULL AND pattern IS NOT NULL AND d IS NOT NULL
  GROUP BY ALL
),
spans AS (
  SELECT list_name, pattern, d AS valid_from,
         coalesce(lead(d) OVER (PARTITION BY list_name, pattern ORDER BY d), DATE '9999-12-31') AS valid_to, adds
  FROM days
),
hosts AS (
  SELECT *, regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
         list_filter(string_split(regexp_extract(lower(url), '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM captures WHERE url IS NOT NULL AND d IS NOT NULL
),
probes AS (
  SELECT page_id, d, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1),
                   lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(range(1, len(parts) + 1),
                   lambda i: host || '/' || array_to_string(list_slice(parts, 1, i), '/'))))) AS p
  FROM hosts WHERE host <> ''
),
hits AS (
  SELECT q.page_id, string_agg(DISTINCT s.list_name, ',' ORDER BY s.list_name) AS lists,
         string_agg(DISTINCT s.pattern, ',' ORDER BY s.pattern) AS patterns
  FROM probes q JOIN spans s ON s.pattern = q.p AND s.adds AND q.d >= s.valid_from AND q.d < s.valid_to
  GROUP BY q.page_id
)
SELECT c.page_id, c.url, c.d AS fetch_date, h.page_id IS NOT NULL AS blocked,
       coalesce(h.lists, '') AS lists, coalesce(h.patterns, '') AS patterns
FROM captures c LEFT JOIN hits h USING (page_id)
"""

TOPK = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codes by plain comparison with every entry: one pair of CTEs (assign, replace) per round."""
    def assign(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d
  FROM (SELECT p.r, p.part, e.entry,
               CAST(coalesce(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i]))), 0) AS BIGINT) AS d
        FROM pieces p JOIN b{k} e ON p.part = e.part)
  GROUP BY r, part
)"""

    def replace(k: int) -> str:
        return f"""
b{k} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(m.x, o.x) AS x
  FROM b{k - 1} o LEFT JOIN (
    SELECT part, entry, list(s ORDER BY i) AS x FROM (
      SELECT a.part, a.entry, i, CAST(floor(sum(p.x[i]) / count(*)) AS BIGINT) AS s
      FROM a{k - 1} a JOIN pieces p ON a.r = p.r AND a.part = p.part, unnest(range(1, len(p.x) + 1)) AS t(i)
      GROUP BY a.part, a.entry, i)
    GROUP BY part, entry) m ON m.part = o.part AND m.entry = o.entry
)"""

    steps = ",".join(assign(k) + "," + replace(k + 1) for k in range(rounds)) + "," + assign(rounds)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pieces AS MATERIALIZED (
  SELECT r, part, v[len(v) * part // {parts} + 1:len(v) * (part + 1) // {parts}] AS x
  FROM kept, unnest(range({parts})) AS t(part)
),
b0 AS (SELECT part, r - 1 AS entry, x FROM pieces WHERE r <= {entries}),{steps},
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
),
coded AS (
  SELECT k.vec_id, k.label, c.code, c.error
  FROM kept k JOIN (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
                    FROM a{rounds} GROUP BY r) c USING (r)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


DECONTAMINATION = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i:i + least(len(w), 10) - 1] AS words
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
  WHERE len(w) > 0
),
starts AS (
  SELECT r, s.size, i, w[i:i + s.size - 1] AS words
  FROM doc_words, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - s.size + 2)) AS t(i)
),
matches AS (SELECT r, starts.size, i, item_id FROM starts JOIN windows USING (size, words)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM matches) GROUP BY r
),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM matches) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN found USING (r)
"""


ORACLES: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP,
    "op4_url_filters": URL_FILTERS,
    "op9_topk": TOPK,
    "op12_decontamination": DECONTAMINATION,
    "op13_vector_codes": vector_codes_sql(),
}
