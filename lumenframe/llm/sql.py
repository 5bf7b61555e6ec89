"""SQL (DuckDB) for the llm queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, o, o + 9) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS o FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
place AS (
  SELECT doc_id, n, o, list_slice(w, o, o + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM doc, lens WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, o, n FROM place JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

OP4 = f"""
WITH doc AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, o, md5(array_to_string(list_slice(w, o, o + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS o FROM doc WHERE len(w) >= 50)
),
least AS (SELECT h, min(doc_id) AS least FROM place GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(o, o + 50)) AS p FROM place JOIN least USING (h) WHERE doc_id > least),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM doc),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

OP9 = rf"""
WITH base AS (
  SELECT doc_id, source, CAST(len({_PLAIN_WORDS}) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
    coalesce(greatest(CAST(0.1 AS DOUBLE), CAST(1.0 AS DOUBLE) - (greatest(length(text), 1) - length(translate(text, '*#$%&!|', ''))) / CAST(greatest(length(text), 1) AS DOUBLE) * 4.0), CAST(0.1 AS DOUBLE)) AS w
  FROM documents
),
keyed AS (SELECT *, -ln(CAST(u AS DOUBLE)) / w AS key FROM base),
src AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM base GROUP BY source
),
level AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS l
  FROM src WINDOW before AS (ORDER BY 3 * s / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
aim AS (
  SELECT source, s, least(3 * s, weight * (SELECT l FROM level WHERE 3 * s / weight >= l ORDER BY 3 * s / weight LIMIT 1)) AS target FROM level
),
run AS (
  SELECT doc_id, source, size, key, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
)
SELECT doc_id, r.source, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END * size + greatest(0, least(size, floor(target - CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END * s) - before)) AS BIGINT) AS taken
FROM run r JOIN aim a ON r.source IS NOT DISTINCT FROM a.source
"""

_ESCAPED = r"regexp_replace({}, '([<\[\\])', '\1\\', 'g')"
OP10 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
placed AS (
  SELECT *, row_number() OVER o AS p, coalesce(lag(role) OVER o, '') = role AND row_number() OVER o > 1 AS goes_on
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN goes_on THEN 11 ELSE 32 + length({_ESCAPED.format('role')}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
