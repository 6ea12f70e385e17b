"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_RULES = """
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/'))"""

_LEVEL = """
{name}_g AS (
  SELECT {keys}, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY {keys}),
{name}_m AS (SELECT g.*, p.mean FROM {name}_g g {parent}),
{name}_s AS (
  SELECT CASE WHEN sum((n - 1) * mean * (1 - mean)) FILTER (n > 0) > 0
    THEN (sum(n * (k / n - mean) * (k / n - mean)) FILTER (n > 0) - sum(mean * (1 - mean)) FILTER (n > 0))
      / (sum((n - 1) * mean * (1 - mean)) FILTER (n > 0)) ELSE 0.0 END AS raw FROM {name}_m),
{name}_r AS (SELECT greatest(0.001, least(0.999, raw)) AS rho FROM {name}_s),
{name}_p AS (
  SELECT {keys}, k + (1 - rho) / rho * mean AS a, n - k + (1 - rho) / rho * (1 - mean) AS b,
    (k + (1 - rho) / rho * mean) / (n + (1 - rho) / rho) AS mean
  FROM {name}_m, {name}_r)"""

OP8 = (
    "WITH"
    + _RULES
    + r""",
parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
shown AS (
  SELECT page_id, d.doc_id
  FROM (
    SELECT page_id, TRY_CAST(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/([0-9]+)(\.[A-Za-z0-9]+)?/?$', 1) AS BIGINT) AS named,
      regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(html, '^.*?<article[^>]*>([\x09-\x0d\x20]*<h1.*?</h1>)?', '', 's'), '<!--.*?-->|<[^>]*>', '', 'gs'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '[\x09-\x0d\x20]+', '', 'g') AS body
    FROM pages) p
  JOIN (SELECT DISTINCT doc_id, left(regexp_replace(text, '[\x09-\x0d\x20]+', '', 'g'), 200) AS start FROM documents) d ON d.doc_id = p.named
  WHERE start <> '' AND starts_with(left(body, 200), start)),
outcomes AS (
  SELECT page_id, (quality = 0 OR toxic = 1) AS bad FROM (SELECT DISTINCT page_id, doc_id FROM shown) s JOIN labels USING (doc_id)),
counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0) AS k
  FROM parsed LEFT JOIN (SELECT * FROM outcomes WHERE bad IS NOT NULL) USING (page_id) GROUP BY host),
hosts AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix
  FROM counted),
top AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0.0 END AS mean FROM hosts),"""
    + _LEVEL.format(name="s", keys="suffix", parent=", top p")
    + ","
    + _LEVEL.format(name="d", keys="suffix, domain", parent="JOIN s_p p USING (suffix)")
    + ","
    + _LEVEL.format(name="h", keys="suffix, domain, host", parent="JOIN d_p p USING (suffix, domain)")
    + """,
fits AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict, length(rule_host) AS n
  FROM parsed, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (
  SELECT host, path, rule, verdict FROM fits
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, n DESC, verdict DESC) = 1)
SELECT page_id, parsed.host AS host, parsed.path AS path, rule,
  coalesce(best.verdict, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN best USING (host, path) LEFT JOIN h_p USING (host)"""
)

OP10 = """
WITH own AS (
  SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT conv_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY conv_id),
turns AS (
  SELECT pair_id, side AS chosen, turn, role, text FROM (
    SELECT o.conv_id AS pair_id, o.turn, o.role, o.text,
      unnest(CASE WHEN o.turn = l.last AND o.role = 'assistant' THEN [true] ELSE [true, false] END) AS side
    FROM own o JOIN lasts l USING (conv_id)
    WHERE o.turn <= l.last AND EXISTS (SELECT 1 FROM lasts n WHERE n.conv_id = o.conv_id + 1)) x
  UNION
  SELECT a.conv_id - 1, false, here.last, a.role, a.text
  FROM own a JOIN lasts l ON l.conv_id = a.conv_id AND l.last = a.turn JOIN lasts here ON here.conv_id = a.conv_id - 1
  WHERE a.role = 'assistant'),
merged AS (
  SELECT pair_id, turn, role, text, bool_or(chosen) AS in_chosen, bool_or(NOT chosen) AS in_rejected
  FROM turns GROUP BY ALL),
pairs AS (
  SELECT pair_id, coalesce(min(turn) FILTER (NOT (in_chosen AND in_rejected)), NULL) AS first_other
  FROM merged GROUP BY pair_id HAVING bool_or(in_chosen) AND bool_or(in_rejected)),
placed AS (
  SELECT merged.*, first_other IS NULL OR turn < first_other AS in_prompt FROM merged JOIN pairs USING (pair_id)),
parts AS (
  SELECT *, 'prompt' AS part FROM placed WHERE in_prompt
  UNION ALL SELECT *, 'chosen' FROM placed WHERE NOT in_prompt AND in_chosen
  UNION ALL SELECT *, 'rejected' FROM placed WHERE NOT in_prompt AND in_rejected)
SELECT pair_id, part, nullif(turn, 9223372036854775807) AS turn, role,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rendered,
  NOT in_prompt AND coalesce(role = 'assistant', false) AS loss
FROM parts"""

_ASSIGN = """
far{r} AS (
  SELECT vec_id, v, cluster, n2 - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d
  FROM vectors CROSS JOIN centroids{r}),
near{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS place FROM far{r}) WHERE place = 1)"""

_MOVE = """
parts{r} AS (
  SELECT cluster, i, sum(v[i]::BIGINT) AS s, count(*) AS n
  FROM near{p} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
means{r} AS (
  SELECT cluster, list(((s - (((s % n) + n) % n)) // n)::DOUBLE ORDER BY i) AS c FROM parts{r} GROUP BY cluster),
centroids{r} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroids{p} o LEFT JOIN means{r} m ON m.cluster = o.cluster)"""

OP12 = (
    """WITH vectors AS MATERIALIZED (
  SELECT vec_id, v, list_dot_product(v, v) AS n2 FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h LIMIT 16)),"""
    + ",".join(_ASSIGN.format(r=r - 1) + "," + _MOVE.format(r=r, p=r - 1) for r in (1, 2, 3))
    + ","
    + _ASSIGN.format(r=3)
    + """
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c::BIGINT[], ',')) AS centroid_sha256
FROM near3 JOIN centroids3 USING (cluster)"""
)

ORACLE = {"op8_url_reputation": OP8, "op10_preference_format": OP10, "op12_bitplane_clusters": OP12}
