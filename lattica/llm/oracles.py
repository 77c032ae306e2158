"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP5 = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight_rank
  FROM sizes GROUP BY source
), weighted AS (
  SELECT *, CASE weight_rank WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS lim FROM per
), levels AS (
  SELECT *, row_number() OVER w AS n,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted WINDOW w AS (ORDER BY CAST(lim AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST)
), fills AS (SELECT arg_min(level, n) AS fill FROM levels WHERE level * weight < lim),
targets AS (
  SELECT source, source_size, weight_rank,
    CASE WHEN fill IS NULL OR lim <= fill * weight THEN CAST(lim AS DOUBLE) ELSE fill * weight END AS target
  FROM levels, fills
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM sizes
)
, knots(weight_rank, t0, h0, t1, h1) AS (
  VALUES (0, 0.0::DOUBLE, 1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE),
         (1, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE), (1, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE),
         (2, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)
), demand AS (  -- the integral of each schedule: what has arisen before and after each of its segments
  SELECT *, (h1 - h0) / (t1 - t0) AS slope, sum((t1 - t0) * (h0 + h1) / 2) OVER w AS upto,
    sum((t1 - t0) * (h0 + h1) / 2) OVER w - (t1 - t0) * (h0 + h1) / 2 AS done
  FROM knots WINDOW w AS (PARTITION BY weight_rank ORDER BY t0)
), takes AS (
  SELECT s.doc_id, s.size, s.begins, t.source_size, t.target, t.weight_rank, epoch, s.k,
    greatest(CAST(floor(t.target + 0.5) AS BIGINT), 1) AS want, s.begins + epoch * t.source_size AS start,
    greatest(0, least(s.size, CAST(floor(t.target + 0.5) AS BIGINT) - s.begins - epoch * t.source_size)) AS words
  FROM (SELECT *, row_number() OVER () AS k FROM streams) s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, range(2) e(epoch)
), placed AS (  -- demand inverted where it reaches the middle of the words
  SELECT takes.*, t0 + CASE WHEN slope = 0 THEN (share - done) / h0
      ELSE (sqrt(greatest(h0 * h0 + 2 * slope * (share - done), 0)) - h0) / slope END AS position
  FROM (SELECT *, (CAST(start AS DOUBLE) + CAST(words AS DOUBLE) / 2) / CAST(want AS DOUBLE) AS share FROM takes) takes
  LEFT JOIN demand ON words > 0 AND demand.weight_rank = takes.weight_rank AND share > done AND share <= upto
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(words) AS BIGINT) AS taken, CAST(count(*) FILTER (words > 0) AS INTEGER) AS epochs, min(position) AS position, max(position) AS last_position
FROM placed GROUP BY k
"""

_OP10 = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), keyed AS (SELECT *, row_number() OVER () AS k FROM parts),
best AS (
  SELECT k, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM keyed JOIN rules ON (host = r_host OR suffix(host, '.' || r_host)) AND prefix(path, r_path) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM keyed LEFT JOIN best USING (k)
"""

ORACLES: dict[str, str] = {
    "op5_curriculum_mix": _OP5,
    "op10_url_rules": _OP10,
}
