"""SQL that says the same as queries of this subpackage, where SQL can."""

from __future__ import annotations

import math

from arbora.llm.quantiles import EPS, MIN

_RATIO = (1 + EPS) / (1 - EPS)
_AT = f"CAST(floor((ln(abs(v)) - ({math.log(MIN)!r})) / {math.log(_RATIO)!r}) + 1 AS BIGINT)"
_MEASURED = f"""SELECT *, CASE WHEN abs(v) < {MIN!r} THEN 0 WHEN v > 0 THEN {_AT} ELSE -{_AT} END AS b FROM (
  SELECT host_id, field, CAST(recorded_at AS DATE) AS day, v
  FROM (SELECT DISTINCT id, host_id, eval_time, overhead_time, recorded_at FROM methods) m,
  LATERAL (SELECT 'eval_time' AS field, m.eval_time AS v UNION ALL SELECT 'overhead_time', m.overhead_time) x
  WHERE recorded_at IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v))"""

SQL = {
    "p1_percentiles": f"""WITH m AS ({_MEASURED}),
      d AS (SELECT min(day) AS a FROM m),
      s AS (SELECT host_id, field, b, 'day' AS span, day AS since FROM m
        UNION ALL SELECT host_id, field, b, 'week', CAST(date_trunc('week', day) AS DATE) FROM m
        UNION ALL SELECT host_id, field, b, 'all', a FROM m, d),
      r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY host_id, field, span, since) AS n FROM s
        WINDOW w AS (PARTITION BY host_id, field, span, since ORDER BY b)),
      q AS (SELECT unnest([0.05, 0.5, 0.9, 0.99]::DOUBLE[]) AS q)
      SELECT host_id, field, span, CAST(since AS VARCHAR) AS since, q, n,
        CAST(CAST(CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * {MIN!r}::DOUBLE * pow({_RATIO!r}::DOUBLE, abs(b)) * {2 / (_RATIO + 1)!r}::DOUBLE END AS REAL) AS DOUBLE) AS value
      FROM r, q WHERE k = greatest(1, CAST(ceil(round(q * n, 9)) AS BIGINT))""",
    # Counts and ranks only: that each value is within its error is what the query finds out.
    "p1_within": """SELECT host_id, field, q, count(*) AS n, TRUE AS within FROM (SELECT DISTINCT id, host_id, eval_time, overhead_time, recorded_at FROM methods) m,
      LATERAL (SELECT 'eval_time' AS field, m.eval_time AS v UNION ALL SELECT 'overhead_time', m.overhead_time) x, (SELECT unnest([0.05, 0.5, 0.9, 0.99]::DOUBLE[]) AS q)
      WHERE recorded_at IS NOT NULL AND isfinite(v) GROUP BY host_id, field, q""",
    "p1_day_partials": f"""SELECT host_id, field, CAST(day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT b) AS n_buckets, min(b) AS first_bucket, max(b) AS last_bucket
      FROM ({_MEASURED}) GROUP BY host_id, field, day""",
}

_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, lower(trim(hash, ' \t\n\r' || chr(160))) AS h, list_sort(regexp_extract_all(lower({c}), '[a-z0-9_.]+')) AS t FROM {t} WHERE hash IS NOT NULL AND {c} IS NOT NULL" for t, c in (("individuals", "tree"), ("nnlearnerstatistics", "current_tree")))
SQL["p3_found"] = f"""WITH d AS (SELECT *, row_number() OVER () AS i, len(t) AS n FROM (SELECT DISTINCT tbl, h, t FROM ({_ROWS}) WHERE len(t) > 0)),
  c AS (SELECT tbl, h, i, n, w, count(*) AS k FROM (SELECT tbl, h, i, n, unnest(t) AS w FROM d) GROUP BY ALL),
  p AS (SELECT a.tbl, a.h AS x, b.h AS y, a.i, b.i AS j, a.n + b.n AS n, sum(least(a.k, b.k)) AS s FROM c a JOIN c b ON a.tbl = b.tbl AND a.w = b.w AND a.h < b.h WHERE a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY ALL)
  SELECT DISTINCT tbl, x AS hash_a, y AS hash_b FROM p WHERE s * 10 >= (n - s) * 7"""

SQL["p3_classes"] = f"""WITH m AS (SELECT DISTINCT tbl, h, t FROM ({_ROWS}) WHERE len(t) > 0),
  d AS (SELECT tbl, t, len(t) AS n, min(h) AS least, count(*) AS copies, row_number() OVER () AS i FROM m GROUP BY tbl, t),
  c AS (SELECT tbl, i, n, w, count(*) AS k FROM (SELECT tbl, i, n, unnest(t) AS w FROM d) GROUP BY ALL),
  p AS (SELECT a.i, b.i AS j, a.n + b.n AS n, sum(least(a.k, b.k)) AS s FROM c a JOIN c b ON a.tbl = b.tbl AND a.w = b.w AND a.i <> b.i WHERE a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY ALL),
  l AS (SELECT i, count(*) AS links FROM p WHERE s * 10 >= (n - s) * 7 GROUP BY i)
  SELECT m.tbl, m.h AS hash, d.least AS class_hash, d.copies AS n_copies, CAST(coalesce(l.links, 0) AS BIGINT) AS n_links
  FROM m JOIN d ON d.tbl = m.tbl AND d.t = m.t LEFT JOIN l ON l.i = d.i"""


def _grams(name: str, key: str) -> str:
    return rf"""SELECT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {name} WHERE text IS NOT NULL))"""


SQL["p7_found"] = f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) d JOIN ({_grams('eval_items', 'item_id')}) e ON d.g = e.g"
SQL["p7_items"] = f"SELECT i.item_id, i.suite, count(*) AS n_docs FROM (SELECT DISTINCT item_id, suite FROM eval_items) i JOIN ({SQL['p7_found']}) f ON f.item_id = i.item_id GROUP BY i.item_id, i.suite"
