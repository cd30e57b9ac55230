"""DuckDB statements of those problem queries that SQL can express over whole tables."""

_P1_COUNTS = r"""
WITH occ AS (
  SELECT 'intent' AS kind, intent AS val, canon_id AS rec FROM canonical WHERE intent IS NOT NULL
  UNION ALL
  SELECT 'term', lower(unnest(regexp_extract_all(input, '[\p{L}\p{M}\p{N}]+'))), canon_id FROM canonical WHERE input IS NOT NULL
), counts AS (
  SELECT kind, val, count(*) AS occurrences, count(DISTINCT rec) AS records FROM occ GROUP BY kind, val
)
SELECT kind, val, occurrences, records,
       CASE WHEN occurrences <= 2 THEN 'rare'
            WHEN records > 0.01 * (SELECT count(*) FROM canonical) THEN 'common' END AS mark
FROM counts
"""

ORACLES: dict[str, str] = {
    "p1_counts": _P1_COUNTS,
    "p1_found": f"SELECT kind, val, mark FROM ({_P1_COUNTS}) WHERE mark IS NOT NULL",
}
