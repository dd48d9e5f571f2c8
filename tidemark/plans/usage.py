"""Use of catalogued tables in the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import usage as u
from tidemark.plans.fixtures import CATALOG, QUERY_LOG, catalog, query_log
from tidemark.plans.registry import query

AS_OF = "2024-04-10 00:00:00"

NAMES = f"""SELECT DISTINCT query_id, ts, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS name FROM ({QUERY_LOG})"""
USAGE = f"""
SELECT table_id, table_name, size_gb, created, modified, count(query_id) AS query_count FROM ({CATALOG})
LEFT JOIN (SELECT * FROM ({NAMES}) WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) ON name = table_name GROUP BY ALL
"""


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def names(t):
    return u.named_tables(query_log(t), "text", ["query_id", "ts"])


def usage(t):
    return u.table_usage(catalog(t), names(t), "ts", as_of())


@query("text_contains_join", f"SELECT table_name, query_count FROM ({USAGE})")
def text_contains_join(t):
    return usage(t).select("table_name", "query_count")


@query("table_usage_90d", f"SELECT table_name, size_gb, created FROM ({USAGE}) WHERE query_count = 0")
def table_usage_90d(t):
    return usage(t).filter("query_count = 0").select("table_name", "size_gb", "created")


@query("referenced_table_join", f"""
WITH n AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), 't[0-9]+_[a-z0-9_]*')) AS name FROM ({QUERY_LOG}))
SELECT table_name, count(query_id) AS query_count FROM ({CATALOG}) LEFT JOIN n ON name = table_name GROUP BY table_name
""")
def referenced_table_join(t):
    listed = F.regexp_extract_all("text", F.lit("(?i)(t[0-9]+_[a-z0-9_]*)"), F.lit(1))
    log = query_log(t).select("query_id", "ts", listed.alias("referenced"))
    found = u.listed_tables(log, "referenced", ["query_id", "ts"])
    return u.table_usage(catalog(t), found, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select(
        "table_name", "query_count"
    )


@query("usage_window_by_kind", f"""
SELECT table_name, CASE WHEN table_name LIKE '%quarterly%' THEN 180 WHEN table_name LIKE '%annual%' THEN 400 ELSE 90 END AS days, count(query_id) AS query_count FROM ({CATALOG})
LEFT JOIN ({NAMES}) ON name = table_name AND ts >= TIMESTAMP '{AS_OF}' - to_days(CASE WHEN table_name LIKE '%quarterly%' THEN 180 WHEN table_name LIKE '%annual%' THEN 400 ELSE 90 END) GROUP BY ALL
""")
def usage_window_by_kind(t):
    found = u.table_usage(catalog(t), names(t), "ts", as_of(), by_kind=True)
    return found.select("table_name", u.window_days(F.col("table_name")).alias("days"), "query_count")


_SUFFIX = r"_(v[0-9]+|backup_[0-9]{4}|backup|old|temp_[a-z0-9_]+|temp|test|archive)$"
FAMILIES = f"""
SELECT *, coalesce(version < newest, false) AS superseded FROM (SELECT *, max(version) OVER (PARTITION BY family) AS newest, count(*) OVER (PARTITION BY family) AS members FROM (
 SELECT table_name, family, suffix, CASE WHEN suffix = '' THEN 1 ELSE TRY_CAST(nullif(regexp_extract(table_name, '_v([0-9]+)$', 1), '') AS INTEGER) END AS version
 FROM (SELECT table_name, regexp_replace(table_name, '{_SUFFIX}', '') AS family, regexp_extract(table_name, '{_SUFFIX}', 1) AS suffix FROM ({CATALOG}))))
"""


@query("version_families", FAMILIES)
def version_families(t):
    return u.version_families(catalog(t))


CLASSIFIED = f"""
SELECT *, CASE WHEN NOT is_zombie THEN 'keep' WHEN confidence > 0.9 THEN 'archive' WHEN confidence >= 0.7 THEN 'review' ELSE 'investigate' END AS action FROM (
 SELECT *, finding NOT IN ('used', 'keep') AS is_zombie,
  CASE finding WHEN 'obvious' THEN 0.95 WHEN 'superseded' THEN 0.85 WHEN 'weak' THEN 0.85 WHEN 'stale' THEN 0.75 WHEN 'unused' THEN 0.6 ELSE 0.88 END::DOUBLE AS confidence,
  CASE finding WHEN 'obvious' THEN 0.92 WHEN 'superseded' THEN 0.8 WHEN 'weak' THEN 0.75 WHEN 'stale' THEN 0.6 WHEN 'unused' THEN 0.3 ELSE 0.05 END::DOUBLE AS safe_to_delete
 FROM (SELECT table_name, size_gb, query_count, CASE WHEN query_count > 0 THEN 'used'
   WHEN regexp_matches(table_name, '(^|_)(quarterly|annual|reference|lookup|archive)(_|$)') THEN 'keep'
   WHEN regexp_matches(table_name, '(^|_)(backup|bak|old|deprecated|legacy|temp|tmp|scratch)(_|$)') THEN 'obvious' WHEN superseded THEN 'superseded'
   WHEN regexp_matches(table_name, '(^|_)(test|dev|staging)(_|$)') THEN 'weak' WHEN created = modified AND DATE '2024-04-10' - created > 730 THEN 'stale' ELSE 'unused' END AS finding
  FROM ({USAGE}) JOIN (SELECT table_name, superseded FROM ({FAMILIES})) USING (table_name)))
"""


def classified(t):
    families = version_families(t).select("table_name", "superseded")
    used = usage(t).join(families, "table_name")
    return u.zombie_classify(used, F.lit("2024-04-10").cast("date"))


@query("zombie_classify", CLASSIFIED)
def zombie_classify(t):
    return classified(t).select(
        "table_name", "size_gb", "query_count", "finding", "is_zombie", "confidence", "safe_to_delete", "action"
    )


@query("zombie_actions", f"""
SELECT action, count(*) AS tables, sum(size_gb::DECIMAL(18,4))::DOUBLE AS size_gb, sum(size_gb::DECIMAL(18,4))::DOUBLE / 1024 * 3.0::DOUBLE AS monthly_cost FROM ({CLASSIFIED}) GROUP BY action
""")
def zombie_actions(t):
    return u.zombie_actions(classified(t))


# Columns of each catalogued table: eight by subject, one more in versions 2 and 3, three fewer in tests.
TABLE_COLUMNS = """
SELECT p_partkey AS table_id, CASE j WHEN 0 THEN 'id' WHEN 1 THEN 'created_at' WHEN 8 THEN 'extra_' || (p_partkey % 10) ELSE 'c' || (p_partkey % 7) || '_' || j END AS name
FROM part, (SELECT unnest(range(9)) AS j) WHERE (j < 8 OR p_partkey % 10 IN (1, 2)) AND (j < 5 OR p_partkey % 10 <> 9)
"""


def table_columns(t):
    cells = t.part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("j"))
    kept = cells.filter("(j < 8 OR p_partkey % 10 IN (1, 2)) AND (j < 5 OR p_partkey % 10 <> 9)")
    return kept.selectExpr(
        "p_partkey AS table_id",
        "CASE j WHEN 0 THEN 'id' WHEN 1 THEN 'created_at' WHEN 8 THEN concat('extra_', p_partkey % 10) ELSE concat('c', p_partkey % 7, '_', j) END AS name",
    )


@query("schema_clusters", f"""
WITH RECURSIVE sets AS (SELECT table_id, list_sort(list(DISTINCT name)) AS names FROM ({TABLE_COLUMNS}) GROUP BY table_id),
sig AS (SELECT names, min(table_id) AS s FROM sets GROUP BY names),
pairs AS (SELECT a.s AS a, b.s AS b FROM sig a JOIN sig b ON len(list_intersect(a.names, b.names))::DOUBLE / len(list_distinct(list_concat(a.names, b.names))) >= 0.85),
r(s, g) AS (SELECT s, s FROM sig UNION SELECT r.s, pairs.b FROM r JOIN pairs ON pairs.a = r.g),
c AS (SELECT s, min(g) AS cluster FROM r GROUP BY s),
k AS (SELECT cluster, u.* FROM sets JOIN sig USING (names) JOIN c USING (s) JOIN ({USAGE}) u USING (table_id)),
l AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS members, first_value(table_name) OVER (PARTITION BY cluster ORDER BY query_count DESC, created DESC, table_name DESC) AS primary_table FROM k)
SELECT cluster, table_name, members, primary_table, table_name <> primary_table AS superseded FROM l WHERE members > 1
""")
def schema_clusters(t):
    return u.schema_clusters(table_columns(t), usage(t))


@query("relevant_tables", f"""
SELECT table_id FROM ({TABLE_COLUMNS}) WHERE name IN ('c3_4', 'c3_5', 'created_at') GROUP BY table_id HAVING count(DISTINCT name) = 3
""")
def relevant_tables(t):
    from tidemark.operators.search import relevant_tables as relevant

    return relevant(table_columns(t), ["c3_4", "c3_5", "created_at"])
