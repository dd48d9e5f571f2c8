"""Two schema versions per table, derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evolution as e
from tidemark.operators.usage import named_tables
from tidemark.plans.fixtures import NEW_COLUMNS, OLD_COLUMNS, QUERY_LOG, new_columns, old_columns, query_log
from tidemark.plans.registry import query

DIFF = f"""
SELECT coalesce(o.table_id, n.table_id) AS table_id, coalesce(o.name, n.name) AS name, o.type AS old_type, n.type AS new_type,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.type <> n.type THEN 'type_change' ELSE 'same' END AS change
FROM ({OLD_COLUMNS}) o FULL JOIN ({NEW_COLUMNS}) n ON o.table_id = n.table_id AND o.name = n.name
"""


@query("schema_diff", DIFF)
def schema_diff(t):
    return e.schema_diff(old_columns(t), new_columns(t))


_ABBREVIATED = " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in e.ABBREVIATIONS.items())


def _words(c: str) -> str:
    return f"list_distinct(string_split(lower({c}), '_'))"


def _full(c: str) -> str:
    return f"list_distinct(list_transform({_words(c)}, lambda w: CASE w {_ABBREVIATED} ELSE w END))"


def candidates_sql(diff: str) -> str:
    return f"""
SELECT table_id, old_name, new_name, points / 100.0::DOUBLE AS score, CASE WHEN points >= 90 THEN 'obvious' WHEN points >= 70 THEN 'semantic' ELSE 'review' END AS band,
  levenshtein(old_name, new_name) AS distance FROM (
 SELECT *, CASE WHEN len(list_filter(ow, lambda w: NOT list_contains(nw, w))) = 0 THEN 95 WHEN list_sort(of) = list_sort(nf) THEN 85
   ELSE floor(40 + shared * 20 / least(len(of), len(nf))) END - CASE WHEN old_type <> new_type THEN 10 ELSE 0 END AS points FROM (
  SELECT *, len(list_intersect(of, nf)) AS shared FROM (
   SELECT r.table_id, r.name AS old_name, r.old_type, a.name AS new_name, a.new_type, {_words('r.name')} AS ow, {_words('a.name')} AS nw, {_full('r.name')} AS of, {_full('a.name')} AS nf
   FROM ({diff}) r JOIN ({diff}) a ON r.table_id = a.table_id AND r.change = 'removed' AND a.change = 'added')) WHERE shared > 0)
"""


@query("rename_candidates", candidates_sql(DIFF))
def rename_candidates(t):
    return e.rename_candidates(schema_diff(t))


@query("split_merge_candidates", f"""
WITH g AS (SELECT table_id, list_sort(list(name) FILTER (change = 'removed')) AS r, list_sort(list(name) FILTER (change = 'added')) AS a
 FROM ({DIFF}) WHERE change IN ('removed', 'added') GROUP BY table_id, string_split(lower(name), '_')[-1]),
e AS (SELECT table_id, 'split' AS change, r AS w, a AS p FROM g UNION ALL SELECT table_id, 'merged', a, r FROM g)
SELECT table_id, change, w[1] AS whole, array_to_string(p, ',') AS parts FROM e
WHERE len(w) = 1 AND len(p) >= 2 AND len(list_filter(p, lambda x: list_sort({_full('x')}) = list_sort({_full('w[1]')}))) = 0
""")
def split_merge_candidates(t):
    found = e.split_merge_candidates(schema_diff(t))
    return found.select("table_id", "change", "whole", F.concat_ws(",", "parts").alias("parts"))


@query("split_check", """
SELECT p_type, count(*) AS rows, (count(*) FILTER (p_name = split_part(p_name, ' ', 1) || ' ' || CASE WHEN p_size > 45 THEN 'x' ELSE split_part(p_name, ' ', 2) END))::DOUBLE / count(*) AS share
FROM part GROUP BY p_type
""")
def split_check(t):
    rows = t.part.selectExpr(
        "p_type", "p_name AS full_name", "split_part(p_name, ' ', 1) AS first_name",
        "CASE WHEN p_size > 45 THEN 'x' ELSE split_part(p_name, ' ', 2) END AS last_name",
    )
    return e.split_share(rows, "full_name", ["first_name", "last_name"], by=["p_type"])


# The fixture has one split and one merge per table; what is left is matched by name.
_FREE = f"SELECT * FROM ({DIFF}) WHERE change <> 'same' AND name NOT IN ('full_name', 'first_name', 'last_name', 'phone', 'home_phone', 'work_phone')"
_CANDIDATES = candidates_sql(_FREE)
CHANGES = f"""
WITH f AS ({_FREE}), c AS ({_CANDIDATES}),
b AS (SELECT *, row_number() OVER (PARTITION BY table_id, old_name ORDER BY score DESC, distance, new_name) AS ro,
  row_number() OVER (PARTITION BY table_id, new_name ORDER BY score DESC, distance, old_name) AS rn FROM c),
r AS (SELECT table_id, old_name, new_name FROM b WHERE ro = 1 AND rn = 1 AND score >= 0.7)
SELECT p_partkey AS table_id, 'split' AS change, 'full_name' AS old_name, 'first_name,last_name' AS new_name, NULL::VARCHAR AS old_type, NULL::VARCHAR AS new_type FROM part
UNION ALL SELECT p_partkey, 'merged', 'home_phone,work_phone', 'phone', NULL, NULL FROM part
UNION ALL SELECT table_id, 'renamed', old_name, new_name, NULL, NULL FROM r
UNION ALL SELECT table_id, change, CASE WHEN change <> 'added' THEN name END, CASE WHEN change <> 'removed' THEN name END, old_type, new_type FROM f
 WHERE (table_id, name) NOT IN (SELECT (table_id, old_name) FROM r) AND (table_id, name) NOT IN (SELECT (table_id, new_name) FROM r)
"""


@query("classify_changes", CHANGES)
def classify_changes(t):
    return e.classify_changes(old_columns(t), new_columns(t))


@query("migration_plan", f"""
WITH c AS (SELECT *, 'ALTER TABLE t' || table_id AS a, ' UPDATE t' || table_id AS u FROM ({CHANGES}))
SELECT table_id, change, CASE change WHEN 'renamed' THEN a || ' RENAME COLUMN ' || old_name || ' TO ' || new_name || ';'
  WHEN 'split' THEN a || ' ADD COLUMNS (first_name STRING, last_name STRING);' || u || ' SET first_name = SPLIT_PART(full_name, '' '', 1), last_name = SPLIT_PART(full_name, '' '', 2); ' || a || ' DROP COLUMN full_name;'
  WHEN 'merged' THEN a || ' ADD COLUMNS (phone STRING);' || u || ' SET phone = CONCAT_WS('' '', home_phone, work_phone); ' || a || ' DROP COLUMNS (home_phone, work_phone);'
  WHEN 'added' THEN a || ' ADD COLUMN ' || new_name || ' ' || new_type || ';' WHEN 'removed' THEN a || ' DROP COLUMN ' || old_name || ';'
  ELSE a || ' ALTER COLUMN ' || new_name || ' TYPE ' || new_type || ';' END AS statement,
 CASE change WHEN 'renamed' THEN a || ' RENAME COLUMN ' || new_name || ' TO ' || old_name || ';'
  WHEN 'split' THEN a || ' ADD COLUMNS (full_name STRING);' || u || ' SET full_name = CONCAT_WS('' '', first_name, last_name); ' || a || ' DROP COLUMNS (first_name, last_name);'
  WHEN 'merged' THEN a || ' ADD COLUMNS (home_phone STRING, work_phone STRING);' || u || ' SET home_phone = SPLIT_PART(phone, '' '', 1), work_phone = SPLIT_PART(phone, '' '', 2); ' || a || ' DROP COLUMN phone;'
  WHEN 'added' THEN a || ' DROP COLUMN ' || new_name || ';' WHEN 'removed' THEN a || ' ADD COLUMN ' || old_name || ' ' || old_type || ';'
  ELSE a || ' ALTER COLUMN ' || new_name || ' TYPE ' || old_type || ';' END AS reverse FROM c
""")
def migration_plan(t):
    table = F.concat(F.lit("t"), F.col("table_id").cast("string"))
    return e.migration_plan(classify_changes(t), table).select("table_id", "change", "statement", "reverse")


@query("apply_migration", """
SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, c_nationkey || '-' || c_mktsegment AS market,
  round(c_acctbal)::BIGINT AS balance, NULL::VARCHAR AS email FROM customer
""")
def apply_migration(t):
    rows = t.customer.withColumn("c_acctbal", F.round("c_acctbal").cast("string"))
    return e.apply_migration(rows, [
        ("rename", "c_custkey", "customer_id"),
        ("split", "c_name", ["kind", "number"], "#"),
        ("merge", ["c_nationkey", "c_mktsegment"], "market", "-"),
        ("rename", "c_acctbal", "balance"),
        ("type", "balance", "decimal(18,1)"),
        ("type", "balance", "bigint"),
        ("add", "email", "string"),
        ("add", "unused", "int"),
        ("drop", "unused"),
    ])


@query("change_impact", f"""
WITH n AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS name FROM ({QUERY_LOG}))
SELECT old_name, count(DISTINCT table_id) AS tables, bool_or(change <> 'added') AS breaking, coalesce((SELECT count(*) FROM n WHERE n.name = c.old_name), 0) AS queries
FROM ({CHANGES}) c WHERE old_name IS NOT NULL GROUP BY old_name
""")
def change_impact(t):
    return e.change_impact(classify_changes(t), named_tables(query_log(t), "text", ["query_id"]))


@query("change_summary", f"SELECT change, count(*) AS changes, change <> 'added' AS breaking FROM ({CHANGES}) GROUP BY change")
def change_summary(t):
    return e.change_summary(classify_changes(t))


@query("schema_versions", f"""
SELECT table_id, name, min(version) AS first_version, max(version) AS last_version, count(DISTINCT type) AS types,
  min(version) > 1 AND max(version) = 2 AND count(DISTINCT type) = 1 AS compatible_addition
FROM (SELECT 1 AS version, * FROM ({OLD_COLUMNS}) UNION ALL SELECT 2, * FROM ({NEW_COLUMNS})) GROUP BY table_id, name
""")
def schema_versions(t):
    versions = old_columns(t).withColumn("version", F.lit(1)).unionByName(new_columns(t).withColumn("version", F.lit(2)))
    return e.schema_versions(versions, 2)
