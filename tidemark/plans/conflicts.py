"""Conflicts between the three customer sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conflicts as c
from tidemark.plans.fixtures import SOURCES, sources
from tidemark.plans.generated import MULTI_SOURCE, multi_source
from tidemark.plans.registry import query

# Fields for which one source is the authority.
AUTHORITY = {"email": {"crm": 5, "erp": 2, "legacy": 1}, "segment": {"erp": 5, "crm": 2, "legacy": 1}}


def joined(df, *names):
    return df.withColumns({n: F.concat_ws(",", n) for n in names})


@query("detect_conflicts", f"""
SELECT entity, field, count(*) AS num_sources, count(DISTINCT coalesce(value, chr(1))) AS num_values,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT coalesce(value, chr(1))) || '-way' AS conflict_type
FROM ({SOURCES}) GROUP BY entity, field HAVING num_values > 1
""")
def detect_conflicts(t):
    return joined(c.detect_conflicts(sources(t)), "sources")


@query("conflict_values", f"""
WITH s AS ({SOURCES})
SELECT entity, field, value, count(*) AS num_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM s
WHERE (entity, field) IN (SELECT (entity, field) FROM s GROUP BY entity, field HAVING count(DISTINCT coalesce(value, chr(1))) > 1)
GROUP BY entity, field, value
""")
def conflict_values(t):
    return joined(c.conflict_values(sources(t)), "sources")


def resolved_sql(priority: str = "priority") -> str:
    return f"""
SELECT entity, field, value, source AS winner, p AS priority, runner_up, num_sources,
  coalesce(discarded, '') AS discarded_sources, num_values > 1 AS conflict FROM (
 SELECT *, row_number() OVER w AS rn, lead(p) OVER w AS runner_up, count(*) OVER g AS num_sources,
   count(DISTINCT coalesce(value, chr(1))) OVER g AS num_values
 FROM (SELECT *, {priority} AS p FROM ({SOURCES}))
 WINDOW w AS (PARTITION BY entity, field ORDER BY {priority} DESC, updated DESC, source), g AS (PARTITION BY entity, field))
LEFT JOIN LATERAL (SELECT CASE source WHEN 'crm' THEN 'erp,legacy' WHEN 'erp' THEN 'crm,legacy' ELSE 'crm,erp' END AS discarded) ON true
WHERE rn = 1
"""


RESOLVED = resolved_sql()


@query("resolve_by_priority", RESOLVED)
def resolve_by_priority(t):
    return joined(c.resolve(sources(t)), "discarded_sources")


_AUTHORITY_SQL = """CASE WHEN field = 'email' THEN CASE source WHEN 'crm' THEN 5 WHEN 'erp' THEN 2 ELSE 1 END
  WHEN field = 'segment' THEN CASE source WHEN 'erp' THEN 5 WHEN 'crm' THEN 2 ELSE 1 END ELSE priority END"""


@query("field_authority", resolved_sql(_AUTHORITY_SQL))
def field_authority(t):
    return joined(c.resolve(c.with_authority(sources(t), AUTHORITY)), "discarded_sources")


@query("timestamp_tiebreak", f"""
SELECT entity, value, winner FROM ({RESOLVED}) WHERE field = 'nation'
""")
def timestamp_tiebreak(t):
    # All sources have the same priority for this field: the newest row decides.
    return c.resolve(sources(t).filter("field = 'nation'")).select("entity", "value", "winner")


CONFIDENCE = f"""
SELECT *, greatest(CASE WHEN priority - coalesce(runner_up, 0) >= 3 THEN 95 WHEN priority - coalesce(runner_up, 0) = 2 THEN 85
  WHEN priority - coalesce(runner_up, 0) = 1 THEN 70 ELSE 50 END - least(CASE WHEN num_sources >= 2 THEN (num_sources - 2) * 5 ELSE 0 END, 15), 0) / 100.0::DOUBLE AS confidence
FROM ({resolved_sql(_AUTHORITY_SQL)})
"""


def scored(t):
    return c.with_confidence(c.resolve(c.with_authority(sources(t), AUTHORITY)))


@query("resolution_confidence", f"SELECT entity, field, winner, confidence FROM ({CONFIDENCE})")
def resolution_confidence(t):
    return scored(t).select("entity", "field", "winner", "confidence")


@query("manual_review_queue", f"""
SELECT entity, field, value, winner, confidence, reasons FROM (SELECT *, concat_ws(',', CASE WHEN confidence < 0.7 THEN 'low_confidence' END,
  CASE WHEN field IN ('email', 'phone', 'ssn', 'bank_account') THEN 'critical_field' END, CASE WHEN total > 1000000 THEN 'high_value' END) AS reasons
 FROM ({CONFIDENCE}) LEFT JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1) ON o_custkey = entity WHERE conflict)
WHERE reasons <> ''
""")
def manual_review_queue(t):
    value = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("entity_value")
    )
    queue = c.review_queue(scored(t).filter("conflict"), value)
    return joined(queue, "reasons").select("entity", "field", "value", "winner", "confidence", "reasons")


@query("conflict_report", f"""
WITH s AS ({CONFIDENCE}), r AS (
 SELECT 'all' AS section, CASE WHEN conflict THEN 'conflict' ELSE 'agreed' END AS key FROM s
 UNION ALL SELECT 'field', field FROM s WHERE conflict UNION ALL SELECT 'winner', winner FROM s WHERE conflict
 UNION ALL SELECT 'confidence', CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END FROM s WHERE conflict)
SELECT section, key, count(*) AS rows, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY section)::DOUBLE AS share FROM r GROUP BY section, key
""")
def conflict_report(t):
    return c.conflict_report(scored(t))


@query("golden_record", f"""
SELECT entity, max(value) FILTER (field = 'name') AS name, max(value) FILTER (field = 'email') AS email, max(value) FILTER (field = 'phone') AS phone,
  max(value) FILTER (field = 'segment') AS segment, max(value) FILTER (field = 'nation') AS nation FROM ({RESOLVED}) GROUP BY entity
""")
def golden_record(t):
    return c.golden_record(c.resolve(sources(t)), ["name", "email", "phone", "segment", "nation"])


@query("normalize_variants", f"""
SELECT record_id, left(lower(trim(first_name)), 1) AS first_initial, lower(trim(last_name)) AS last_name, lower(trim(email)) AS email,
  regexp_replace(phone, '[^0-9]', '', 'g') AS phone, strftime(created_date, '%Y-%m-%d') AS created_date FROM ({MULTI_SOURCE})
""")
def normalize_variants(t):
    return c.normalize_variants(multi_source(t))
