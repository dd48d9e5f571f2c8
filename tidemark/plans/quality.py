"""Quality rules over customer records with planted defects, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.plans.fixtures import ISSUES, issues
from tidemark.plans.generated import stages, stages_sql
from tidemark.plans.registry import query

RECORDS = """
SELECT o_orderkey AS record,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed,
  CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL ELSE 'c' || o_custkey || '@example.com' END AS email,
  CASE WHEN o_orderkey % 8 = 0 THEN 'much' ELSE (o_custkey * 10)::VARCHAR END AS amount,
  CASE WHEN o_orderkey % 4 = 0 THEN 'john doe' ELSE 'John Doe' END AS owner
FROM orders
"""


def records(t):
    return t.orders.selectExpr(
        "o_orderkey AS record",
        "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 1 THEN date_format(o_orderdate, 'dd-MM-yyyy') "
        "WHEN 2 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS placed",
        "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL ELSE concat('c', o_custkey, '@example.com') END AS email",
        "CASE WHEN o_orderkey % 8 = 0 THEN 'much' ELSE cast(o_custkey * 10 AS string) END AS amount",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'john doe' ELSE 'John Doe' END AS owner",
    )


def rules():
    placed, email, amount, owner = (F.col(n) for n in ("placed", "email", "amount", "owner"))
    return {
        "placed": {
            "date_format": (q.not_iso_date(placed), "yyyy-MM-dd"),
            "invalid_value": (q.parse_date(placed).isNull(), "a date"),
        },
        "email": {"missing_value": (q.is_missing(email), "an address")},
        "amount": {"schema_mismatch": (q.not_number(amount), "a number")},
        "owner": {"style_warning": (q.not_title_case(owner), "Title Case")},
    }


BROKEN = f"""
WITH r AS ({RECORDS})
SELECT record, 'date_format' AS issue_type, 'placed' AS field, placed AS current_value, 'yyyy-MM-dd' AS expected FROM r WHERE record % 6 IN (0, 1)
UNION ALL SELECT record, 'invalid_value', 'placed', placed, 'a date' FROM r WHERE placed = 'soon'
UNION ALL SELECT record, 'missing_value', 'email', email, 'an address' FROM r WHERE email IS NULL OR email IN ('', 'N/A')
UNION ALL SELECT record, 'schema_mismatch', 'amount', amount, 'a number' FROM r WHERE TRY_CAST(amount AS DOUBLE) IS NULL
UNION ALL SELECT record, 'style_warning', 'owner', owner, 'Title Case' FROM r WHERE owner = 'john doe'
"""


@query("detect_issues", BROKEN)
def detect_issues(t):
    return q.detect_issues(records(t), "record", rules())


PRIORITY = """CASE WHEN severity = 'critical' THEN 15 WHEN issue_type IN ('date_format', 'schema_mismatch') THEN 10
  WHEN issue_type IN ('missing_value', 'data_validation') THEN 5 ELSE 1 END"""


@query("issue_priority", f"SELECT issue, issue_type, severity, {PRIORITY} AS priority FROM ({ISSUES})")
def issue_priority(t):
    priority = q.issue_priority(F.col("issue_type"), F.col("severity"))
    return issues(t).select("issue", "issue_type", "severity", priority.alias("priority"))


@query("quality_score", f"""
SELECT phase, rows, bad_rows, (rows - bad_rows)::DOUBLE / rows AS score FROM (
 SELECT 'before' AS phase, (SELECT count(*) FROM orders) AS rows, count(DISTINCT record) AS bad_rows FROM ({BROKEN})
 UNION ALL SELECT 'after', (SELECT count(*) FROM orders), count(*) FILTER (o_orderkey % 8 = 0 OR o_orderkey % 4 = 0) FROM orders)
""")
def quality_score(t):
    def broken():
        return [condition for kinds in rules().values() for condition, _ in kinds.values()]

    before = records(t)
    after = before.withColumns({"placed": q.fix_date(F.col("placed")), "email": q.fill_missing(F.col("email"))})
    scores = [
        q.quality_score(df, broken()).withColumn("phase", F.lit(phase))
        for phase, df in (("before", before), ("after", after))
    ]
    return scores[0].unionByName(scores[1])


@query("null_check", f"""
SELECT count(*) FILTER (email IS NULL) AS email_nulls, count(*) FILTER (placed IS NULL) AS placed_nulls FROM ({RECORDS})
""")
def null_check(t):
    return q.null_check(records(t), ["email", "placed"])


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_keys(t):
    return q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("range_check", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 9000")
def range_check(t):
    return q.outside_range(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0, 9000)


@query("key_format_check", r"""
SELECT p_partkey, p_name FROM part WHERE NOT regexp_full_match(p_name, '[a-z]+ [a-m][a-z]+')
""")
def key_format_check(t):
    return q.bad_keys(t.part.select("p_partkey", "p_name"), "p_name", "[a-z]+ [a-m][a-z]+")


@query("allowed_values", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
""")
def allowed_values(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return q.not_allowed(rows, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("distribution_check", """
SELECT count(*) FILTER (lang = 'en') AS larger_rows, count(*) FILTER (lang = 'de') AS smaller_rows,
  count(*) FILTER (lang = 'en') > count(*) FILTER (lang = 'de') AS holds FROM documents
""")
def distribution_check(t):
    return q.distribution_order(t.documents, "lang", "en", "de")


@query("stage_order_check", f"""
SELECT o_orderkey, (qualified_date IS NULL OR (presentation_date IS NOT NULL AND presentation_date <= qualified_date))
  AND (decision_date IS NULL OR (qualified_date IS NOT NULL AND qualified_date <= decision_date)) AS swapped_ok FROM ({stages_sql()})
""")
def stage_order_check(t):
    rows = stages(t)
    return rows.select("o_orderkey", q.stage_order_ok(["presentation_date", "qualified_date", "decision_date"]).alias("swapped_ok"))


@query("fix_dates", f"""
SELECT record, CASE WHEN placed = 'soon' THEN '1900-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS placed FROM ({RECORDS}) JOIN orders ON o_orderkey = record
""")
def fix_dates(t):
    return records(t).select("record", q.fix_date(F.col("placed")).alias("placed"))


@query("fill_missing", f"""
SELECT record, CASE WHEN email IS NULL OR email IN ('', 'N/A') THEN 'unknown@example.com' ELSE email END AS email FROM ({RECORDS})
""")
def fill_missing(t):
    return records(t).select("record", q.fill_missing(F.col("email")).alias("email"))
