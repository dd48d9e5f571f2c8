"""Budgeted selection over documents (large groups) and orders per customer (small groups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import selection as s
from tidemark.operators.quality import issue_priority
from tidemark.plans.fixtures import CATALOG, ISSUES, catalog, issues
from tidemark.plans.quality import PRIORITY
from tidemark.plans.registry import query

BUDGET = 6000


def document_items(t):
    priority = issue_priority(F.col("issue_type"), F.col("severity")).cast("long")
    return issues(t).select("grp", F.col("issue").alias("item"), "tokens", priority.alias("priority"))


DOCUMENT_ITEMS = f"SELECT grp, issue AS item, tokens, {PRIORITY} AS priority FROM ({ISSUES})"

# Orders of a customer as work items: one token per 50,000 of value, priority by urgency.
ORDER_ITEMS = """
SELECT o_custkey AS grp, o_orderkey AS item, 1 + floor(o_totalprice / 50000)::BIGINT AS tokens,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 15 WHEN '2' THEN 10 WHEN '3' THEN 5 ELSE 1 END AS priority FROM orders
"""


def order_items(t):
    return t.orders.selectExpr(
        "o_custkey AS grp", "o_orderkey AS item", "1 + floor(o_totalprice / 50000) AS tokens",
        "cast(CASE left(o_orderpriority, 1) WHEN '1' THEN 15 WHEN '2' THEN 10 WHEN '3' THEN 5 ELSE 1 END AS bigint) AS priority",
    )


@query("budget_available", """
SELECT run, used, greatest(floor(200000 * 0.75)::BIGINT - used, 0) AS available, used / 200000::DOUBLE * 100.0::DOUBLE AS utilization
FROM (SELECT source AS run, sum(n_chars // 4)::BIGINT AS used FROM documents GROUP BY source)
""")
def budget_available(t):
    used = t.documents.groupBy(F.col("source").alias("run")).agg(F.sum(F.expr("n_chars div 4")).alias("used"))
    most = F.lit(200000)
    return used.select(
        "run", "used", s.budget_available(most, F.col("used")).alias("available"), s.utilization(most, F.col("used")).alias("utilization")
    )


@query("can_afford", """
SELECT conv_id, turn, greatest(7500 - turn * 100, 0) AS available, length(text) // 4 + 1000 AS needed, greatest(7500 - turn * 100, 0) >= length(text) // 4 + 1000 AS affordable FROM conversations
""")
def can_afford(t):
    from tidemark.functions.values import token_estimate

    available = s.budget_available(F.lit(10000), F.col("turn") * 100)
    needed = token_estimate(F.col("text")) + 1000
    return t.conversations.select(
        "conv_id", "turn", available.alias("available"), needed.alias("needed"), s.can_afford(available, needed).alias("affordable")
    )


@query("tier_allocation", f"""
WITH n AS (SELECT grp, sum(CASE WHEN priority = 15 THEN tokens ELSE 0 END)::BIGINT AS c, sum(CASE WHEN priority = 10 THEN tokens ELSE 0 END)::BIGINT AS h,
  sum(CASE WHEN priority = 5 THEN tokens ELSE 0 END)::BIGINT AS m, sum(CASE WHEN priority = 1 THEN tokens ELSE 0 END)::BIGINT AS l FROM ({DOCUMENT_ITEMS}) GROUP BY grp),
a AS (SELECT *, least(h, greatest({BUDGET} - c, 0)) AS gh FROM n), b AS (SELECT *, least(m, greatest({BUDGET} - c - gh, 0)) AS gm FROM a)
SELECT grp, c AS critical, gh AS high, gm AS medium, least(l, greatest({BUDGET} - c - gh - gm, 0)) AS low FROM b
""")
def tier_allocation(t):
    return s.tier_allocation(document_items(t), F.lit(BUDGET))


def greedy_sql(items: str, budget: int) -> str:
    return f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY priority::DOUBLE / greatest(tokens, 1) DESC, item) AS rn FROM ({items})),
g(grp, rn, room, item, tokens, priority, taken) AS (
 SELECT grp, 0::BIGINT, {budget}::BIGINT, NULL::BIGINT, 0::BIGINT, 0, false FROM (SELECT DISTINCT grp FROM o)
 UNION ALL SELECT o.grp, o.rn, CASE WHEN o.tokens <= g.room THEN g.room - o.tokens ELSE g.room END, o.item, o.tokens, o.priority, o.tokens <= g.room
 FROM g JOIN o ON o.grp = g.grp AND o.rn = g.rn + 1)
SELECT grp, item, tokens, priority FROM g WHERE taken"""


@query("greedy_select", greedy_sql(DOCUMENT_ITEMS, BUDGET))
def greedy_select(t):
    return s.greedy_select(document_items(t), BUDGET)


def optimum_sql(items: str, budget: int, least: int, most: int) -> str:
    """Best total by growing every reachable (tokens, priority) pair item by item."""
    return f"""
SELECT grp, max(p)::BIGINT AS total_priority FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY item) AS rn FROM ({items}) QUALIFY count(*) OVER (PARTITION BY grp) BETWEEN {least} AND {most}),
s(grp, rn, w, p) AS (SELECT DISTINCT grp, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o
 UNION SELECT o.grp, o.rn, w + take * tokens, p + take * priority FROM s JOIN o ON o.grp = s.grp AND o.rn = s.rn + 1, (VALUES (0), (1)) v(take) WHERE w + take * tokens <= {budget})
SELECT * FROM s) GROUP BY grp"""


def totals(selected):
    return selected.groupBy("grp").agg(F.sum("priority").alias("total_priority"))


@query("knapsack_select", optimum_sql(ORDER_ITEMS, 15, 11, 50))
def knapsack_select(t):
    return totals(s.knapsack_select(order_items(t), 15))


@query("exhaustive_select", optimum_sql(ORDER_ITEMS, 15, 1, 10))
def exhaustive_select(t):
    return totals(s.exhaustive_select(order_items(t), 15))


MIXED_ITEMS = f"""
SELECT grp::VARCHAR AS grp, item, tokens, priority FROM ({ORDER_ITEMS})
UNION ALL SELECT lang, doc_id, 1 + n_chars // 2000, 1 + doc_id % 15 FROM documents
"""
LARGE_ITEMS = f"SELECT * FROM ({MIXED_ITEMS}) QUALIFY count(*) OVER (PARTITION BY grp) > 50"


@query("auto_select", f"""
SELECT 'optimal' AS strategy, grp, total_priority FROM ({optimum_sql(MIXED_ITEMS, 15, 1, 10)})
UNION ALL SELECT 'knapsack', grp, total_priority FROM ({optimum_sql(MIXED_ITEMS, 15, 11, 50)})
UNION ALL SELECT 'greedy', grp, sum(priority)::BIGINT FROM ({greedy_sql(LARGE_ITEMS, 15)}) GROUP BY grp
""")
def auto_select(t):
    documents = t.documents.selectExpr(
        "lang AS grp", "doc_id AS item", "1 + n_chars div 2000 AS tokens", "1 + doc_id % 15 AS priority"
    )
    items = order_items(t).withColumn("grp", F.col("grp").cast("string")).unionByName(documents)
    return s.auto_select(items, 20).groupBy("strategy", "grp").agg(F.sum("priority").alias("total_priority"))


@query("selection_report", f"""
WITH i AS ({DOCUMENT_ITEMS}), s AS ({greedy_sql(DOCUMENT_ITEMS, BUDGET)})
SELECT priority, count(*) AS items, count(s.item) AS included, count(*) - count(s.item) AS dropped, coalesce(sum(s.tokens), 0)::BIGINT AS tokens_used,
  coalesce(sum(s.tokens), 0)::DOUBLE / ({BUDGET} * (SELECT count(DISTINCT grp) FROM i)) AS utilization
FROM i LEFT JOIN (SELECT grp, item, tokens FROM s) s USING (grp, item) GROUP BY priority
""".replace("s.item", "sel").replace("s.tokens", "used").replace("(SELECT grp, item, tokens FROM s) s", "(SELECT grp, item, item AS sel, tokens AS used FROM s)"))
def selection_report(t):
    items = document_items(t)
    return s.selection_report(items, s.greedy_select(items, BUDGET), BUDGET)


@query("table_scan_priority", f"""
SELECT table_id, CASE WHEN table_name LIKE '%user%' OR table_name LIKE '%customer%' THEN 15 WHEN table_name LIKE '%order%' OR table_name LIKE '%transaction%' THEN 10
  WHEN table_name LIKE '%analytics%' OR table_name LIKE '%log%' THEN 5 ELSE 1 END AS priority FROM ({CATALOG})
""")
def table_scan_priority(t):
    return catalog(t).select("table_id", s.table_scan_priority(F.col("table_name")).alias("priority"))


@query("size_priority", f"SELECT table_name, size_gb, floor(size_gb)::BIGINT AS priority FROM ({CATALOG}) ORDER BY size_gb DESC, table_name")
def size_priority(t):
    return s.size_priority(catalog(t).select("table_name", "size_gb"), "table_name", "size_gb")
