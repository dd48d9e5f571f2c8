"""Profiles, keys, paths, lineage and insights over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics
from tidemark.operators import relations as r
from tidemark.operators.ordered import positions
from tidemark.plans.registry import COLUMNS, ROWS, TABLES, query

PROFILED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"],
}
TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string", "doc_id": "bigint", "quality": "int", "toxic": "int",
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "timestamp_ntz",
}


def _text(c: str) -> str:
    if TYPES[c] == "double":
        return "{x}::VARCHAR"
    return "strftime({x}, '%Y-%m-%d %H:%M:%S')" if TYPES[c] == "timestamp_ntz" else "{x}::VARCHAR"


PROFILE = " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", '{c}' AS "column", '{TYPES[c]}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
 {_text(c).format(x=f'min({c})')} AS least, {_text(c).format(x=f'max({c})')} AS greatest FROM {table}"""
    for table, columns in PROFILED.items() for c in columns
)


def profiles(t):
    return analytics.union_tables([r.column_profile(name, getattr(t, name), columns) for name, columns in PROFILED.items()])


@query("column_profile", PROFILE)
def column_profile(t):
    return profiles(t)


@query("column_profile_approx", f"""SELECT "table", "column", rows, nulls, true AS within_10_percent FROM ({PROFILE})""")
def column_profile_approx(t):
    """The exact figures of the approximate profile, and whether its estimates hold against the exact profile."""
    near = analytics.union_tables([r.column_profile_approx(name, getattr(t, name), columns) for name, columns in PROFILED.items()])
    exact = profiles(t).select("table", "column", F.col("distinct_values").alias("exact"))
    within = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.1 * F.col("exact")
    return near.join(exact, ["table", "column"]).select("table", "column", "rows", "nulls", within.alias("within_10_percent"))


@query("column_roles", f"""
SELECT "table", "column", CASE WHEN regexp_matches("column", '(key|id|_by)$') THEN CASE WHEN distinct_values = rows AND nulls = 0 THEN 'identifier' ELSE 'foreign_key' END
  WHEN type LIKE 'timestamp%' THEN 'timestamp' WHEN type IN ('int', 'bigint', 'double') THEN 'metric' ELSE 'dimension' END AS role FROM ({PROFILE})
""")
def column_roles(t):
    return r.column_roles(profiles(t))


KEYS = ["orders.o_orderkey", "orders.o_custkey", "customer.c_custkey", "lineitem.l_orderkey", "lineitem.l_partkey", "lineitem.l_suppkey",
        "part.p_partkey", "supplier.s_suppkey", "documents.doc_id", "labels.doc_id"]

_DISTINCT = " UNION ALL ".join(f"SELECT '{k}' AS c, {k.split('.')[1]} AS v, count(*) AS n FROM {k.split('.')[0]} WHERE {k.split('.')[1]} IS NOT NULL GROUP BY 2" for k in KEYS)
FOREIGN_KEYS = f"""
WITH d AS ({_DISTINCT}), t AS (SELECT c, count(*) AS total, max(n) AS copies FROM d GROUP BY c)
SELECT x.c AS child, y.c AS parent, count(*)::DOUBLE / any_value(tc.total) AS containment
FROM d x JOIN d y ON x.v = y.v AND x.c <> y.c AND split_part(x.c, '.', 1) <> split_part(y.c, '.', 1) JOIN t tc ON tc.c = x.c JOIN t tp ON tp.c = y.c AND tp.copies = 1
GROUP BY x.c, y.c HAVING count(*) = any_value(tc.total)
"""


def keys(t, names=KEYS):
    return r.fk_discovery({k: k.split(".")[1] for k in names}, {k.split(".")[0]: getattr(t, k.split(".")[0]) for k in names})


@query("fk_discovery", FOREIGN_KEYS)
def fk_discovery(t):
    return keys(t)


@query("fk_discovery_sketched", FOREIGN_KEYS)
def fk_discovery_sketched(t):
    return r.fk_discovery_sketched({k: k.split(".")[1] for k in KEYS}, {k.split(".")[0]: getattr(t, k.split(".")[0]) for k in KEYS})


@query("semantic_fk_discovery", """
WITH l AS (SELECT DISTINCT 'customer#' || lpad(user_id::VARCHAR, 9, '0') AS v FROM events), c AS (SELECT DISTINCT lower(c_name) AS v FROM customer)
SELECT 'events.login' AS child, 'customer.c_name' AS parent, count(*)::DOUBLE / (SELECT count(*) FROM l) AS containment FROM l JOIN c USING (v) HAVING count(*) > 0
""")
def semantic_fk_discovery(t):
    from tidemark.functions.values import normalize_name

    login = F.concat(F.lit(" CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return r.fk_discovery(
        {"events.login": login, "customer.c_name": "c_name", "customer.c_mktsegment": "c_mktsegment"},
        {"events": t.events, "customer": t.customer}, normalize=normalize_name,
    )


@query("temporal_relation", """
WITH s AS (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'signup' GROUP BY 1), p AS (SELECT user_id, min(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) AS entities, (count(*) FILTER (a <= b))::DOUBLE / count(*) AS ordered_share FROM s JOIN p USING (user_id)
""")
def temporal_relation(t):
    signups = t.events.filter("event_type = 'signup'").withColumnRenamed("ts", "signup")
    purchases = t.events.filter("event_type = 'purchase'").withColumnRenamed("ts", "purchase")
    return r.temporal_relation(signups, purchases, "user_id", "signup", "purchase")


@query("join_paths", f"""
WITH RECURSIVE k AS ({FOREIGN_KEYS}), e AS (SELECT DISTINCT split_part(child, '.', 1) AS src, split_part(parent, '.', 1) AS dst FROM k UNION SELECT DISTINCT split_part(parent, '.', 1), split_part(child, '.', 1) FROM k),
w(node, depth, path) AS (SELECT 'supplier', 0, 'supplier' UNION ALL SELECT dst, depth + 1, path || '>' || dst FROM w JOIN e ON src = node WHERE depth < 6 AND NOT list_contains(string_split(path, '>'), dst))
SELECT node, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS rn FROM w) WHERE rn = 1
""")
def join_paths(t):
    return r.join_paths(keys(t), "supplier")


EDGES = """
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
"""


def edges(t):
    def link(df, kind_a, a, kind_b, b):
        return df.select(
            F.concat(F.lit(f"{kind_a}:"), F.col(a).cast("string")).alias("src"), F.concat(F.lit(f"{kind_b}:"), F.col(b).cast("string")).alias("dst")
        )

    return analytics.union_tables([
        link(t.nation, "region", "n_regionkey", "nation", "n_nationkey"),
        link(t.supplier, "nation", "s_nationkey", "supplier", "s_suppkey"),
        link(t.customer, "nation", "c_nationkey", "customer", "c_custkey"),
        link(t.lineitem, "supplier", "l_suppkey", "part", "l_partkey"),
    ])


@query("lineage_reach", f"""
WITH RECURSIVE e AS ({EDGES}), w(node, depth) AS (SELECT 'region:1', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node)
SELECT node, min(depth) AS depth FROM w GROUP BY node
""")
def lineage_reach(t):
    starts = t.region.filter("r_regionkey = 1").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return r.reach(edges(t), starts).select("node", "depth")


@query("lineage_reach_far", """
SELECT 'event:' || event_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS depth FROM events
UNION ALL SELECT DISTINCT 'user:' || user_id, 0 FROM events
""")
def lineage_reach_far(t):
    """Chains as long as a user's history: each event comes from the user's event before, the first from the user."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    placed = positions(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], out="pos")
    before = placed.select("user_id", (F.col("pos") + 1).alias("pos"), node("event", "event_id").alias("src"))
    links = placed.join(before, ["user_id", "pos"], "left").select(F.coalesce("src", node("user", "user_id")).alias("src"), node("event", "event_id").alias("dst"))
    return r.reach_far(links, t.events.select(node("user", "user_id").alias("node")).distinct(), paths=False)


@query("connected_groups", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM ({EDGES})), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(node, grp) AS (SELECT src, src FROM b WHERE src LIKE 'region%' UNION SELECT dst, grp FROM w JOIN b ON src = node)
SELECT node, min(least_node) AS grp FROM (SELECT node, min(node) OVER (PARTITION BY grp) AS least_node FROM w) GROUP BY node
""")
def connected_groups(t):
    return r.connected_groups(edges(t))


@query("group_rate_test", """
WITH g AS (SELECT p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS h FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
s AS (SELECT *, (sum(n) OVER ())::BIGINT AS tn, (sum(h) OVER ())::BIGINT AS th FROM g),
z AS (SELECT p_brand, n, h::DOUBLE / n AS rate, (th - h)::DOUBLE / (tn - n) AS rest_rate,
  (h::DOUBLE / n - (th - h)::DOUBLE / (tn - n)) / sqrt(th::DOUBLE / tn * (1 - th::DOUBLE / tn) * (1.0::DOUBLE / n + 1.0::DOUBLE / (tn - n))) AS z FROM s)
SELECT p_brand, n, rate, rest_rate, round(z, 6) AS z, n > 100 AND abs(z) > 1.96 AS significant FROM z
""")
def group_rate_test(t):
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_returnflag")
    return r.group_rate_test(sold, "p_brand", F.col("l_returnflag") == "R").withColumn("z", F.round("z", 6))


RATIO = """
SELECT n_name, n, s::DOUBLE / n AS average, (s::DOUBLE / n) / ((sum(s) OVER ())::DOUBLE / (sum(n) OVER ())::DOUBLE) AS ratio FROM (
 SELECT n_name, count(c_acctbal) AS n, sum(c_acctbal::DECIMAL(18,2)) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
"""


@query("ratio_insight", RATIO)
def ratio_insight(t):
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return r.ratio_to_baseline(placed, "n_name", "c_acctbal")


def engagement(t):
    uses = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("tickets"))
    spend = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    return spend.join(uses, "user_id", "left").withColumn("tickets", F.coalesce("tickets", F.lit(0)))


ENGAGEMENT = """
SELECT o_custkey AS user_id, spend, coalesce(tickets, 0) AS tickets FROM (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend FROM orders GROUP BY 1)
LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'error') AS tickets FROM events GROUP BY 1) ON user_id = o_custkey
"""


@query("engagement_correlation", f"""
SELECT CASE WHEN tickets <= 2 THEN '0-2' WHEN tickets < 5 THEN '3-4' ELSE '5+' END AS band, count(*) AS rows, sum(spend::DECIMAL(18,2))::DOUBLE / count(*) AS average_amount,
  round((SELECT corr(tickets, spend) FROM ({ENGAGEMENT})), 9) AS correlation FROM ({ENGAGEMENT}) GROUP BY 1
""")
def engagement_correlation(t):
    return r.engagement_bands(engagement(t), "tickets", "spend").withColumn("correlation", F.round("correlation", 9))


@query("adoption_gap", """
WITH u AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 150) AS uses, max(ts) < '2024-01-30' AS churned FROM events GROUP BY user_id)
SELECT (count(*) FILTER (uses))::DOUBLE / count(*) AS adoption, (count(*) FILTER (uses AND churned))::DOUBLE / nullif(count(*) FILTER (uses), 0) AS churn_users,
  (count(*) FILTER (NOT uses AND churned))::DOUBLE / nullif(count(*) FILTER (NOT uses), 0) AS churn_others FROM u
""")
def adoption_gap(t):
    users = t.events.groupBy("user_id").agg(
        F.max((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("uses"), F.max("ts").alias("last")
    )
    return r.adoption_gap(users, F.col("uses"), F.col("last") < F.lit("2024-01-30").cast("timestamp_ntz"))


@query("rank_insights", f"""
SELECT n_name, ratio, n / 100.0::DOUBLE AS confidence FROM ({RATIO}) WHERE n / 100.0::DOUBLE > 0.5 + 0.2 ORDER BY ratio DESC, n_name LIMIT 10
""")
def rank_insights(t):
    # The number of customers stands in for the confidence.
    insights = ratio_insight(t).select("n_name", "ratio", (F.col("n") / 100.0).alias("confidence"))
    return r.rank_insights(insights, "confidence", "ratio", "n_name")


_CONTEXT = f"""
SELECT table_name AS "table", rows, '{{"table":"' || table_name || '","rows":' || rows || ',"columns":[' || columns || '],"keys":[' || coalesce(keys, '""') || ']}}' AS context FROM ({ROWS}) JOIN (
 SELECT table_name, string_agg('{{"name":"' || column_name || '","type":"' || type || '"}}', ',' ORDER BY column_index) AS columns,
  string_agg('"' || column_name || '"', ',' ORDER BY column_index) FILTER (regexp_matches(lower(column_name), '(key|id)$')) AS keys FROM ({COLUMNS}) GROUP BY table_name) USING (table_name)
"""


@query("warehouse_context", f"SELECT *, length(context) // 4 AS tokens FROM ({_CONTEXT})")
def warehouse_context(t):
    return r.warehouse_context({name: getattr(t, name) for name in TABLES})
