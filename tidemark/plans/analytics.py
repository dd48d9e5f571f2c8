"""Warehouse questions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.values import normalize_name, normalize_phone
from tidemark.operators import analytics as a
from tidemark.operators import similarity
from tidemark.operators.ordered import running
from tidemark.plans.generated import MULTI_SOURCE, multi_source
from tidemark.plans.registry import query


@query("parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def parquet_scan(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")


@query("date_range_filter", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-12-31'
""")
def date_range_filter(t):
    return a.date_range(t.orders, "o_orderdate", "1996-01-01", "1997-12-31").select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


@query("point_lookup", f"""
SELECT entity_id, source, first_name, last_name, last_updated FROM ({MULTI_SOURCE}) WHERE entity_id = 'ENT0000000001' ORDER BY last_updated DESC, source
""")
def point_lookup(t):
    found = a.point_lookup(multi_source(t), "entity_id", "ENT0000000001", "last_updated", ["source"])
    return found.select("entity_id", "source", "first_name", "last_name", "last_updated")


@query("peek", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def peek(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(5)


@query("anomaly_predicate", """
SELECT l_orderkey, l_linenumber, l_discount, l_extendedprice FROM lineitem WHERE l_discount = 0 AND l_extendedprice > 100
""")
def anomaly_predicate(t):
    return t.lineitem.filter((F.col("l_discount") == 0) & (F.col("l_extendedprice") > 100)).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_extendedprice"
    )


@query("enrich_left_join", """
SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
""")
def enrich_left_join(t):
    dimension = t.customer.filter(F.col("c_acctbal") >= 0).withColumnRenamed("c_custkey", "o_custkey")
    return a.enrich(t.orders, dimension, "o_custkey", ["c_mktsegment"]).select(
        "o_orderkey", "o_totalprice", "c_mktsegment"
    )


@query("customer_revenue_top100", """
SELECT c_name, c_mktsegment, count(o_orderkey) AS order_count, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= '1996-01-01'
GROUP BY c_name, c_mktsegment ORDER BY revenue DESC, c_name LIMIT 100
""")
def customer_revenue_top100(t):
    recent = a.date_range(t.orders, "o_orderdate", "1996-01-01")
    revenue = a.revenue_through(recent, "o_custkey", "o_totalprice", t.customer, "c_custkey", ["c_name", "c_mktsegment"])
    return a.top_n(revenue, "revenue", ["c_name"], 100)


@query("category_performance", """
SELECT p_type, count(*) AS order_count, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate BETWEEN '1997-01-01' AND '1997-12-31'
GROUP BY p_type ORDER BY revenue DESC
""")
def category_performance(t):
    year = a.date_range(t.lineitem, "l_shipdate", "1997-01-01", "1997-12-31")
    return a.revenue_through(year, "l_partkey", "l_extendedprice", t.part, "p_partkey", ["p_type"]).orderBy(
        F.col("revenue").desc()
    )


AVERAGE_TOTAL = """
SELECT c_mktsegment, count(*) AS members, sum(total)::DOUBLE / count(*) AS average_value
FROM customer JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
GROUP BY c_mktsegment
"""


@query("join_preaggregated", AVERAGE_TOTAL)
def join_preaggregated(t):
    return a.average_total_by(t.orders, "o_custkey", "o_totalprice", t.customer, "c_custkey", "c_mktsegment")


@query("ltv_by_group", f"""
SELECT n_name, count(*) AS members, sum(total)::DOUBLE / count(*) AS average_value
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY n_name
""")
def ltv_by_group(t):
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return a.average_total_by(t.orders, "o_custkey", "o_totalprice", placed, "c_custkey", "n_name")


@query("orphan_rows", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""")
def orphan_rows(t):
    solvent = t.customer.filter(F.col("c_acctbal") >= 0)
    return a.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", solvent, "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query("semantic_key_join", """
SELECT c_name, c_mktsegment, n AS uses FROM customer JOIN
 (SELECT 'customer#' || lpad(user_id::VARCHAR, 9, '0') AS k, count(*) AS n FROM events GROUP BY user_id) ON lower(trim(c_name)) = k
""")
def semantic_key_join(t):
    uses = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("uses")).select(
        F.concat(F.lit(" CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("login"), "uses"
    )
    joined = t.customer.join(uses, normalize_name(F.col("c_name")) == normalize_name(F.col("login")))
    return joined.select("c_name", "c_mktsegment", "uses")


@query("entity_match_similar", """
WITH n AS (SELECT c_custkey AS id, substr(md5(c_custkey::VARCHAR), 1, 16) AS l FROM customer), m AS (SELECT id, l, substr(l, 1, id % 16) || 'x' || substr(l, id % 16 + 2) AS r FROM n),
g AS (SELECT id, list_distinct(list_transform(range(1, len(l) + 3), lambda i: substr('##' || l || '##', i, 3))) AS a, list_distinct(list_transform(range(1, len(r) + 3), lambda i: substr('##' || r || '##', i, 3))) AS b FROM m),
p AS (SELECT x.id AS left_record, y.id AS right_record, len(list_intersect(x.a, y.b)) AS shared, len(x.a) + len(y.b) - len(list_intersect(x.a, y.b)) AS every FROM g AS x, g AS y)
SELECT left_record, right_record, shared::DOUBLE / every AS similarity FROM p WHERE 100 * shared >= 60 * every
QUALIFY row_number() OVER (PARTITION BY left_record ORDER BY shared::DOUBLE / every DESC, right_record) = 1
""")
def entity_match_similar(t):
    """Customers under invented names, and under the same names with one wrong letter."""
    left = t.customer.select(F.col("c_custkey").alias("id"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 16).alias("name"))
    at = (F.col("id") % 16).cast("int")
    right = left.select("id", F.concat(F.substring("name", F.lit(1), at), F.lit("x"), F.substring("name", at + 2, F.lit(16))).alias("name"))
    return similarity.match_similar(left, right, "id", "name", percent=60)


@query("entity_match", f"""
WITH m AS ({MULTI_SOURCE}),
l AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS p, lower(last_name) AS n FROM m WHERE source = 'A'),
r AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS p, lower(last_name) AS n FROM m WHERE source = 'B'),
x AS (SELECT l.record_id AS left_record, r.record_id AS right_record,
  ((l.first_name IS NOT DISTINCT FROM r.first_name)::INTEGER + (l.email IS NOT DISTINCT FROM r.email)::INTEGER) / 2.0::DOUBLE AS score FROM l JOIN r USING (p, n))
SELECT left_record, right_record, score FROM x QUALIFY row_number() OVER (PARTITION BY left_record ORDER BY score DESC, right_record) = 1
""")
def entity_match(t):
    keyed = multi_source(t).withColumns({
        "phone_key": normalize_phone(F.col("phone")), "name_key": normalize_name(F.col("last_name"))
    })
    left, right = keyed.filter("source = 'A'"), keyed.filter("source = 'B'")
    return a.match_to_block(left, right, ["phone_key", "name_key"], "record_id", ["first_name", "email"])


@query("daily_revenue", """
SELECT o_orderdate::DATE AS day, count(*) AS order_count, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1999-12-31' GROUP BY day ORDER BY day
""")
def daily_revenue(t):
    days = a.date_range(t.orders, "o_orderdate", "1996-01-01", "1999-12-31")
    return a.revenue_by(days, [F.col("o_orderdate").cast("date").alias("day")], "o_totalprice").orderBy("day")


@query("segment_revenue", """
SELECT c_mktsegment, count(*) AS order_count, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1997-01-01' GROUP BY c_mktsegment
""")
def segment_revenue(t):
    recent = a.date_range(t.orders, "o_orderdate", "1997-01-01")
    return a.revenue_through(recent, "o_custkey", "o_totalprice", t.customer, "c_custkey", ["c_mktsegment"])


@query("group_count", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def group_count(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


MONTHLY = """
SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue,
  count(DISTINCT o_custkey) AS customers, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS average_amount FROM orders GROUP BY month
"""


@query("monthly_kpis", MONTHLY)
def monthly_kpis(t):
    return a.monthly_kpis(t.orders, "o_orderdate", "o_totalprice", "o_custkey")


@query("period_change", f"""
SELECT month, revenue, revenue - lag(revenue) OVER w AS revenue_change,
  (revenue - lag(revenue) OVER w) * 100.0::DOUBLE / lag(revenue) OVER w AS revenue_change_pct,
  customers, customers - lag(customers) OVER w AS customers_change,
  (customers - lag(customers) OVER w) * 100.0::DOUBLE / lag(customers) OVER w AS customers_change_pct
FROM ({MONTHLY}) WINDOW w AS (ORDER BY month)
""")
def period_change(t):
    return a.period_change(monthly_kpis(t), "month", ["revenue", "customers"])


@query("churn_rate_by_group", """
WITH u AS (SELECT user_id, max(ts) AS last_use FROM events GROUP BY user_id),
c AS (SELECT c_mktsegment, (last_use::DATE - (DATE '2023-12-31' - (c_custkey % 120)::INTEGER)) AS days FROM customer LEFT JOIN u ON user_id = c_custkey)
SELECT c_mktsegment, count(*) AS total_customers, count(*) FILTER (days < 90) AS churned,
  (count(*) FILTER (days < 90))::DOUBLE / count(*) AS churn_rate FROM c GROUP BY c_mktsegment
""")
def churn_rate_by_group(t):
    signed = t.customer.withColumn(
        "signup", F.date_sub(F.lit("2023-12-31").cast("date"), (F.col("c_custkey") % 120).cast("int"))
    )
    return a.churn_rate_by(signed, "c_custkey", "c_mktsegment", "signup", t.events, "user_id", "ts")


@query("churn_reasons", """
SELECT o_orderpriority AS reason, count(*) AS churned_customers, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS average_lost
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
GROUP BY 1 ORDER BY churned_customers DESC
""")
def churn_reasons(t):
    as_of = t.orders.agg(F.max("o_orderdate")).scalar()
    lost = t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderpriority", "reason")
    return a.churn_reasons(lost, "o_orderdate", "reason", "o_totalprice", as_of).orderBy(
        F.col("churned_customers").desc()
    )


@query("share_of_total", """
SELECT event_type, count(*) AS rows, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type
""")
def share_of_total(t):
    return a.share_of_total(t.events, "event_type")


def confusion_sql(source: str, by: str = "") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
SELECT {lead}tp, fp, fn, tn, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1
FROM (SELECT {lead}count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn,
  count(*) FILTER (NOT p AND NOT a) AS tn FROM ({source}){group})"""


@query("confusion_metrics", confusion_sql("SELECT n_chars >= 1000 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)"))
def confusion_metrics(t):
    labelled = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return a.confusion(labelled, F.col("n_chars") >= 1000, F.col("quality") == 1)


@query("bucket_report", """
SELECT CASE WHEN l_discount > 0.08 THEN 'high' WHEN l_discount >= 0.03 THEN 'medium' ELSE 'low' END AS band, count(*) AS rows FROM lineitem GROUP BY 1
""")
def bucket_report(t):
    return a.confidence_bands(t.lineitem, "l_discount", 0.08, 0.03)


@query("top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_n(t):
    return a.top_n(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 20)


@query("latest_record", """
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def latest_record(t):
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return a.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("best_quality_record", f"""
SELECT entity_id, source, email, phone FROM
 (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE source WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END DESC, record_id DESC) AS rn FROM ({MULTI_SOURCE}))
WHERE rn = 1
""")
def best_quality_record(t):
    rank = F.when(F.col("source") == "A", 3).when(F.col("source") == "B", 2).otherwise(1)
    rows = multi_source(t).select("entity_id", rank.alias("rank"), "record_id", "source", "email", "phone")
    return a.latest(rows, ["entity_id"], ["rank", "record_id"]).select("entity_id", "source", "email", "phone")


@query("running_total", """
SELECT o_orderpriority, o_orderkey, cents, sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cents
FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
""")
def running_total(t):
    rows = t.orders.select(
        "o_orderpriority", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )
    summed = running(
        rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], {"running_cents": ("sum", F.col("cents"))}
    )
    return summed.select("o_orderpriority", "o_orderkey", "cents", "running_cents")


@query("union_sources", f"SELECT source, entity_id, email, conflict_type FROM ({MULTI_SOURCE})")
def union_sources(t):
    from tidemark.operators.generators import SOURCE_RULES

    rows = multi_source(t)
    return a.union_tables([rows.filter(F.col("source") == s) for s in SOURCE_RULES]).select(
        "source", "entity_id", "email", "conflict_type"
    )


@query("set_overlap", """
WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT user_id AS k FROM events)
SELECT count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL) AS in_both, count(*) FILTER (r.k IS NULL) AS only_left,
  count(*) FILTER (l.k IS NULL) AS only_right, (count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL))::DOUBLE / count(*) AS jaccard
FROM l FULL JOIN r ON l.k = r.k
""")
def set_overlap(t):
    return a.set_overlap(
        t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k"
    )


@query("cross_table_dedupe", """
SELECT k AS key, min(src) AS first_table, count(DISTINCT src) AS tables FROM
 (SELECT o_orderkey AS k, 'orders' AS src FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem) GROUP BY k
""")
def cross_table_dedupe(t):
    return a.dedupe_across(
        {"orders": t.orders.select(F.col("o_orderkey").alias("key")),
         "lineitem": t.lineitem.select(F.col("l_orderkey").alias("key"))},
        ["key"],
    )


@query("unresolved_tickets", """
SELECT event_id, ts FROM events WHERE event_type = 'error' AND value < 50 AND ts < (SELECT max(ts) FROM events) - INTERVAL 48 HOUR
""")
def unresolved_tickets(t):
    as_of = t.events.agg(F.max("ts")).scalar()
    tickets = t.events.filter("event_type = 'error'").withColumn("closed", F.when(F.col("value") >= 50, F.col("ts")))
    return a.overdue(tickets, "ts", "closed", as_of).select("event_id", "ts")


@query("fulfilment_time", """
SELECT CASE WHEN l_extendedprice > 50000 THEN 'large' WHEN l_extendedprice > 10000 THEN 'medium' ELSE 'small' END AS size_band,
  count(*) AS rows, sum(l_shipdate::DATE - o_orderdate::DATE)::DOUBLE / count(*) AS average
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1
""")
def fulfilment_time(t):
    price = F.col("l_extendedprice")
    shipped = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(
        F.col("l_shipdate") >= F.col("o_orderdate")
    ).select(
        F.when(price > 50000, "large").when(price > 10000, "medium").otherwise("small").alias("size_band"),
        F.datediff("l_shipdate", "o_orderdate").alias("days"),
    )
    return a.average_by(shipped, "size_band", "days")


@query("campaign_rates", """
SELECT p_type, count(*) AS rows, (count(*) FILTER (l_linestatus = 'F'))::DOUBLE / count(*) AS conversion_rate,
  (count(*) FILTER (l_returnflag = 'R'))::DOUBLE / count(*) AS return_rate,
  (sum(l_extendedprice::DECIMAL(18,2)) - sum(p_retailprice::DECIMAL(18,2)))::DOUBLE / sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS roi
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
""")
def campaign_rates(t):
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return a.rates_by(
        sold, "p_type",
        {"conversion": F.col("l_linestatus") == "F", "return": F.col("l_returnflag") == "R"},
        F.col("p_retailprice"), F.col("l_extendedprice"),
    )


@query("conflict_rate_by_type", f"""
SELECT source, conflict_type, count(*) AS rows, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source)::DOUBLE AS share
FROM ({MULTI_SOURCE}) GROUP BY source, conflict_type
""")
def conflict_rate_by_type(t):
    from tidemark.operators.conflicts import rate_by_type

    return rate_by_type(multi_source(t))
