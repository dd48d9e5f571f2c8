"""Log questions and alarms over logs derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import logs as g
from tidemark.plans.fixtures import CATALOG, FLOWS, QUERY_LOG, catalog, flows, query_log
from tidemark.plans.registry import query


@query("top_talkers", f"SELECT src, sum(bytes)::BIGINT AS total_bytes FROM ({FLOWS}) GROUP BY src ORDER BY total_bytes DESC, src LIMIT 10")
def top_talkers(t):
    return g.top_by_sum(flows(t), "src", "bytes", "total_bytes")


@query("rejected_traffic", f"SELECT src, count(*) AS hits FROM ({FLOWS}) WHERE action = 'REJECT' GROUP BY src ORDER BY hits DESC, src LIMIT 10")
def rejected_traffic(t):
    return g.top_by_count(flows(t).filter("action = 'REJECT'"), "src")


@query("slow_queries", f"SELECT query_id, text, exec_ms FROM ({QUERY_LOG}) WHERE exec_ms > 5000 ORDER BY exec_ms DESC, query_id LIMIT 20")
def slow_queries(t):
    return g.slow_queries(query_log(t).select("query_id", "text", "exec_ms"), "exec_ms", "query_id")


@query("error_rate", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bin, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY bin
""")
def error_rate(t):
    return g.per_bin(t.events.filter("event_type = 'error'"), "ts", "5 minutes", errors=F.count(F.lit(1)))


@query("execution_timeline", """
SELECT ts, user_id, event_type FROM events WHERE contains(event_type, 's') ORDER BY ts DESC
""")
def execution_timeline(t):
    return t.events.filter(F.contains("event_type", F.lit("s"))).select("ts", "user_id", "event_type").orderBy(F.col("ts").desc())


@query("generation_progress", """
SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS bin, max(event_id) AS progress FROM events GROUP BY bin
""")
def generation_progress(t):
    return g.per_bin(t.events, "ts", "1 minute", progress=F.max("event_id"))


SERIES = """
SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bin, max(value) AS value FROM events GROUP BY ALL
"""
SPINE = f"""
SELECT s.event_type, s.bin, d.value FROM (SELECT event_type, unnest(generate_series(min(bin), max(bin), INTERVAL 5 MINUTE)) AS bin FROM ({SERIES}) GROUP BY event_type) s
LEFT JOIN ({SERIES}) d ON d.event_type = s.event_type AND d.bin = s.bin
"""


def series(t):
    return g.with_gaps(g.per_bin(t.events, "ts", "5 minutes", ["event_type"], value=F.max("value")), "event_type", "5 minutes")


def alarm_sql(breaching: str, periods: int) -> str:
    return f"""
SELECT event_type, bin, value, breaching, CASE WHEN n < {periods} OR lowest = 0 THEN false WHEN known < {periods} THEN NULL ELSE true END AS alarm FROM (
 SELECT *, count(*) OVER w AS n, min(breaching::INTEGER) OVER w AS lowest, count(breaching) OVER w AS known FROM (SELECT *, {breaching} AS breaching FROM ({SPINE}))
 WINDOW w AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW))
"""


@query("threshold_alarm", alarm_sql("value > 20", 2))
def threshold_alarm(t):
    return g.threshold_alarm(series(t), "event_type", "value", 20, 2)


@query("missing_data_policy", alarm_sql("coalesce(value >= 60, false)", 1))
def missing_data_policy(t):
    return g.threshold_alarm(series(t), "event_type", "value", 60, 1, missing="not_breaching", inclusive=True)


# One metric per event type, scaled to the range of its alarm.
METRICS = {"error": ("CPUUtilization", 2), "view": ("DatabaseConnections", 5), "click": ("PercentageDiskSpaceUsed", 2), "purchase": ("QueryDuration", 500), "signup": ("JobsFailed", 0.01)}


def standing_sql() -> str:
    parts = []
    for name, metric, statistic, threshold, inclusive, periods, missing in g.ALARMS:
        kind, factor = next((k, f) for k, (m, f) in METRICS.items() if m == metric)
        series = f"SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bin, {statistic}(round(value * {factor})) AS value FROM events WHERE event_type = '{kind}' GROUP BY ALL"
        above = f"value {'>=' if inclusive else '>'} {threshold}"
        breaching = f"coalesce({above}, false)" if missing == "not_breaching" else above
        one = alarm_sql(breaching, periods).replace(SERIES, series)
        parts.append(f"SELECT '{name}' AS name, bin, breaching, alarm FROM ({one})")
    return " UNION ALL ".join(parts)


@query("standing_alarms", standing_sql())
def standing_alarms(t):
    names = F.create_map(*[part for k, (m, _) in METRICS.items() for part in (F.lit(k), F.lit(m))])
    factors = F.create_map(*[part for k, (_, f) in METRICS.items() for part in (F.lit(k), F.lit(float(f)))])
    metrics = t.events.select(
        "ts", F.element_at(names, F.col("event_type")).alias("metric"), F.round(F.col("value") * F.element_at(factors, F.col("event_type"))).alias("value")
    )
    return g.standing_alarms(metrics, "ts", "metric", "value")


@query("query_rules", f"""
SELECT query_id, concat_ws(',', CASE WHEN exec_ms > 300000 THEN 'abort_long_queries:abort' END, CASE WHEN cpu_ms > 100000 THEN 'log_high_cpu_queries:log' END,
 CASE WHEN spill_blocks > 100000 THEN 'log_disk_spill:log' END) AS broken FROM ({QUERY_LOG}) WHERE broken <> ''
""")
def query_rules(t):
    broken = g.query_rules(query_log(t), "exec_ms", "cpu_ms", "spill_blocks")
    return broken.select("query_id", F.concat_ws(",", "broken").alias("broken"))


@query("queue_wait", f"""
SELECT queue, count(*) AS queries, sum(wait_ms)::DOUBLE / count(*) AS average_wait_ms, sum(exec_ms)::DOUBLE / count(*) AS average_exec_ms,
  max(wait_ms) AS longest_wait_ms, count(*) FILTER (queue = 'short' AND exec_ms > 60000) AS timeouts FROM ({QUERY_LOG}) GROUP BY queue
""")
def queue_wait(t):
    return g.queue_wait(query_log(t), "queue", "wait_ms", "exec_ms")


@query("spill_report", f"SELECT query_id, spill_blocks FROM ({QUERY_LOG}) WHERE spill_blocks > 0 ORDER BY query_id DESC LIMIT 10")
def spill_report(t):
    return g.spill_report(query_log(t).select("query_id", "spill_blocks"), "spill_blocks", "query_id")


@query("unsorted_report", """
SELECT count(*) AS rows, count(*) FILTER (o_orderdate < p) AS breaks, (count(*) FILTER (o_orderdate < p))::DOUBLE / count(*) AS unsorted,
  (count(*) FILTER (o_orderdate < p))::DOUBLE / count(*) > 0.10 AS resort FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)
""")
def unsorted_report(t):
    return g.unsorted_report(t.orders, "o_orderkey", "o_orderdate", 1000)


@query("storage_cost", f"""
SELECT table_name, size_gb, size_gb * 0.03::DOUBLE * 12 AS cost FROM ({CATALOG})
""")
def storage_cost(t):
    return catalog(t).select("table_name", "size_gb", g.storage_cost(F.col("size_gb"), F.lit(12)).alias("cost"))


@query("retention_filter", """
SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def retention_filter(t):
    as_of = t.events.agg(F.max("ts")).scalar()
    return g.retained(t.events, "ts", as_of, 7).select("event_id", "ts")


@query("skew_report", """
SELECT max(n) AS largest, avg(n) AS average, max(n) / avg(n) AS skew, CASE WHEN max(n) / avg(n) > 1.5 THEN 'HIGH' WHEN max(n) / avg(n) > 1.2 THEN 'MODERATE' ELSE 'OK' END AS status
FROM (SELECT user_id % 7 AS p, count(*) AS n FROM events GROUP BY p)
""")
def skew_report(t):
    return g.skew_report(t.events, "user_id", 7)


@query("row_count_audit", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in
    ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
))
def row_count_audit(t):
    from tidemark.sources.catalog import row_counts

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    return row_counts({n: getattr(t, n) for n in names})


@query("hot_keys", """
SELECT user_id AS key, count(*) AS rows, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM events GROUP BY user_id HAVING count(*)::DOUBLE / (SELECT count(*) FROM events) >= 0.008
""")
def hot_keys(t):
    return g.hot_keys(t.events, "user_id", 0.008)
