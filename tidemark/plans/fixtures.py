"""Inputs derived from the given tables, each as a Spark expression and as the same SQL.

All keep every row of their table: sizes follow the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import positions
from tidemark.session import spread

# --- three sources of customer fields -------------------------------------------------------

SOURCES = """
SELECT c_custkey AS entity, field, source, priority,
  CASE WHEN s = 2 AND (c_custkey + f) % 11 = 0 THEN NULL
       WHEN (c_custkey * 3 + f) % 7 = s + 1 THEN raw || '/' || s ELSE raw END AS value,
  (DATE '2024-01-01' + ((c_custkey * (s + 1) + f * 3) % 50)::INTEGER) AS updated
FROM (SELECT c_custkey, f, s,
    CASE f WHEN 0 THEN 'name' WHEN 1 THEN 'email' WHEN 2 THEN 'phone' WHEN 3 THEN 'segment' ELSE 'nation' END AS field,
    CASE s WHEN 0 THEN 'crm' WHEN 1 THEN 'erp' ELSE 'legacy' END AS source,
    CASE WHEN f = 4 THEN 2 ELSE 3 - s END AS priority,
    CASE f WHEN 0 THEN c_name WHEN 1 THEN 'c' || c_custkey || '@example.com' WHEN 2 THEN '555-' || (c_custkey * 17 % 10000)
      WHEN 3 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS raw
  FROM customer, (SELECT unnest(range(5)) AS f), (SELECT unnest(range(3)) AS s))
"""


def sources(t) -> DataFrame:
    cells = spread(t.customer).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    return cells.selectExpr(
        "c_custkey AS entity",
        "element_at(array('name', 'email', 'phone', 'segment', 'nation'), f + 1) AS field",
        "element_at(array('crm', 'erp', 'legacy'), s + 1) AS source",
        "CASE WHEN f = 4 THEN 2 ELSE 3 - s END AS priority",
        "CASE f WHEN 0 THEN c_name WHEN 1 THEN concat('c', c_custkey, '@example.com') "
        "WHEN 2 THEN concat('555-', c_custkey * 17 % 10000) WHEN 3 THEN c_mktsegment ELSE cast(c_nationkey AS string) END AS raw",
        "f", "s",
    ).selectExpr(
        "entity", "field", "source", "priority",
        "CASE WHEN s = 2 AND (entity + f) % 11 = 0 THEN NULL WHEN (entity * 3 + f) % 7 = s + 1 THEN concat(raw, '/', s) ELSE raw END AS value",
        "date_add(date'2024-01-01', cast((entity * (s + 1) + f * 3) % 50 AS int)) AS updated",
    )


# --- a log of value changes ----------------------------------------------------------------

TRANSFORM_LOG = """
SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'dob' WHEN 'click' THEN 'status' ELSE 'phone' END AS field,
  CASE WHEN event_id % 10 = 9 THEN NULL ELSE 'v' || (event_id % 3) END AS old_value,
  CASE WHEN event_id % 2 = 0 THEN ' 2024-1-' || (event_id % 4 + 1) ELSE 'V' || (event_id % 4) END AS new_value,
  event_type AS type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 11) / 10.0::DOUBLE END AS confidence
FROM events
"""


def log_rows(t) -> DataFrame:
    """The change log without positions."""
    return t.events.selectExpr(
        "user_id AS run", "ts", "event_id",
        "CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'dob' WHEN 'click' THEN 'status' ELSE 'phone' END AS field",
        "CASE WHEN event_id % 10 = 9 THEN NULL ELSE concat('v', event_id % 3) END AS old_value",
        "CASE WHEN event_id % 2 = 0 THEN concat(' 2024-1-', event_id % 4 + 1) ELSE concat('V', event_id % 4) END AS new_value",
        "event_type AS type",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(event_id % 11 AS double) / 10 END AS confidence",
    )


def transform_log(t) -> DataFrame:
    """The change log with its position per run."""
    return positions(log_rows(t), ["run"], ["ts", "event_id"], out="seq")


# Realistic value pairs for the gates: most new values restate the old one, some do not.
GATE_LOG = """
SELECT event_id, field, old_value, new_value, confidence, event_id % 7 = 0 OR event_id % 11 = 0 AS invented FROM (
 SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 11) / 10.0::DOUBLE END AS confidence,
  CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'dob' WHEN 'click' THEN 'customer_id' ELSE 'phone' END AS field,
  CASE event_type WHEN 'signup' THEN 'user' || user_id || '@acme.com' WHEN 'purchase' THEN '$' || (user_id + 1000) || '.50'
    WHEN 'error' THEN strftime(DATE '1950-01-01' + (user_id * 37)::INTEGER, '%m/%d/%Y') WHEN 'click' THEN 'CUST' || user_id
    ELSE '555-' || (1000 + user_id % 9000) END AS old_value,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN '555-' || user_id WHEN event_id % 11 = 0 THEN 'other' || user_id || '@acme.com' ELSE 'user' || user_id || '@acme.org' END
    WHEN 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN 'about ' || user_id WHEN event_id % 11 = 0 THEN '' || (user_id + 1000) * 2 ELSE (user_id + 1000) || '.5' END
    WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN '33' WHEN event_id % 11 = 0 THEN '2025-06-30' ELSE strftime(DATE '1950-01-01' + (user_id * 37)::INTEGER, '%Y-%m-%d') END
    WHEN 'click' THEN CASE WHEN event_id % 7 = 0 THEN 'Customer ' || user_id || ' from Seattle' WHEN event_id % 11 = 0 THEN repeat('X', 51) ELSE 'C-' || user_id END
    ELSE CASE WHEN event_id % 7 = 0 THEN 'user' || user_id || '@acme.com' WHEN event_id % 11 = 0 THEN 'none' ELSE '+1 (555) ' || (1000 + user_id % 9000) END END AS new_value
 FROM events)
"""


def gate_log(t) -> DataFrame:
    day = "date_add(date'1950-01-01', cast(user_id * 37 AS int))"
    return t.events.selectExpr(
        "event_id",
        "CASE event_type WHEN 'signup' THEN 'email' WHEN 'purchase' THEN 'price' WHEN 'error' THEN 'dob' WHEN 'click' THEN 'customer_id' ELSE 'phone' END AS field",
        f"CASE event_type WHEN 'signup' THEN concat('user', user_id, '@acme.com') WHEN 'purchase' THEN concat('$', user_id + 1000, '.50') "
        f"WHEN 'error' THEN date_format({day}, 'MM/dd/yyyy') WHEN 'click' THEN concat('CUST', user_id) "
        "ELSE concat('555-', 1000 + user_id % 9000) END AS old_value",
        "CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN concat('555-', user_id) WHEN event_id % 11 = 0 THEN concat('other', user_id, '@acme.com') ELSE concat('user', user_id, '@acme.org') END "
        "WHEN 'purchase' THEN CASE WHEN event_id % 7 = 0 THEN concat('about ', user_id) WHEN event_id % 11 = 0 THEN concat('', (user_id + 1000) * 2) ELSE concat(user_id + 1000, '.5') END "
        f"WHEN 'error' THEN CASE WHEN event_id % 7 = 0 THEN '33' WHEN event_id % 11 = 0 THEN '2025-06-30' ELSE date_format({day}, 'yyyy-MM-dd') END "
        "WHEN 'click' THEN CASE WHEN event_id % 7 = 0 THEN concat('Customer ', user_id, ' from Seattle') WHEN event_id % 11 = 0 THEN repeat('X', 51) ELSE concat('C-', user_id) END "
        "ELSE CASE WHEN event_id % 7 = 0 THEN concat('user', user_id, '@acme.com') WHEN event_id % 11 = 0 THEN 'none' ELSE concat('+1 (555) ', 1000 + user_id % 9000) END END AS new_value",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(event_id % 11 AS double) / 10 END AS confidence",
        "event_id % 7 = 0 OR event_id % 11 = 0 AS invented",
    )


# --- issues found in documents --------------------------------------------------------------

ISSUES = """
SELECT doc_id AS issue, source AS grp,
  CASE doc_id % 5 WHEN 0 THEN 'date_format' WHEN 1 THEN 'missing_value' WHEN 2 THEN 'schema_mismatch' WHEN 3 THEN 'style_warning' ELSE 'invalid_value' END AS issue_type,
  CASE WHEN doc_id % 17 = 0 THEN 'critical' WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity,
  n_chars // 4 AS tokens
FROM documents
"""


def issues(t) -> DataFrame:
    return t.documents.selectExpr(
        "doc_id AS issue", "source AS grp",
        "element_at(array('date_format', 'missing_value', 'schema_mismatch', 'style_warning', 'invalid_value'), cast(doc_id % 5 AS int) + 1) AS issue_type",
        "CASE WHEN doc_id % 17 = 0 THEN 'critical' WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS severity",
        "n_chars div 4 AS tokens",
    )


# --- a catalog of tables and a log of queries on them ---------------------------------------

_BASES = "'user_events', 'customer_retention', 'order_items', 'lookup_region', 'analytics_log', 'transaction_fees', 'web_sessions'"
_TAILS = "'', '_v2', '_v3', '_backup_2020', '_old', '_temp_john', '_quarterly', '_annual', '_archive', '_test'"

CATALOG = f"""
SELECT p_partkey AS table_id, 't' || (p_partkey // 70) || '_' || [{_BASES}][p_partkey % 7 + 1] || [{_TAILS}][p_partkey % 10 + 1] AS table_name,
  p_retailprice / 10 AS size_gb, (DATE '2019-01-01' + (p_partkey * 31 % 2000)::INTEGER) AS created,
  (DATE '2019-01-01' + (p_partkey * 31 % 2000)::INTEGER + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END) AS modified
FROM part
"""


def catalog(t) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS table_id",
        f"concat('t', p_partkey div 70, '_', element_at(array({_BASES}), cast(p_partkey % 7 AS int) + 1), "
        f"element_at(array({_TAILS}), cast(p_partkey % 10 AS int) + 1)) AS table_name",
        "p_retailprice / 10 AS size_gb",
        "date_add(date'2019-01-01', cast(p_partkey * 31 % 2000 AS int)) AS created",
        "date_add(date_add(date'2019-01-01', cast(p_partkey * 31 % 2000 AS int)), CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END) AS modified",
    )


# A statement names the table whose number is event_id * 7 modulo 1499 and joins a second one.
_NAME = "'t' || ({k} // 70) || '_' || [" + _BASES + "][{k} % 7 + 1] || [" + _TAILS + "][{k} % 10 + 1]"
QUERY_LOG = f"""
SELECT event_id AS query_id, ts, user_id, event_type,
  CASE WHEN event_id % 23 = 0 THEN 'DROP TABLE ' || n1 WHEN event_id % 29 = 0 THEN 'SELECT created_at, is_deleted FROM ' || n1
    ELSE 'SELECT email, ' || event_type || ' FROM analytics.' || n1 || ' a JOIN ' || upper(n2) || ' b ON a.id = b.id' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' LIMIT 100' END END AS text,
  round(value * 3000)::BIGINT AS exec_ms, round(value * 1100)::BIGINT AS cpu_ms, round(value * 900)::BIGINT AS spill_blocks,
  ['etl', 'analytics', 'short'][event_id % 3 + 1] AS queue, (event_id * 37 % 90000) AS wait_ms
FROM (SELECT *, {_NAME.format(k="(event_id * 7 % 1499)")} AS n1, {_NAME.format(k="(user_id % 50)")} AS n2 FROM events)
"""


def query_log(t) -> DataFrame:
    def name(k):
        return (f"concat('t', {k} div 70, '_', element_at(array({_BASES}), cast({k} % 7 AS int) + 1), "
                f"element_at(array({_TAILS}), cast({k} % 10 AS int) + 1))")

    named = t.events.selectExpr("*", f"{name('(event_id * 7 % 1499)')} AS n1", f"{name('(user_id % 50)')} AS n2")
    return named.selectExpr(
        "event_id AS query_id", "ts", "user_id", "event_type",
        "CASE WHEN event_id % 23 = 0 THEN concat('DROP TABLE ', n1) WHEN event_id % 29 = 0 THEN concat('SELECT created_at, is_deleted FROM ', n1) "
        "ELSE concat('SELECT email, ', event_type, ' FROM analytics.', n1, ' a JOIN ', upper(n2), ' b ON a.id = b.id', CASE WHEN event_id % 3 = 0 THEN '' ELSE ' LIMIT 100' END) END AS text",
        "cast(round(value * 3000) AS bigint) AS exec_ms", "cast(round(value * 1100) AS bigint) AS cpu_ms",
        "cast(round(value * 900) AS bigint) AS spill_blocks",
        "element_at(array('etl', 'analytics', 'short'), cast(event_id % 3 AS int) + 1) AS queue",
        "event_id * 37 % 90000 AS wait_ms",
    )


# --- columns of two versions of each table ---------------------------------------------------

OLD_COLUMNS = """
SELECT p_partkey AS table_id, name, type FROM part, (VALUES
 ('id','bigint'),('full_name','string'),('email','string'),('cust_id','bigint'),('signup_dt','date'),('zip','string'),('amount','int'),('home_phone','string'),('work_phone','string')) v(name, type)
UNION ALL SELECT p_partkey, p_type || '_' || p_size, 'string' FROM part
"""
NEW_COLUMNS = """
SELECT p_partkey AS table_id, name, type FROM part, (VALUES
 ('id','bigint',0),('first_name','string',0),('last_name','string',0),('email_primary','string',0),('email_secondary','string',0),
 ('customer_id','bigint',0),('signup_date','date',0),('phone','string',0),('amount','bigint',1),('amount','int',2)) v(name, type, rule)
WHERE rule = 0 OR (rule = 1 AND p_partkey % 2 = 0) OR (rule = 2 AND p_partkey % 2 = 1)
UNION ALL SELECT p_partkey, p_type || '_' || p_size, 'string' FROM part WHERE p_partkey % 3 > 0
"""


def _columns(t, listed: list[tuple], last) -> DataFrame:
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(ty).alias("type"), F.lit(r).alias("rule")) for n, ty, r in listed])
    own = F.array(F.struct(F.expr("concat(p_type, '_', p_size)").alias("name"), F.lit("string").alias("type"), F.lit(last).alias("rule")))
    rows = spread(t.part.select("p_partkey", "p_type", "p_size")).select("p_partkey", F.explode(F.concat(options, own)).alias("c")).select(
        F.col("p_partkey").alias("table_id"), "c.*"
    )
    kept = "rule = 0 OR (rule = 1 AND table_id % 2 = 0) OR (rule = 2 AND table_id % 2 = 1) OR (rule = 3 AND table_id % 3 > 0)"
    return rows.filter(kept).select("table_id", "name", "type")


def old_columns(t) -> DataFrame:
    names = [("id", "bigint"), ("full_name", "string"), ("email", "string"), ("cust_id", "bigint"), ("signup_dt", "date"), ("zip", "string"), ("amount", "int"), ("home_phone", "string"), ("work_phone", "string")]
    return _columns(t, [(n, ty, 0) for n, ty in names], 0)


def new_columns(t) -> DataFrame:
    names = [("id", "bigint", 0), ("first_name", "string", 0), ("last_name", "string", 0), ("email_primary", "string", 0),
             ("email_secondary", "string", 0), ("customer_id", "bigint", 0), ("signup_date", "date", 0), ("phone", "string", 0), ("amount", "bigint", 1), ("amount", "int", 2)]
    return _columns(t, names, 3)


# --- network flows, metrics, snapshots -------------------------------------------------------

FLOWS = """
SELECT event_id, ts, '10.0.' || (user_id % 200) || '.' || (user_id // 200) AS src, '10.1.0.' || (event_id % 20) AS dst,
  round(value * 1000)::BIGINT AS bytes, CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action FROM events
"""


def flows(t) -> DataFrame:
    return t.events.selectExpr(
        "event_id", "ts", "concat('10.0.', user_id % 200, '.', user_id div 200) AS src", "concat('10.1.0.', event_id % 20) AS dst",
        "cast(round(value * 1000) AS bigint) AS bytes", "CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action",
    )


SNAPSHOTS = """
SELECT o_orderkey // 3 AS key, o_orderdate AS version_ts, o_orderkey AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
  round(o_totalprice * 100)::BIGINT AS value FROM orders
"""


def snapshots(t) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey div 3 AS key", "o_orderdate AS version_ts", "o_orderkey AS version",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op", "cast(round(o_totalprice * 100) AS bigint) AS value",
    )
