"""Generators run over the ids of the given tables, so their size follows the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.rules import pick
from tidemark.operators import generators as g
from tidemark.plans.registry import query


def customer_ids(t):
    return t.customer.select(F.col("c_custkey").alias("id"))


def order_ids(t):
    return t.orders.select(F.col("o_orderkey").alias("id"))


def as_double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


CUSTOMERS = """
SELECT 'CUST' || lpad(id::VARCHAR, 10, '0') AS customer_id,
  (CASE id % 5 WHEN 0 THEN 'Advanced' WHEN 1 THEN 'Global' WHEN 2 THEN 'Premier' WHEN 3 THEN 'United' ELSE 'National' END)
    || ' ' || (CASE industry WHEN 'Technology' THEN 'Tech' WHEN 'Finance' THEN 'Financial' WHEN 'Healthcare' THEN 'Health' ELSE industry END)
    || ' Solutions' AS company_name,
  segment, industry,
  CASE segment WHEN 'Enterprise' THEN 500 + id * 37 % 9500 WHEN 'Mid-Market' THEN 50 + id * 31 % 450 ELSE 1 + id * 23 % 49 END AS num_employees,
  annual_revenue,
  (annual_revenue * (150 + id % 100) / 1000.0)::DOUBLE AS lifetime_value,
  region,
  CASE region
    WHEN 'Northeast' THEN CASE WHEN id % 10 < 4 THEN 'NY' WHEN id % 10 < 7 THEN 'MA' WHEN id % 10 < 9 THEN 'PA' ELSE 'NJ' END
    WHEN 'West' THEN CASE WHEN id % 10 < 5 THEN 'CA' WHEN id % 10 < 8 THEN 'WA' ELSE 'OR' END
    WHEN 'South' THEN CASE WHEN id % 10 < 4 THEN 'TX' WHEN id % 10 < 7 THEN 'FL' ELSE 'GA' END
    ELSE CASE WHEN id % 10 < 5 THEN 'IL' WHEN id % 10 < 8 THEN 'OH' ELSE 'MI' END END AS state,
  CASE WHEN id % 100 < 85 THEN 'Active' WHEN id % 100 < 95 THEN 'Inactive' ELSE 'Churned' END AS status,
  (CASE WHEN id % 100 < 40 THEN DATE '2024-01-01' WHEN id % 100 < 70 THEN DATE '2023-01-01'
        WHEN id % 100 < 90 THEN DATE '2022-01-01' ELSE DATE '2021-01-01' END - (id % 365)::INTEGER) AS created_at
FROM (SELECT *,
  CASE segment WHEN 'Enterprise' THEN 10000000 + id * 47 % 490000000 WHEN 'Mid-Market' THEN 1000000 + id * 41 % 49000000
       ELSE 100000 + id * 29 % 4900000 END AS annual_revenue
  FROM (SELECT c_custkey AS id,
    CASE WHEN c_custkey % 100 < 15 THEN 'Enterprise' WHEN c_custkey % 100 < 50 THEN 'Mid-Market' ELSE 'SMB' END AS segment,
    CASE WHEN c_custkey % 100 < 30 THEN 'Technology' WHEN c_custkey % 100 < 55 THEN 'Finance' WHEN c_custkey % 100 < 75 THEN 'Healthcare'
         WHEN c_custkey % 100 < 85 THEN 'Retail' WHEN c_custkey % 100 < 92 THEN 'Manufacturing' ELSE 'Other' END AS industry,
    CASE WHEN c_custkey % 100 < 25 THEN 'Northeast' WHEN c_custkey % 100 < 48 THEN 'West' WHEN c_custkey % 100 < 78 THEN 'South' ELSE 'Midwest' END AS region
    FROM customer))
"""


@query("range_source", """
SELECT k AS id FROM (SELECT count(*) AS n FROM customer), LATERAL (SELECT unnest(range(n)) AS k)
""")
def range_source(t):
    return g.ids(t.spark, t.customer.count(), parts=8)


@query("gen_customers", CUSTOMERS)
def gen_customers(t):
    return as_double(g.customers(customer_ids(t)), "lifetime_value")


@query("gen_products", """
SELECT 'PROD' || lpad(id::VARCHAR, 8, '0') AS product_id, category || ' Edition ' || (id % 10 + 1) AS product_name,
  category, unit_price, floor(100000 / (unit_price / 100 + 1))::INTEGER AS inventory_quantity
FROM (SELECT *, CASE category WHEN 'Software' THEN 99 + id * 17 % 9901 WHEN 'Hardware' THEN 299 + id * 19 % 49701
    WHEN 'Services' THEN 500 + id * 23 % 99500 WHEN 'Training' THEN 199 + id * 13 % 9801 ELSE 1000 + id * 29 % 49000 END AS unit_price
  FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 100 < 35 THEN 'Software' WHEN p_partkey % 100 < 60 THEN 'Hardware'
    WHEN p_partkey % 100 < 80 THEN 'Services' WHEN p_partkey % 100 < 92 THEN 'Training' ELSE 'Consulting' END AS category FROM part))
""")
def gen_products(t):
    return g.products(t.part.select(F.col("p_partkey").alias("id")))


@query("gen_orders", f"""
WITH c AS ({CUSTOMERS}),
o AS (SELECT o_orderkey AS id,
    'CUST' || lpad((CASE WHEN o_orderkey % 100 < 40 THEN o_orderkey % 15000 WHEN o_orderkey % 100 < 75 THEN 15000 + o_orderkey % 35000
      ELSE 50000 + o_orderkey % 50000 END)::VARCHAR, 10, '0') AS customer_id,
    CASE WHEN o_orderkey % 100 < 35 THEN 10 + o_orderkey % 3 ELSE 1 + o_orderkey % 9 END AS month,
    CASE WHEN o_orderkey % 100 < 70 THEN 9 + o_orderkey % 9 ELSE o_orderkey % 24 END AS hour
  FROM orders),
p AS (SELECT o.*, make_date(2024, month, 1 + id % 28) AS order_date,
    (CASE segment WHEN 'Enterprise' THEN 5000 + id * 37 % 95000 WHEN 'Mid-Market' THEN 1000 + id * 31 % 19000 ELSE 100 + id * 23 % 4900 END)
      * (CASE WHEN month >= 10 THEN 108 ELSE 100 END) AS cents,
    CASE WHEN id % 100 < 90 THEN 'Completed' WHEN id % 100 < 97 THEN 'Processing' ELSE 'Cancelled' END AS status
  FROM o LEFT JOIN c USING (customer_id))
SELECT 'ORD' || lpad(id::VARCHAR, 12, '0') AS order_id, customer_id, order_date,
  order_date::TIMESTAMP + to_hours(hour) AS order_timestamp, cents / 100.0 AS order_amount, status,
  CASE status WHEN 'Completed' THEN CASE WHEN cents > 5000000 THEN 5 + id % 10 WHEN cents > 1000000 THEN 3 + id % 7 ELSE 1 + id % 5 END
    WHEN 'Cancelled' THEN 0 END AS days_to_fulfill
FROM p
""")
def gen_orders(t):
    made = g.orders(order_ids(t), g.customers(customer_ids(t)))
    return as_double(made, "order_amount").withColumn("order_timestamp", F.col("order_timestamp").cast("timestamp_ntz"))


ENTITIES = """
SELECT id, 'ENT' || lpad(id::VARCHAR, 10, '0') AS entity_id, first_name, last_name,
  lower(first_name || '.' || last_name || '.@company.com') AS email,
  '555-' || lpad((id * 17 % 1000)::VARCHAR, 3, '0') || '-' || lpad((id * 23 % 10000)::VARCHAR, 4, '0') AS phone,
  50000 + id * 37 % 950000 AS annual_revenue, 10 + id * 13 % 990 AS employee_count, created_date,
  (created_date + (id * 11 % 365)::INTEGER) AS last_updated
FROM (SELECT c_custkey AS id,
  ['James','Mary','John','Patricia','Robert','Jennifer','Michael','Linda','William','Elizabeth'][c_custkey % 10 + 1] AS first_name,
  ['Smith','Johnson','Williams','Brown','Jones','Garcia','Miller','Davis','Rodriguez','Martinez'][c_custkey % 10 + 1] AS last_name,
  (DATE '2020-01-01' + (c_custkey * 7 % 1460)::INTEGER) AS created_date FROM customer)
"""


@query("gen_entities", f"SELECT * EXCLUDE (id) FROM ({ENTITIES})")
def gen_entities(t):
    return g.entities(customer_ids(t))


# Gate and kind as arithmetic on the entity number, which SQL can state too (the default is a hash).
GATE = "(id * 7919 % 101 + id * 31 % 100)"
KIND = "(id * 104729 % 1009 + id)"


def _conflict_columns(source: str, accuracy: int, behind: int, limit: int, skipped: int | None) -> str:
    a, b = source == "A", source == "B"
    first = "left(first_name, 1)" if a else "upper(first_name)" if b else "first_name"
    last = "last_name" if a else "upper(last_name)" if b else "lower(last_name)"
    email = "replace(email, '@company.com', '@company.org')" if a else "upper(email)" if b else "email"
    phone = "replace(phone, '-', '.')" if a else "replace(phone, '-', '')" if b else "phone"
    revenue = "annual_revenue * 1.05" if a else "annual_revenue * 0.95" if b else "annual_revenue"
    staff = "employee_count + 5" if a else "employee_count - 3" if b else "employee_count"
    style = "%m/%d/%Y" if a else "%d-%m-%Y" if b else "%Y-%m-%d"
    where = f"id % 100 < {limit}" + (f" AND id % {skipped} <> 0" if skipped else "")
    return f"""
SELECT md5('{source}-' || entity_id || '-' || updated::VARCHAR) AS record_id, '{source}' AS source,
  '{source}-' || entity_id AS source_system_id, entity_id,
  CASE WHEN conflict_type = 'name' THEN {first} ELSE first_name END AS first_name,
  CASE WHEN conflict_type = 'name' THEN {last} ELSE last_name END AS last_name,
  CASE WHEN conflict_type = 'other' THEN {email} ELSE email END AS email,
  CASE WHEN conflict_type = 'other' THEN {phone} ELSE phone END AS phone,
  (CASE WHEN conflict_type = 'measure' THEN {revenue} ELSE annual_revenue END)::DECIMAL(18, 2)::DOUBLE AS annual_revenue,
  CASE WHEN conflict_type = 'measure' THEN {staff} ELSE employee_count END AS employee_count, created_date,
  CASE WHEN conflict_type = 'date' THEN strftime(created_date, '{style}') ELSE strftime(created_date, '%Y-%m-%d') END AS created_date_str,
  updated AS last_updated, has_conflict, conflict_type
FROM (SELECT *, CASE WHEN NOT has_conflict THEN 'none' WHEN kind < 4 THEN 'name' WHEN kind < 7 THEN 'measure' WHEN kind < 9 THEN 'date' ELSE 'other' END AS conflict_type
  FROM (SELECT *, {GATE} % 100 >= {accuracy} AS has_conflict, {KIND} % 10 AS kind, (last_updated + {behind})::DATE AS updated FROM ({ENTITIES}) WHERE {where}))
"""


MULTI_SOURCE = " UNION ALL ".join([
    _conflict_columns("A", 95, 0, 80, None),
    _conflict_columns("B", 90, 5, 70, 3),
    _conflict_columns("C", 85, 10, 60, 5),
])


def multi_source(t):
    """The three generated sources, with the arithmetic gate and kind."""
    number = "cast(substring(entity_id, 4) as bigint)"
    gate = F.expr(GATE.replace("id", number))
    kind = F.expr(KIND.replace("id", number))
    parts = g.multi_source(customer_ids(t), gate, kind)
    return parts["A"].unionByName(parts["B"]).unionByName(parts["C"])


@query("inject_source_conflicts", MULTI_SOURCE)
def inject_source_conflicts(t):
    return as_double(multi_source(t), "annual_revenue")


@query("source_coverage", """
SELECT 'A' AS source, count(*) FILTER (c_custkey % 100 < 80) AS covered, count(*) AS entities FROM customer
UNION ALL SELECT 'B', count(*) FILTER (c_custkey % 100 < 70 AND c_custkey % 3 <> 0), count(*) FROM customer
UNION ALL SELECT 'C', count(*) FILTER (c_custkey % 100 < 60 AND c_custkey % 5 <> 0), count(*) FROM customer
""")
def source_coverage(t):
    ids = customer_ids(t)
    total = ids.agg(F.count(F.lit(1)).alias("entities"))
    parts = None
    for source in g.SOURCE_RULES:
        one = g.source_coverage(ids, source).agg(F.count(F.lit(1)).alias("covered")).select(
            F.lit(source).alias("source"), "covered"
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("entities", total.scalar())


@query("gen_multi_source_basic", """
WITH n AS (SELECT count(*) AS n FROM customer),
ids AS (SELECT c_custkey AS id, n FROM customer, n UNION ALL SELECT c_custkey + n, n FROM customer, n),
s AS (SELECT * FROM (VALUES ('source_a','sourceA.com',30,'active'),('source_b','sourceB.com',35,'inactive'),('source_c','sourceC.com',40,'pending')) v(source, domain, age, status))
SELECT id, 'entity_' || (id % n) AS entity_id, source, md5('row-' || source || '-' || id) AS record_id,
  TIMESTAMP '2024-01-01' + to_seconds(id % 86400) AS timestamp, 'entity_' || (id % n) || '@' || domain AS email,
  age + id % 40 AS age, status
FROM ids, s
""")
def gen_multi_source_basic(t):
    n = t.customer.count()
    return g.multi_source_basic(g.ids(t.spark, 2 * n), n)


@query("gen_wide_baseline", """
SELECT o_orderkey AS id, md5('row-' || o_orderkey) AS record_id, 'entity_' || (o_orderkey % 1000000) AS entity_id,
  TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 31536000) AS timestamp,
  (o_orderkey * 1 % 10000) / 10.0 AS field_001, (o_orderkey + 2) % 2 = 0 AS field_002, 'value_' || ((o_orderkey + 3) % 1000) AS field_003,
  (o_orderkey * 199 % 10000) / 10.0 AS field_199, (o_orderkey + 200) % 2 = 0 AS field_200, 'value_' || ((o_orderkey + 201) % 1000) AS field_201,
  'value_' || ((o_orderkey + 399) % 1000) AS field_399, (o_orderkey * 400 % 10000) / 10.0 AS field_400
FROM orders
""")
def gen_wide_baseline(t):
    wide = g.wide_baseline(order_ids(t))
    numbers = {n: F.col(n).cast("double") for n in ("field_001", "field_199", "field_400")}
    shown = ["field_001", "field_002", "field_003", "field_199", "field_200", "field_201", "field_399", "field_400"]
    return wide.withColumns(numbers).select("id", "record_id", "entity_id", "timestamp", *shown)


_DRAW = "(o_orderkey * 7919 % 1000000)"


@query("seasonal_weights", f"""
WITH w(month, weight) AS (VALUES (1,1.05),(2,1.00),(3,1.10),(4,0.95),(5,0.90),(6,0.85),(7,0.80),(8,0.88),(9,1.05),(10,1.15),(11,1.20),(12,1.25)),
b AS (SELECT month, round(sum(weight) OVER (ORDER BY month)::DOUBLE / (SELECT sum(weight)::DOUBLE FROM w) * 1000000)::BIGINT AS upper FROM w),
d AS (SELECT {_DRAW} AS draw FROM orders)
SELECT (SELECT min(month) FROM b WHERE draw < upper) AS month, count(*) AS orders FROM d GROUP BY 1
""")
def seasonal_weights(t):
    month = g.weighted_choice(F.expr(_DRAW), {m + 1: w for m, w in enumerate(g.MONTH_WEIGHTS)})
    return t.orders.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("orders"))


@query("multi_factor_amount", """
SELECT o_orderkey, greatest(5000.0, base * (bf * cf * qf)) AS amount FROM (
 SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 45000 WHEN 1 THEN 38000 WHEN 2 THEN 28000 ELSE 22000 END + o_orderkey % 1000 AS base,
  CASE o_custkey % 3 WHEN 0 THEN 1.2::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS bf,
  CASE o_orderkey % 3 WHEN 0 THEN 1.15::DOUBLE WHEN 1 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS cf,
  CASE WHEN month(o_orderdate) >= 10 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END AS qf FROM orders)
""")
def multi_factor_amount(t):
    kinds = list(g.DEAL_BASE)
    deal = pick(kinds, F.col("o_orderkey"))
    base = g.keyed(deal, g.DEAL_BASE) + F.col("o_orderkey") % 1000
    brand = pick(["Brand_A", "Brand_B", "Brand_C"], F.col("o_custkey"))
    channel = pick(["In-Person", "Online", "Hybrid"], F.col("o_orderkey"))
    return t.orders.select("o_orderkey", g.deal_amount(base, brand, channel, F.month("o_orderdate")).alias("amount"))


_DELAYS = {"appointment": "o_orderkey % 3", "qualified": "o_orderkey % 7 - 1", "presentation": "o_orderkey % 13",
           "decision": "o_orderkey % 19", "contract": "o_orderkey % 11", "closed": "o_orderkey % 17"}


def stages(t):
    dates = g.stage_dates(
        F.col("o_orderdate").cast("date"), [F.expr(d) for d in _DELAYS.values()], F.col("o_custkey") % 6
    )
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 6).alias("stage"), *[c.alias(n) for n, c in dates.items()])


def stages_sql() -> str:
    total, out = "0", []
    for index, (stage, delay) in enumerate(_DELAYS.items()):
        total += f" + greatest({delay}, 0)"
        out.append(f"CASE WHEN o_custkey % 6 >= {index} THEN o_orderdate::DATE + ({total})::INTEGER END AS {stage}_date")
    return "SELECT o_orderkey, o_custkey % 6 AS stage, " + ", ".join(out) + " FROM orders"


@query("stage_progression", stages_sql())
def stage_progression(t):
    return stages(t)


@query("correlated_attributes", """
SELECT o_orderkey, status, point AS grade_point,
  CASE status WHEN 'Dropped' THEN 'F' WHEN 'In Progress' THEN 'IP' ELSE CASE WHEN point < 2.5 THEN 'C' WHEN point < 3.5 THEN 'B' ELSE 'A' END END AS letter_grade,
  round((CASE WHEN status = 'Dropped' THEN draw * 0.5::DOUBLE / 100 ELSE 0.8::DOUBLE + draw * 0.2::DOUBLE / 100 END)::DECIMAL(10, 4), 2)::DOUBLE AS attendance
FROM (SELECT *, CASE WHEN status IN ('Dropped', 'In Progress') THEN 0.0::DOUBLE ELSE 2.0::DOUBLE + draw * 2.0::DOUBLE / 100 END AS point
 FROM (SELECT o_orderkey, o_orderkey * 37 % 101 AS draw,
   CASE WHEN o_orderkey % 100 < 3 THEN 'Dropped' WHEN o_orderstatus = 'O' THEN 'In Progress' ELSE 'Completed' END AS status FROM orders))
""")
def correlated_attributes(t):
    status = F.expr("CASE WHEN o_orderkey % 100 < 3 THEN 'Dropped' WHEN o_orderstatus = 'O' THEN 'In Progress' ELSE 'Completed' END")
    point, letter, attendance = g.performance(F.col("status"), F.col("o_orderkey") * 37 % 101)
    return t.orders.withColumn("status", status).select(
        "o_orderkey", "status", point.alias("grade_point"), letter.alias("letter_grade"), attendance.alias("attendance")
    )


@query("conditional_nulls", """
SELECT o_orderkey, CASE WHEN closed THEN days END AS days_to_close, CASE WHEN closed THEN o_orderdate::DATE + days::INTEGER END AS close_date,
  CASE WHEN closed AND won THEN 'Price' END AS won_reason, CASE WHEN closed AND NOT won THEN 'Timing' END AS lost_reason
FROM (SELECT *, o_orderstatus <> 'O' AS closed, o_orderstatus = 'F' AS won, greatest(o_orderkey % 60 - 5, 1)::INTEGER AS days FROM orders)
""")
def conditional_nulls(t):
    fields = g.closing_fields(
        F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"),
        F.col("o_orderkey") % 60 - 5, F.lit("Price"), F.lit("Timing"),
    )
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in fields.items()])


_COURSES = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Business' ELSE 'Engineering' END AS major,
  CASE p_partkey % 3 WHEN 0 THEN 'CSC' WHEN 1 THEN 'BUS' ELSE 'ENG' END || ((p_size % 3 + 1) * 100 + p_partkey % 100) AS course_id,
  (2020 + p_size % 5) || '-' || CASE WHEN p_partkey % 2 = 0 THEN '01' ELSE '02' END AS term, p_type = 'PROMO' AS is_core FROM part"""


def courses(t):
    major = pick(["Computer Science", "Business", "Engineering"], F.col("p_partkey"))
    semester = F.when(F.col("p_partkey") % 2 == 0, "Fall").otherwise("Spring")
    return t.part.withColumn("major", major).select(
        "p_partkey",
        "major",
        g.course_code(F.col("major"), F.col("p_size") % 3 + 1, F.col("p_partkey") % 100).alias("course_id"),
        g.term_code(2020 + F.col("p_size") % 5, semester).alias("term"),
        (F.col("p_type") == "PROMO").alias("is_core"),
    )


@query("semantic_codes", _COURSES)
def semantic_codes(t):
    return courses(t)


@query("child_rows_by_rule", f"""
WITH c AS (SELECT DISTINCT major, course_id, is_core FROM ({_COURSES})),
d AS (SELECT major, course_id, bool_or(is_core) AS is_core FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY major ORDER BY is_core DESC, course_id) AS course_rank FROM d)
SELECT c_custkey AS student_id, major, course_id, is_core, course_rank::INTEGER AS course_rank
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Business' ELSE 'Engineering' END AS major FROM customer)
JOIN r USING (major) WHERE course_rank <= 2
""")
def child_rows_by_rule(t):
    listed = courses(t).groupBy("major", "course_id").agg(F.max("is_core").alias("is_core"))
    major = pick(["Computer Science", "Business", "Engineering"], F.col("c_custkey"))
    students = t.customer.select(F.col("c_custkey").alias("student_id"), major.alias("major"))
    return g.first_courses(students, listed)
