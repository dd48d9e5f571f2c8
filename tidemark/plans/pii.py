"""Personal data in the given tables and in contact records derived from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analytics
from tidemark.operators import pii as p
from tidemark.plans.analytics import confusion_sql
from tidemark.plans.fixtures import NEW_COLUMNS, OLD_COLUMNS, new_columns, old_columns
from tidemark.plans.registry import query
from tidemark.session import spread
from tidemark.sources.files import column_sample

AS_OF = "2024-06-01"

# One contact record per customer: every column holds one kind of value, with some gaps and noise.
CONTACTS = """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'none' ELSE 'user' || c_custkey || '@example.com' END AS email,
  '555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') AS contact,
  lpad((c_custkey % 900 + 100)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 9000 + 1000)::VARCHAR, 4, '0') AS tax_code,
  '4111 1111 1111 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS payment, '10.0.' || (c_custkey % 250) || '.' || (c_custkey % 199) AS origin,
  '{"user": "user' || c_custkey || '@example.com", "action": "login"}' AS request_params, strftime(DATE '1950-01-01' + (c_custkey * 13 % 18000)::INTEGER, '%Y-%m-%d') AS field_123,
  'uid_' || lpad(c_custkey::VARCHAR, 10, '0') AS crm_user_id, 'zone ' || c_nationkey AS zip_area, 'note ' || c_mktsegment AS remark
FROM customer
"""
CONTACT_COLUMNS = ["email", "contact", "tax_code", "payment", "origin", "request_params", "field_123", "crm_user_id", "zip_area", "remark"]
CONTACT_TRUTH = {
    "email": "EMAIL", "contact": "PHONE", "tax_code": "SSN", "payment": "CREDIT_CARD", "origin": "IP_ADDRESS", "request_params": "EMAIL",
    "field_123": "DATE_OF_BIRTH", "crm_user_id": "USER_ID", "zip_area": "NONE", "remark": "NONE",
}


def contacts(t):
    return spread(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")).selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'none' ELSE concat('user', c_custkey, '@example.com') END AS email",
        "concat('555-', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '-', lpad(cast(c_custkey * 7 % 10000 AS string), 4, '0')) AS contact",
        "concat(c_custkey % 900 + 100, '-', c_custkey % 90 + 10, '-', c_custkey % 9000 + 1000) AS tax_code",
        "concat('4111 1111 1111 ', lpad(cast(c_custkey % 10000 AS string), 4, '0')) AS payment",
        "concat('10.0.', c_custkey % 250, '.', c_custkey % 199) AS origin",
        "concat('{\"user\": \"user', c_custkey, '@example.com\", \"action\": \"login\"}') AS request_params",
        "date_format(date_add(date'1950-01-01', cast(c_custkey * 13 % 18000 AS int)), 'yyyy-MM-dd') AS field_123",
        "concat('uid_', lpad(cast(c_custkey AS string), 10, '0')) AS crm_user_id",
        "concat('zone ', c_nationkey) AS zip_area",
        "concat('note ', c_mktsegment) AS remark",
    )


#: Every text column of the given tables.
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def scanned(t):
    return {"contacts": (contacts(t), CONTACT_COLUMNS), **{name: (getattr(t, name), columns) for name, columns in TEXT_COLUMNS.items()}}


def _tables_sql() -> dict:
    return {"contacts": (f"({CONTACTS})", CONTACT_COLUMNS), **{name: (name, columns) for name, columns in TEXT_COLUMNS.items()}}


def _scan_sql() -> str:
    parts = []
    for table, (source, columns) in _tables_sql().items():
        for c in columns:
            counts = ", ".join(f"count(*) FILTER (regexp_matches({c}, '{pattern}')) AS {kind}" for kind, (pattern, _) in p.VALUE_PATTERNS.items())
            parts.append(f"""SELECT '{table}' AS tbl, '{c}' AS col, count({c}) AS n, {counts}, count(*) FILTER (regexp_matches({c}, '{p.EMBEDDED_EMAIL}')) AS IN_TEXT,
 count(*) FILTER (length({c}) = 10 AND date_diff('year', TRY_CAST({c} AS DATE), DATE '{AS_OF}') - CASE WHEN strftime(TRY_CAST({c} AS DATE), '%m%d') > '0601' THEN 1 ELSE 0 END BETWEEN 18 AND 80) AS DATE_OF_BIRTH,
 count(*) FILTER (length({c}) = 14 AND regexp_matches({c}, '{p.USER_ID_VALUE}')) AS USER_ID FROM {source}""")
    return " UNION ALL ".join(parts)


def _case(what: int) -> str:
    lines = [f"WHEN {k} > 0.5 * n THEN " + (f"'{k}'", str(c), k)[what] for k, (_, c) in p.VALUE_PATTERNS.items()]
    lines.append("WHEN USER_ID > 0.5 * n AND regexp_matches(col, '^uid_|_user_id$') THEN " + ("'USER_ID'", "0.9", "USER_ID")[what])
    lines.append("WHEN IN_TEXT > 0.5 * n THEN " + ("'EMAIL'", "0.85", "IN_TEXT")[what])
    lines.append("WHEN DATE_OF_BIRTH > 0.5 * n THEN " + ("'DATE_OF_BIRTH'", "0.75", "DATE_OF_BIRTH")[what])
    return "CASE " + " ".join(lines) + " END"


BY_VALUES = f"""SELECT tbl AS "table", col AS "column", {_case(0)} AS value_type, coalesce({_case(1)}, 0.0)::DOUBLE AS value_confidence, {_case(2)} || '/' || n AS reason FROM ({_scan_sql()})"""


@query("pii_by_values", BY_VALUES)
def pii_by_values(t):
    return p.by_values(p.scan_tables(scanned(t), AS_OF))


def _name_case(column: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in p.NAME_WORDS
    )
    return f"CASE {whens} END"


_COLUMN_CATALOG = f"SELECT 'v1' AS version, * FROM ({OLD_COLUMNS}) UNION ALL SELECT 'v2', * FROM ({NEW_COLUMNS})"


@query("pii_by_column_name", f"""
SELECT version, table_id, name, {_name_case('name')} AS name_type, CASE WHEN {_name_case('name')} IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS name_confidence FROM ({_COLUMN_CATALOG})
""")
def pii_by_column_name(t):
    columns = old_columns(t).select(F.lit("v1").alias("version"), "*").unionByName(new_columns(t).select(F.lit("v2").alias("version"), "*"))
    return p.by_column_name(columns, "name").select("version", "table_id", "name", "name_type", "name_confidence")


CLASSIFIED = f"""
SELECT "table", "column", CASE WHEN v THEN value_type ELSE nt END AS pii_type, CASE WHEN v THEN value_confidence ELSE nc END AS confidence,
  CASE WHEN v THEN reason ELSE 'Column name ''' || "column" || ''' suggests ' || nt END AS reason, CASE WHEN v THEN value_confidence ELSE nc END >= 0.5 AS contains_pii
FROM (SELECT *, value_confidence >= 0.8 OR (nc < 0.8 AND value_confidence >= nc) AS v FROM (SELECT *, {_name_case('"column"')} AS nt,
 CASE WHEN {_name_case('"column"')} IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS nc FROM ({BY_VALUES})))
"""


@query("pii_classify", CLASSIFIED)
def pii_classify(t):
    return p.classify(pii_by_values(t))


@query("pii_catalog", f"""
SELECT pii_type, count(*) AS fields, count(DISTINCT "table") AS tables FROM ({CLASSIFIED}) WHERE contains_pii GROUP BY pii_type
""")
def pii_catalog(t):
    return p.catalog_summary(pii_classify(t))


@query("pii_in_json", rf"""
SELECT c_custkey, regexp_matches(request_params, '{p.EMBEDDED_EMAIL}') AS has_email, json_extract_string(request_params, '$.user') AS found FROM ({CONTACTS})
""")
def pii_in_json(t):
    return contacts(t).select(
        "c_custkey",
        F.col("request_params").rlike(p.EMBEDDED_EMAIL).alias("has_email"),
        F.get_json_object("request_params", "$.user").alias("found"),
    )


@query("dob_inference", f"""SELECT "column", value_type, value_confidence, reason FROM ({BY_VALUES}) WHERE value_type = 'DATE_OF_BIRTH'""")
def dob_inference(t):
    return pii_by_values(t).filter("value_type = 'DATE_OF_BIRTH'").select("column", "value_type", "value_confidence", "reason")


@query("company_id_rule", f"""SELECT "table", "column", value_confidence FROM ({BY_VALUES}) WHERE value_type = 'USER_ID'""")
def company_id_rule(t):
    return pii_by_values(t).filter("value_type = 'USER_ID'").select("table", "column", "value_confidence")


_TRUTH = ", ".join(f"('{c}', '{k}')" for c, k in CONTACT_TRUTH.items())


@query("pii_accuracy", confusion_sql(f"""
SELECT truth, contains_pii AND pii_type = truth AS p, truth <> 'NONE' AS a FROM ({CLASSIFIED}) JOIN (VALUES {_TRUTH}) v(col, truth) ON col = "column" WHERE "table" = 'contacts'
""", by="truth"))
def pii_accuracy(t):
    pairs = [part for c, k in CONTACT_TRUTH.items() for part in (F.lit(c), F.lit(k))]
    truth = F.element_at(F.create_map(*pairs), F.col("column"))
    rows = pii_classify(t).filter(F.col("table") == "contacts").withColumn("truth", truth)
    return analytics.confusion(rows, F.col("contains_pii") & (F.col("pii_type") == F.col("truth")), F.col("truth") != "NONE", ["truth"])


def subject(t):
    """The address of the customer with the most orders."""
    most = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(1)
    return most.select(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).scalar()


SUBJECT = "(SELECT 'user' || o_custkey || '@example.com' FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)"


SUBJECT_PATTERN = rf"""('(^|[^{p.IDENTIFIER_CHARACTERS}])' || regexp_replace({SUBJECT}, '([\x21-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7e])', '\\\1', 'g') || '($|[^{p.IDENTIFIER_CHARACTERS}]|\.($|[^A-Za-z0-9_]))')"""


def _locations_sql() -> str:
    parts = [
        f"""SELECT '{table}' AS "table", '{c}' AS "column", count(*) FILTER (contains({c}, {SUBJECT}) AND regexp_matches({c}, {SUBJECT_PATTERN})) AS rows FROM {source}"""
        for table, (source, columns) in _tables_sql().items() for c in columns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rows > 0"


@query("find_subject", _locations_sql())
def find_subject(t):
    return p.find_subject(scanned(t), subject(t))


@query("erasure_plan", f"""
SELECT *, 'DELETE FROM ' || "table" || ' WHERE regexp_like(' || "column" || ', ''' || replace({SUBJECT_PATTERN}, '''', '''''') || ''');' AS statement FROM ({_locations_sql()})
""")
def erasure_plan(t):
    return p.erasure_plan(find_subject(t), subject(t))


@query("erase_subject", f"""
SELECT c_custkey, email, request_params FROM ({CONTACTS}) WHERE email IS DISTINCT FROM {SUBJECT} AND json_extract_string(request_params, '$.user') IS DISTINCT FROM {SUBJECT}
""")
def erase_subject(t):
    return p.erase_subject(contacts(t), CONTACT_COLUMNS, subject(t)).select("c_custkey", "email", "request_params")


@query("merge_catalogs", f"""
SELECT 'EU' AS region, pii_type, count(*) AS fields FROM ({CLASSIFIED}) WHERE contains_pii AND "table" = 'contacts' GROUP BY pii_type
UNION ALL SELECT 'US', pii_type, count(*) FROM ({CLASSIFIED}) WHERE contains_pii AND "table" <> 'contacts' GROUP BY pii_type
""")
def merge_catalogs(t):
    tables = scanned(t)
    eu = {k: v for k, v in tables.items() if k == "contacts"}
    us = {k: v for k, v in tables.items() if k != "contacts"}
    merged = p.merge_catalogs({
        region: p.classify(p.by_values(p.scan_tables(part, AS_OF))) for region, part in (("EU", eu), ("US", us))
    })
    return merged.filter("contains_pii").groupBy("region", "pii_type").agg(F.count(F.lit(1)).alias("fields"))


@query("column_sample", f"""
SELECT "column", c_custkey, value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5("column" || '|' || c_custkey), c_custkey) AS rn FROM (
 {" UNION ALL ".join(f"SELECT c_custkey, '{c}' AS " + '"column"' + f", {c} AS value FROM ({CONTACTS})" for c in CONTACT_COLUMNS)}) WHERE value IS NOT NULL) WHERE rn <= 100
""")
def sample_columns(t):
    long_rows = contacts(t).unpivot(["c_custkey"], CONTACT_COLUMNS, "column", "value")
    return column_sample(long_rows, "column", "value", "c_custkey").select("column", "c_custkey", "value")


@query("pii_samples", f"""
SELECT k."column", pii_type, string_agg(DISTINCT value, ' ; ' ORDER BY value) AS samples FROM (SELECT * FROM ({CLASSIFIED}) WHERE "table" = 'contacts') k JOIN (
 SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5("column" || '|' || c_custkey), c_custkey) AS rn FROM ({
    " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS " + '"column"' + f", {c} AS value FROM ({CONTACTS})" for c in CONTACT_COLUMNS)
}) WHERE value IS NOT NULL) WHERE rn <= 3) s ON s."column" = k."column" GROUP BY ALL
""")
def pii_samples(t):
    classified = p.classify(p.by_values(p.scan_values("contacts", contacts(t), CONTACT_COLUMNS, AS_OF)))
    long_rows = contacts(t).unpivot(["c_custkey"], CONTACT_COLUMNS, "column", "value")
    samples = column_sample(long_rows, "column", "value", "c_custkey", most=3).withColumn("table", F.lit("contacts"))
    found = p.with_samples(classified, samples)
    return found.select("column", "pii_type", F.concat_ws(" ; ", "sample_values").alias("samples"))
