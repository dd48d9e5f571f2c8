"""Audit of the change log derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as a
from tidemark.plans.fixtures import GATE_LOG, TRANSFORM_LOG, gate_log, log_rows, transform_log
from tidemark.plans.registry import query

_COLUMNS = ["run", "seq", "is_loop"]


def lag_equal(k: int, new: str = "new_value") -> str:
    return (f"(lag(field, {k}) OVER w IS NOT NULL AND field = lag(field, {k}) OVER w AND old_value IS NOT DISTINCT FROM lag(old_value, {k}) OVER w "
            f"AND {new} IS NOT DISTINCT FROM lag({new}, {k}) OVER w)")


_W = "WINDOW w AS (PARTITION BY run ORDER BY seq)"


@query("repeat_loop", f"SELECT run, seq, {lag_equal(1)} AS is_loop FROM ({TRANSFORM_LOG}) {_W}")
def repeat_loop(t):
    return a.repeat_loop(transform_log(t)).select(*_COLUMNS)


@query("windowed_loop", f"SELECT run, seq, seq >= 3 AND ({lag_equal(1)} OR {lag_equal(2)}) AS is_loop FROM ({TRANSFORM_LOG}) {_W}")
def windowed_loop(t):
    return a.windowed_loop(transform_log(t)).select(*_COLUMNS)


@query("any_loop", f"""
WITH l AS (SELECT *, field || '|' || coalesce(old_value, '') || '|' || new_value AS k FROM ({TRANSFORM_LOG}))
SELECT run, seq, len(list_distinct(ks)) < len(ks) AS is_loop FROM (
 SELECT run, seq, list(k) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ks FROM l)
""")
def any_loop(t):
    return a.any_loop(transform_log(t), 5).select(*_COLUMNS)


@query("exact_repeat", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY run, field, old_value, new_value ORDER BY seq) > 1 AS rejected FROM ({TRANSFORM_LOG}))
SELECT run, seq, rejected, last_value(CASE WHEN NOT rejected THEN new_value END IGNORE NULLS) OVER
 (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_accepted FROM l
""")
def exact_repeat(t):
    return a.exact_repeat(transform_log(t)).select("run", "seq", "rejected", "last_accepted")


@query("equivalent_repeat", f"""
WITH l AS (SELECT * REPLACE (lower(CASE WHEN trim(new_value) LIKE '2024-1-%' THEN '2024-01-0' || right(new_value, 1) ELSE new_value END) AS new_value) FROM ({TRANSFORM_LOG}))
SELECT run, seq, {lag_equal(1)} AS is_loop FROM l {_W}
""")
def equivalent_repeat(t):
    return a.equivalent_repeat(transform_log(t)).select(*_COLUMNS)


@query("max_iterations", "SELECT user_id AS run, count(*) AS steps, count(*) > 50 AS exceeded FROM events GROUP BY user_id")
def max_iterations(t):
    return a.over_limit(log_rows(t))


@query("history_tail", f"""
SELECT run, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS rn FROM ({TRANSFORM_LOG})) WHERE rn <= 30
""")
def history_tail(t):
    return a.history_tail(transform_log(t), 30).select("run", "seq", "event_id")


@query("confidence_gate", f"SELECT event_id, coalesce(confidence, 1.0) >= 0.7 AS accepted FROM ({GATE_LOG})")
def confidence_gate(t):
    return gate_log(t).select("event_id", a.confident(F.col("confidence")).alias("accepted"))


_DIGITS = "list_distinct(string_split(regexp_replace({c}, '[^0-9]', '', 'g'), ''))"
_OVERLAP = f"""
(SELECT *, list_filter({_DIGITS.format(c='old_value')}, lambda d: d <> '') AS od, list_filter({_DIGITS.format(c='new_value')}, lambda d: d <> '') AS nd FROM ({GATE_LOG}))
"""
_DIGIT_OK = "(field <> 'dob' OR len(od) = 0 OR len(nd) = 0 OR len(list_intersect(od, nd))::DOUBLE / len(list_distinct(list_concat(od, nd))) >= 0.5)"
_SEMANTIC_OK = r"""((field <> 'email' OR regexp_full_match(new_value, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))
 AND (field <> 'customer_id' OR (length(new_value) <= 50 AND NOT contains(new_value, ' ')))
 AND (field <> 'phone' OR regexp_full_match(new_value, '[0-9\s()+.-]+')))"""


@query("digit_overlap_gate", f"SELECT event_id, {_DIGIT_OK} AS ok FROM {_OVERLAP}")
def digit_overlap_gate(t):
    ok = a.digits_kept(F.col("field"), F.col("old_value"), F.col("new_value"))
    return gate_log(t).select("event_id", ok.alias("ok"))


@query("field_semantics_gate", f"SELECT event_id, {_SEMANTIC_OK} AS ok FROM ({GATE_LOG})")
def field_semantics_gate(t):
    return gate_log(t).select("event_id", a.field_semantics_ok(F.col("field"), F.col("new_value")).alias("ok"))


_AMOUNT = "TRY_CAST(regexp_replace({c}, '[$,]', '', 'g') AS DOUBLE)"
_PRICE_OK = f"coalesce({_AMOUNT.format(c='new_value')} / {_AMOUNT.format(c='old_value')} BETWEEN 0.8 AND 1.2, false)"


@query("username_kept", f"""
SELECT event_id, split_part(old_value, '@', 1) = split_part(new_value, '@', 1) AS ok FROM ({GATE_LOG}) WHERE field = 'email'
""")
def username_kept(t):
    rows = gate_log(t).filter("field = 'email'")
    return rows.select("event_id", a.username_kept(F.col("old_value"), F.col("new_value")).alias("ok"))


@query("price_within_20pct", f"SELECT event_id, {_PRICE_OK} AS ok FROM ({GATE_LOG}) WHERE field = 'price'")
def price_within_20pct(t):
    rows = gate_log(t).filter("field = 'price'")
    return rows.select("event_id", a.price_kept(F.col("old_value"), F.col("new_value")).alias("ok"))


@query("numeric_field_gate", """
SELECT event_id, regexp_full_match(regexp_replace(v, '[.-]', '', 'g'), '[0-9]+') AS ok
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '$' || value ELSE '-' || value END AS v FROM events)
""")
def numeric_field_gate(t):
    value = F.format_string("%.2f", "value")
    rows = t.events.withColumn("new_value", F.when(F.col("event_type") == "error", F.concat(F.lit("$"), value)).otherwise(F.concat(F.lit("-"), value)))
    return rows.select("event_id", a.numeric_ok(F.lit("annual_revenue"), F.col("new_value")).alias("ok"))


@query("iso_code_gate", "SELECT c_custkey, length(left(c_mktsegment, (c_custkey % 3 + 1)::INTEGER)) = 2 AS ok FROM customer")
def iso_code_gate(t):
    rows = t.customer.withColumn("code", F.expr("left(c_mktsegment, cast(c_custkey % 3 + 1 AS int))"))
    return rows.select("c_custkey", a.iso_code_ok(F.lit("country"), F.col("code")).alias("ok"))


_MEANING = f"""(CASE WHEN field = 'dob' THEN {_DIGIT_OK} WHEN field = 'email' THEN split_part(old_value, '@', 1) = split_part(new_value, '@', 1)
  WHEN field = 'price' THEN {_PRICE_OK} ELSE true END)"""


@query("gate_metrics", f"""
SELECT *, (rejected_confidence + rejected_semantics)::DOUBLE / total > 0.05 AS alert FROM (
 SELECT field, count(*) AS total, count(*) FILTER (c AND m) AS accepted, count(*) FILTER (NOT c) AS rejected_confidence,
  count(*) FILTER (c AND NOT m) AS rejected_semantics, (count(*) FILTER (c AND m))::DOUBLE / count(*) AS acceptance_rate
 FROM (SELECT field, coalesce(confidence, 1.0) >= 0.7 AS c, {_MEANING} AS m FROM {_OVERLAP}) GROUP BY field)
""")
def gate_metrics(t):
    meaning = a.value_ok(F.col("field"), F.col("old_value"), F.col("new_value"))
    rows = gate_log(t).select("field", a.confident(F.col("confidence")).alias("c"), meaning.alias("m"))
    return a.gate_metrics(rows, F.col("c"), F.col("m"), ["field"])


@query("threshold_sweep", f"""
SELECT threshold, count(*) FILTER (coalesce(confidence, 1.0) >= threshold AND invented) AS missed,
  count(*) FILTER (coalesce(confidence, 1.0) < threshold AND NOT invented) AS refused
FROM ({GATE_LOG}), (SELECT unnest([0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold
""")
def threshold_sweep(t):
    return a.threshold_sweep(gate_log(t), F.col("confidence"), F.col("invented"))


@query("type_switch_drift", f"""
SELECT run, max(seq) AS rows, max(seq) >= 3 AND arg_max(type, seq) <> arg_max(prev, seq) AS drift
FROM (SELECT *, lag(type) OVER (PARTITION BY run ORDER BY seq) AS prev FROM ({TRANSFORM_LOG})) GROUP BY run
""")
def type_switch_drift(t):
    return a.type_switch_drift(transform_log(t))


_SHARES = f"""
SELECT run, type, count(*) AS rows, min(seq) AS first_seq, (sum(count(*)) OVER (PARTITION BY run))::BIGINT AS run_rows,
  count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY run))::DOUBLE AS share FROM ({TRANSFORM_LOG}) GROUP BY run, type
"""


@query("type_dominance_drift", f"SELECT * EXCLUDE (first_seq) FROM ({_SHARES}) WHERE run_rows >= 5 AND share > 0.30")
def type_dominance_drift(t):
    return a.type_dominance_drift(transform_log(t))


@query("new_type_drift", f"SELECT run, type, first_seq FROM ({_SHARES}) WHERE run_rows >= 60 AND first_seq > run_rows - 60")
def new_type_drift(t):
    return a.new_type_drift(transform_log(t), 60)


@query("embedding_drift", """
SELECT vec_id, round(1.0 - list_cosine_similarity(old::DOUBLE[], new::DOUBLE[]), 6) AS distance,
  1.0 - list_cosine_similarity(old::DOUBLE[], new::DOUBLE[]) > 0.15 AS drift
FROM (SELECT a.vec_id, a.embedding AS old, b.embedding AS new FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
""")
def embedding_drift(t):
    old = t.embeddings.select("vec_id", F.col("embedding").alias("old"))
    new = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("new"))
    found = a.embedding_drift(old.join(new, "vec_id"), "old", "new")
    return found.withColumn("distance", F.round("distance", 6))


@query("value_meaning_drift", """
WITH s AS (SELECT date_trunc('week', ts)::DATE AS period, event_type, count(*) AS rows,
  count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY date_trunc('week', ts)::DATE))::DOUBLE AS share FROM events GROUP BY 1, 2)
SELECT *, share - lag(share) OVER (PARTITION BY event_type ORDER BY period) AS change FROM s
""")
def value_meaning_drift(t):
    rows = t.events.select(F.date_trunc("week", "ts").cast("date").alias("period"), "event_type")
    return a.value_meaning_drift(rows, "period", "event_type")
