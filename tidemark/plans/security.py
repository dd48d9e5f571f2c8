"""Scans over form inputs derived from events and over the whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.values import sanitize
from tidemark.operators import analytics
from tidemark.operators import provenance as p
from tidemark.operators import security as s
from tidemark.plans.analytics import confusion_sql
from tidemark.plans.fixtures import QUERY_LOG, query_log
from tidemark.plans.registry import query

# Form inputs: attacks with their family, and harmless values, one per event.
SAMPLES = [
    ("statement", "'; DROP TABLE users; --"), ("statement", "';DROP TABLE users;--"), ("statement", "x;  DROP  TABLE  users;  "),
    ("logic", "admin' OR '1'='1"), ("logic", "admin' OR 1=1 --"), ("logic", "admin' OR 'x'='x"),
    ("union", "' UNION SELECT password FROM users --"), ("union", "' union all select NULL, password from users"),
    ("procedure", "'; EXEC xp_cmdshell('net user'); --"), ("procedure", "EXECUTE ('x')"),
    ("time", "x WAITFOR DELAY '00:00:10'"), ("time", "1 AND SLEEP(5)"), ("condition", "' AND IF(1=1, 1, 0)"),
    ("none", "O'Brien"), ("none", "DROP Shipping LLC"), ("none", "  Jane   Doe /* home */ "), ("none", "42 Main St -- rear"),
    ("none", "Updated yesterday"), ("none", "caseworker"),
]


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


INPUTS = f"""
SELECT event_id, user_id, ts, [{', '.join(_quoted(f) for f, _ in SAMPLES)}][event_id % {len(SAMPLES)} + 1] AS family,
  [{', '.join(_quoted(v) for _, v in SAMPLES)}][event_id % {len(SAMPLES)} + 1] || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' ' || event_type END AS value FROM events
"""


def inputs(t):
    index = (F.col("event_id") % len(SAMPLES) + 1).cast("int")
    tail = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "event_type"))
    return t.events.select(
        "event_id", "user_id", "ts",
        F.element_at(F.array(*[F.lit(f) for f, _ in SAMPLES]), index).alias("family"),
        F.concat(F.element_at(F.array(*[F.lit(v) for _, v in SAMPLES]), index), tail).alias("value"),
    )


def basic_sql(column: str) -> str:
    cases = " ".join(f"WHEN contains(upper({column}), {_quoted(p.upper())}) THEN {_quoted(p)}" for p in s.SUBSTRINGS)
    return f"CASE {cases} END"


def regex_sql(column: str, what: int) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({column}, {_quoted('(?i)' + pattern)}) THEN {_quoted(family if what == 0 else pattern)}"
        for family, _, pattern in s.PATTERNS
    )
    return f"CASE {cases} END"


def hits_by_pattern(scanned):
    # Clean values are dropped by their count of zero: a filter on the pattern itself would be pushed
    # below the projection that makes the upper-case text, and make that text again for every pattern.
    return scanned.groupBy("kind", "pattern").agg(F.count("pattern").alias("hits")).filter("hits > 0")


@query("injection_scan_basic", f"""
SELECT kind, pattern, count(*) AS hits FROM (SELECT 'input' AS kind, {basic_sql('value')} AS pattern FROM ({INPUTS})
 UNION ALL SELECT 'document', {basic_sql('text')} FROM documents UNION ALL SELECT 'turn', {basic_sql('text')} FROM conversations UNION ALL SELECT 'page', {basic_sql('html')} FROM pages)
WHERE pattern IS NOT NULL GROUP BY kind, pattern
""")
def injection_scan_basic(t):
    return hits_by_pattern(s.basic_scan(texts(t), "value", "pattern"))


def texts(t):
    parts = [
        inputs(t).select(F.lit("input").alias("kind"), "value"),
        t.documents.select(F.lit("document").alias("kind"), F.col("text").alias("value")),
        t.conversations.select(F.lit("turn").alias("kind"), F.col("text").alias("value")),
        t.pages.select(F.lit("page").alias("kind"), F.col("html").alias("value")),
    ]
    return analytics.union_tables(parts)


@query("injection_scan_regex", f"""
SELECT kind, pattern, count(*) AS hits FROM (SELECT 'input' AS kind, {regex_sql('value', 1)} AS pattern FROM ({INPUTS})
 UNION ALL SELECT 'document', {regex_sql('text', 1)} FROM documents UNION ALL SELECT 'turn', {regex_sql('text', 1)} FROM conversations UNION ALL SELECT 'page', {regex_sql('html', 1)} FROM pages)
WHERE pattern IS NOT NULL GROUP BY kind, pattern
""")
def injection_scan_regex(t):
    return hits_by_pattern(s.regex_scan(texts(t), "value", pattern="pattern"))


_ALLOWED = ", ".join(_quoted(v) for v in s.ALLOWED)


@query("allow_list", f"""
SELECT event_id, value, CASE WHEN value NOT IN ({_ALLOWED}) THEN {basic_sql('value')} END AS pattern FROM ({INPUTS})
""")
def allow_list(t):
    return s.basic_scan(inputs(t), "value", "pattern", s.ALLOWED).select("event_id", "value", "pattern")


_BLOCKED = f"""
SELECT *, CASE WHEN value NOT IN ({_ALLOWED}) THEN {basic_sql('value')} END AS pattern FROM ({INPUTS})
"""


@query("blocked_value_rewrite", f"""
SELECT 'records.' || event_id || '.name' AS path, CASE WHEN pattern IS NULL THEN value ELSE 'INVALID_INPUT' END AS value, pattern IS NOT NULL AS security_violation,
  CASE WHEN pattern IS NOT NULL THEN 'SECURITY VIOLATION: SQL injection blocked. Original value: ' || value || ' Pattern matched: ' || pattern || ' Fallback: INVALID_INPUT' ELSE 'kept' END AS reason
FROM ({_BLOCKED})
""")
def blocked_value_rewrite(t):
    blocked = s.block_values(inputs(t), "value", s.ALLOWED)
    violation = p.violation_reason(F.col("old_value"), F.col("matched_pattern"), F.col("value"))
    reason = F.when(F.col("security_violation"), violation).otherwise("kept")
    flagged = blocked.select("security_violation", *[c for c in blocked.columns if c != "security_violation"])
    patches = p.build_patches(flagged, F.col("event_id"), F.lit("name"), F.col("value"), reason, "scanner", F.col("event_id"))
    return patches.select("path", "value", F.startswith("reason", F.lit("SECURITY VIOLATION")).alias("security_violation"), "reason")


@query("scan_accuracy", confusion_sql(
    f"SELECT family, {regex_sql('value', 1)} IS NOT NULL AS p, family <> 'none' AS a FROM ({INPUTS})", by="family"
))
def scan_accuracy(t):
    rows = s.regex_scan(inputs(t), "value")
    return analytics.confusion(rows, F.col("matched_pattern").isNotNull(), F.col("family") != "none", ["family"])


@query("violation_replay", f"""
WITH v AS (SELECT * FROM ({_BLOCKED}) WHERE pattern IS NOT NULL)
SELECT 'total' AS section, 'all' AS key, count(*) AS attempts FROM v UNION ALL SELECT 'pattern', pattern, count(*) FROM v GROUP BY pattern
UNION ALL (SELECT 'source', user_id::VARCHAR, count(*) AS n FROM v GROUP BY user_id ORDER BY n DESC, user_id::VARCHAR LIMIT 10)
""")
def violation_replay(t):
    blocked = s.block_values(inputs(t), "value", s.ALLOWED)
    return p.violation_replay(blocked, F.col("security_violation"), "matched_pattern", "user_id")


@query("repeat_attackers", f"""
SELECT user_id, ts, attacks FROM (SELECT user_id, ts, pattern,
 count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW) AS attacks FROM ({_BLOCKED}) WHERE pattern IS NOT NULL)
WHERE attacks >= 5
""")
def repeat_attackers(t):
    # Events are minutes apart, so the trailing window is two days here.
    hits = s.block_values(inputs(t), "value", s.ALLOWED).filter("security_violation")
    return s.repeat_attackers(hits, "user_id", "ts", least=5, seconds=172_800)


@query("query_log_guard", rf"""
SELECT query_id, nullif(upper(regexp_extract(text, '(?i)\b(DROP|DELETE|TRUNCATE|ALTER|CREATE)\b', 1)), '') AS forbidden,
  NOT regexp_matches(text, '(?i)\blimit\b') AS no_limit FROM ({QUERY_LOG})
""")
def query_log_guard(t):
    return s.query_log_guard(query_log(t), "text").select("query_id", "forbidden", "no_limit")


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace({c}, '''', ''''''), '--[^\n]*(\n?)$', '\1'), '(?s)/\*.*?\*/', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"""


@query("sanitize_text", f"""
SELECT event_id AS id, 'input' AS kind, {_CLEAN.format(c='value')} AS clean FROM ({INPUTS})
UNION ALL SELECT doc_id, 'document', md5({_CLEAN.format(c='text')}) FROM documents
""")
def sanitize_text(t):
    forms = inputs(t).select(F.col("event_id").alias("id"), F.lit("input").alias("kind"), sanitize(F.col("value")).alias("clean"))
    documents = t.documents.select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.md5(sanitize(F.col("text"))).alias("clean")
    )
    return forms.unionByName(documents)
