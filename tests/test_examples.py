"""Worked examples with known answers."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.operators import analytics, audit, batching, conflicts, evolution, pii, provenance, search, security, selection, usage


def one(spark, column, **inputs):
    """Value of an expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in inputs.items()])
    return row.select(column.alias("out")).first().out


def source_rows(spark, rows):
    return spark.createDataFrame(rows, "entity int, field string, value string, source string, priority int, updated date")


DAY = datetime.date(2024, 1, 1)
THREE = [(1, "email", "a@x", "crm", 3, DAY), (1, "email", "b@x", "erp", 2, DAY), (1, "email", "c@x", "legacy", 1, DAY)]


def test_three_way_conflict(spark):
    found = conflicts.detect_conflicts(source_rows(spark, THREE)).collect()
    assert [(r.conflict_type, r.num_sources, r.sources) for r in found] == [("3-way", 3, ["crm", "erp", "legacy"])]


def test_wide_rows_become_long(spark):
    wide = spark.createDataFrame([(1, "crm", "a@x", 5)], "entity int, source string, email string, staff int")
    got = [tuple(r) for r in conflicts.long_form(wide, ["entity", "source"], ["email", "staff"]).collect()]
    assert got == [(1, "crm", "email", "a@x"), (1, "crm", "staff", "5")]


def test_null_is_a_value(spark):
    rows = [(1, "email", "a@x", "crm", 3, DAY), (1, "email", None, "erp", 2, DAY), (2, "email", None, "crm", 3, DAY), (2, "email", None, "erp", 2, DAY)]
    assert [r.entity for r in conflicts.detect_conflicts(source_rows(spark, rows)).collect()] == [1]
    resolved = {r.entity: r.conflict for r in conflicts.resolve(source_rows(spark, rows)).collect()}
    assert resolved == {1: True, 2: False}


def test_priority_wins_and_confidence(spark):
    row = conflicts.with_confidence(conflicts.resolve(source_rows(spark, THREE))).first()
    assert (row.value, row.winner, row.discarded_sources, row.confidence) == ("a@x", "crm", ["erp", "legacy"], 0.65)


def test_newest_breaks_ties(spark):
    later = datetime.date(2024, 2, 1)
    rows = [(1, "f", "old", "a", 2, DAY), (1, "f", "new", "b", 2, later), (1, "f", "low", "c", 1, later)]
    row = conflicts.resolve(source_rows(spark, rows)).first()
    assert (row.value, row.priority, row.runner_up) == ("new", 2, 2)


def test_confidence_by_lead(spark):
    def score(p, r, n):
        return one(spark, conflicts.confidence(F.col("p"), F.col("r"), F.col("n")), p=p, r=r, n=n)

    assert [score(5, 2, 2), score(4, 2, 2), score(3, 2, 2), score(2, 2, 2), score(2, 2, 9), score(1, 0, 1)] == [0.95, 0.85, 0.7, 0.5, 0.35, 0.7]


ITEMS = [("g", 1, 50, 15), ("g", 2, 30, 10), ("g", 3, 40, 5)]


def test_selection_takes_the_best_pair(spark):
    items = spark.createDataFrame(ITEMS, "grp string, item bigint, tokens bigint, priority bigint")
    for select in (selection.greedy_select, selection.exhaustive_select):
        assert sorted(r.item for r in select(items, 80).collect()) == [1, 2]


def test_budget(spark):
    def left(most, used):
        return one(spark, selection.budget_available(F.col("m"), F.col("u")), m=most, u=used)

    assert (left(200000, 0), left(100000, 30000), left(1000, 900)) == (150000, 45000, 0)
    assert one(spark, selection.can_afford(selection.budget_available(F.col("m"), F.col("u")), F.col("n")), m=10000, u=0, n=8000) is False


def test_tiers_never_go_below_zero(spark):
    items = spark.createDataFrame([("g", 1, 90, 15), ("g", 2, 30, 10), ("g", 3, 5, 1)], "grp string, item bigint, tokens bigint, priority bigint")
    row = selection.tier_allocation(items, F.lit(80)).first()
    assert (row.critical, row.high, row.medium, row.low) == (90, 0, 0, 0)


def change_log(spark, triples):
    rows = [(1, i + 1, *t) for i, t in enumerate(triples)]
    return spark.createDataFrame(rows, "run int, seq bigint, field string, old_value string, new_value string")


A, B = ("dob", "x", "y"), ("dob", "y", "x")


def flags(df):
    return [r.is_loop for r in df.orderBy("seq").collect()]


def test_loops(spark):
    assert flags(audit.repeat_loop(change_log(spark, [A, A]))) == [False, True]
    swinging = change_log(spark, [A, B, A, B])
    assert flags(audit.repeat_loop(swinging)) == [False] * 4
    assert flags(audit.windowed_loop(swinging, 3)) == [False, False, True, True]
    assert flags(audit.any_loop(swinging, 5)) == [False, False, True, True]
    repeated = audit.exact_repeat(swinging).orderBy("seq").collect()
    assert [r.rejected for r in repeated] == [False, False, True, True]
    assert [r.last_accepted for r in repeated] == [None, "y", "x", "x"]


def test_equivalent_values(spark):
    assert one(spark, v.normalize_value(F.col("x")), x=" 1975-12-5 ") == "1975-12-05"


def test_digit_overlap(spark):
    def overlap(a, b):
        return one(spark, v.digit_overlap(F.col("a"), F.col("b")), a=a, b=b)

    assert round(overlap("Dec 5, 1975", "1975-12-05"), 2) == 0.67
    assert round(overlap("Dec 5, 1975", "2025-01-01"), 2) == 0.33
    assert overlap("1990-05-15", "33") == 0.0
    assert overlap("none", "33") is None


def test_field_semantics(spark):
    def ok(field, new, strict=False):
        return one(spark, audit.field_semantics_ok(F.col("f"), F.col("n"), strict), f=field, n=new)

    assert not ok("email", "555-123-4567") and ok("email", "alice@acme.com")
    assert not ok("customer_id", "Customer John Doe") and ok("customer_id", "CUST-1")
    assert ok("phone", "+1-555-123-4567") and not ok("phone", "alice@example.com")
    assert not ok("video", "a long title") and ok("video", "a long title", strict=True)


def test_price_kept(spark):
    def ok(old, new):
        return one(spark, audit.price_kept(F.col("o"), F.col("n")), o=old, n=new)

    assert ok("$1,000.00", "1150") and not ok("$1,000.00", "1300") and not ok("$1,000.00", "free")


def test_drift(spark):
    rows = [(1, i + 1, k) for i, k in enumerate("a" * 45 + "b" * 28 + "c" * 15 + "d" * 12)]
    log = spark.createDataFrame(rows, "run int, seq bigint, type string")
    assert [r.type for r in audit.type_dominance_drift(log).collect()] == ["a"]
    assert audit.type_switch_drift(log).first().drift is False
    short = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "run int, seq bigint, type string")
    assert audit.type_switch_drift(short).first().drift is True
    five = spark.createDataFrame([(1, i, "a") for i in range(1, 6)], "run int, seq bigint, type string")
    assert [r.type for r in audit.new_type_drift(five).collect()] == ["a"]


def test_injection_basic(spark):
    rows = spark.createDataFrame([("'; DROP TABLE customers; --",), ("O'Brien",), ("DROP Shipping LLC",)], "value string")
    assert [r.matched_pattern for r in security.basic_scan(rows, "value").collect()] == ["';", None, "DROP "]
    allowed = security.basic_scan(rows, "value", allowed=security.ALLOWED).collect()
    assert [r.matched_pattern for r in allowed] == ["';", None, None]


def test_injection_regex(spark):
    cases = {
        "x; DROP TABLE t": "statement", "a -- b": "comment", "/* a */": "comment", "admin' OR '1'='1": "logic", "' or 1 = 1": "logic",
        "1 union  select 2": "union", "exec (x)": "procedure", "xp_cmdshell": "procedure", "WAITFOR DELAY": "time", "sleep (5)": "time",
        "if(1=1)": "condition", "case when": "condition", "Jane Doe": None, "unionized selection": None, "x;DELETE": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "value string")
    found = {r.value: r.matched_family for r in security.regex_scan(rows, "value").collect()}
    assert found == cases


def test_sanitize(spark):
    def clean(text):
        return one(spark, v.sanitize(F.col("x")), x=text)

    assert clean("O'Brien") == "O''Brien"
    assert clean("a  -- comment") == "a"
    assert clean("a /* b\nc */ d\x00") == "a d"
    assert clean("keep -- this\nline") == "keep -- this line"


def test_personal_data(spark):
    rows = spark.createDataFrame(
        [("user@example.com", '{"user": "alice@example.com"}', "1985-03-15"), ("alice@company.com", '{"user": "bob@company.com"}', "1972-11-22"),
         ("bob@domain.org", '{"user": "c@company.com"}', "1990-07-08")],
        "email string, request_params string, field_123 string",
    )
    found = pii.by_values(pii.scan_values("t", rows, rows.columns, "2024-06-01")).collect()
    assert {r.column: (r.value_type, r.value_confidence, r.reason) for r in found} == {
        "email": ("EMAIL", 0.95, "3/3"), "request_params": ("EMAIL", 0.85, "3/3"), "field_123": ("DATE_OF_BIRTH", 0.75, "3/3"),
    }


def test_card_and_number_patterns(spark):
    rows = spark.createDataFrame([("123-45-6789", "4111-1111-1111-1111", "10.0.0.1")] * 3, "a string, b string, c string")
    found = pii.by_values(pii.scan_values("t", rows, rows.columns, "2024-06-01")).collect()
    assert [r.value_type for r in found] == ["SSN", "CREDIT_CARD", "IP_ADDRESS"]


def test_confusion(spark):
    outcomes = [(True, True)] * 336 + [(False, True)] * 11 + [(False, False)] * 612 + [(True, False)] * 41
    row = analytics.confusion(spark.createDataFrame(outcomes, "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert [round(x, 3) for x in (row.precision, row.recall, row.accuracy)] == [0.891, 0.968, 0.948]


def columns(spark, names):
    return spark.createDataFrame([(1, n, "string") for n in names], "table_id int, name string, type string")


def test_schema_change(spark):
    old, new = columns(spark, ["id", "name", "email"]), columns(spark, ["id", "name", "email_primary", "email_secondary"])
    found = {(r.change, r.old_name, r.new_name) for r in evolution.classify_changes(old, new).collect()}
    assert found == {("renamed", "email", "email_primary"), ("added", None, "email_secondary")}


def test_split(spark):
    old, new = columns(spark, ["full_name"]), columns(spark, ["first_name", "last_name"])
    assert [(r.change, r.whole, r.parts) for r in evolution.split_merge_candidates(evolution.schema_diff(old, new)).collect()] == [
        ("split", "full_name", ["first_name", "last_name"])
    ]
    back = evolution.classify_changes(new, old).first()
    assert (back.change, back.old_name, back.new_name) == ("merged", "first_name,last_name", "full_name")


def test_abbreviations(spark):
    old, new = columns(spark, ["cust_id", "signup_dt"]), columns(spark, ["customer_id", "signup_date"])
    found = {(r.old_name, r.new_name, r.band) for r in evolution.rename_candidates(evolution.schema_diff(old, new)).collect()}
    assert found == {("cust_id", "customer_id", "semantic"), ("signup_dt", "signup_date", "semantic")}


def test_unused_tables(spark):
    created, later = datetime.date(2020, 6, 15), datetime.date(2023, 1, 15)
    rows = [("user_events_backup_2020", 0, created, created, False), ("customer_retention_quarterly", 0, later, later, False), ("user_events", 9, created, later, False)]
    used = spark.createDataFrame(rows, "table_name string, query_count int, created date, modified date, superseded boolean")
    found = {r.table_name: (r.action, r.safe_to_delete) for r in usage.zombie_classify(used, F.lit("2024-06-01").cast("date")).collect()}
    assert found == {"user_events_backup_2020": ("archive", 0.92), "customer_retention_quarterly": ("keep", 0.05), "user_events": ("keep", 0.05)}


def test_clusters(spark):
    names = ["id", "email", "event_type", "timestamp"]
    cols = spark.createDataFrame([(t, n) for t in (1, 2, 3) for n in names] + [(4, "x")], "table_id int, name string")
    rows = [(1, "user_events", 0, datetime.date(2020, 1, 1)), (2, "user_events_v2", 3, datetime.date(2021, 1, 1)), (3, "user_events_v3", 3, datetime.date(2022, 1, 1)), (4, "other", 9, datetime.date(2022, 1, 1))]
    tables = spark.createDataFrame(rows, "table_id int, table_name string, query_count int, created date")
    found = usage.schema_clusters(cols, tables).collect()
    assert {(r.table_name, r.primary_table, r.superseded) for r in found} == {
        ("user_events", "user_events_v3", True), ("user_events_v2", "user_events_v3", True), ("user_events_v3", "user_events_v3", False)
    }


def test_names_match_whole(spark):
    log = spark.createDataFrame([(1, "SELECT * FROM analytics.USER_EVENTS_v2")], "query_id int, text string")
    assert [r.name for r in usage.named_tables(log, "text", []).collect()] == ["select", "from", "analytics", "user_events_v2"]


def test_period_change(spark):
    kpis = spark.createDataFrame([(1, 1200000.0, 450), (2, 1020000.0, 420)], "month int, revenue double, customers int")
    row = analytics.period_change(kpis, "month", ["revenue", "customers"]).filter("month = 2").first()
    assert (round(row.revenue_change_pct, 1), round(row.customers_change_pct, 1)) == (-15.0, -6.7)


def test_bloom_size():
    bits, hashes = search.bloom_size(10_000_000, 0.001)
    assert round(bits / 1e6, 2) == 143.78 and hashes == 10


def test_recovery(spark):
    runs = spark.createDataFrame([(1, 50000, 35234, 10000)], "run int, total int, crash_at int, interval int")
    row = provenance.recovery_accounting(runs).first()
    assert (row.checkpoint, row.lost, row.reprocessed) == (30000, 5234, 20000)


def test_admission(spark):
    at = datetime.datetime(2024, 1, 1)
    requests = spark.createDataFrame([("p", i, at) for i in range(15)], "provider string, id int, ts timestamp")
    done = batching.admission_schedule(requests, "provider", "ts", "id", 1_200_000, 10)
    waits = [r.wait_micros for r in done.orderBy("id").collect()]
    assert waits == [0] * 10 + [1_200_000 * k for k in range(1, 6)]


def test_backoff(spark):
    done = batching.backoff_schedule(spark.range(1), F.lit(3)).orderBy("attempt").collect()
    assert [(r.wait, r.starts_after) for r in done] == [(4, 0), (8, 4), (10, 12)]


def test_patches_replay(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, city string")
    patches = spark.createDataFrame([(1, "name", "c", 1), (1, "name", "d", 2), (2, "city", None, 3)], "record int, field string, value string, seq int")
    got = sorted(tuple(r) for r in provenance.apply_patches(base, "id", patches, ["name", "city"]).collect())
    assert got == [(1, "d", "x"), (2, "b", None)]
