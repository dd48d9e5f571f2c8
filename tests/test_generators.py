"""Generated tables: counts, columns, key formats, shares, round trips."""

from pyspark.sql import functions as F

from tidemark.operators import generators as g
from tidemark.sources import catalog, files, tables


def test_customers(spark):
    df = g.customers(g.ids(spark, 1000))
    assert df.count() == 1000
    assert df.columns == ["customer_id", "company_name", "segment", "industry", "num_employees", "annual_revenue", "lifetime_value", "region", "state", "status", "created_at"]
    assert df.filter("customer_id IS NULL OR segment IS NULL OR state IS NULL OR company_name IS NULL").count() == 0
    shares = {r.segment: r["count"] for r in df.groupBy("segment").count().collect()}
    assert shares == {"Enterprise": 150, "Mid-Market": 350, "SMB": 500}
    assert df.filter(~F.col("customer_id").rlike("^CUST[0-9]{10}$")).count() == 0


def test_customer_types_match_declaration(spark):
    for name, df in (
        ("customers", g.customers(g.ids(spark, 5))),
        ("products", g.products(g.ids(spark, 5))),
        ("multi_source_entities", g.multi_source(g.ids(spark, 5))["A"]),
    ):
        found = catalog.physical_schema(spark, {name: df.schema})
        declared = catalog.physical_schema(spark, {name: tables.declared(name)})
        odd = [tuple(r) for r in catalog.conformance(found, declared).filter("status <> 'ok'").collect()]
        assert odd == []


def test_orders_type(spark):
    made = dict(g.orders(g.ids(spark, 20), g.customers(g.ids(spark, 10))).dtypes)
    assert made["order_amount"] == "decimal(24,2)" and made["days_to_fulfill"] == "bigint"


def test_orders(spark):
    df = g.orders(g.ids(spark, 10_000), g.customers(g.ids(spark, 100_000)))
    assert df.count() == 10_000 and df.filter("order_id IS NULL OR order_amount IS NULL").count() == 0
    joined = df.join(g.customers(g.ids(spark, 100_000)), "customer_id")
    shares = {r.segment: r["count"] for r in joined.groupBy("segment").count().collect()}
    assert shares == {"Enterprise": 1500, "Mid-Market": 3500, "SMB": 5000}
    assert df.filter("status = 'Processing' AND days_to_fulfill IS NOT NULL").count() == 0
    assert df.filter("status = 'Cancelled' AND days_to_fulfill <> 0").count() == 0


def test_orders_without_customer(spark):
    customers = g.customers(g.ids(spark, 10))
    plain, folded = g.orders(g.ids(spark, 200), customers), g.orders(g.ids(spark, 200), customers, wrap_at=10)
    assert plain.count() == 200 and plain.join(customers, "customer_id", "left_anti").count() > 0
    assert folded.join(customers, "customer_id", "left_anti").count() == 0


def test_entities(spark):
    df = g.entities(g.ids(spark, 50))
    assert df.columns == ["entity_id", "first_name", "last_name", "email", "phone", "annual_revenue", "employee_count", "created_date", "last_updated"]
    assert df.filter(~F.col("entity_id").rlike("^ENT[0-9]{10}$")).count() == 0
    assert df.first().email == "james.smith.@company.com"


def test_sources(spark, tmp_path):
    base = g.entities(g.ids(spark, 30))
    parts = [g.inject_conflicts(base, s, a, d) for s, (a, d, _, _) in g.SOURCE_RULES.items()]
    for name, part in zip(g.SOURCE_RULES, parts):
        assert [r.source for r in part.select("source").distinct().collect()] == [name]
        part.write.parquet(f"{tmp_path}/{name}")
    back = spark.read.parquet(*[f"{tmp_path}/{n}" for n in g.SOURCE_RULES])
    assert back.count() == 90
    kinds = {r.conflict_type for r in back.select("conflict_type").distinct().collect()}
    assert kinds <= {"none", "name", "measure", "date", "other"}


def test_default_conflict_mix(spark):
    parts = g.multi_source(g.ids(spark, 100_000))
    assert parts["A"].filter("conflict_type = 'name'").count() == 0
    assert parts["A"].count() == 80_000


def test_hash_gate_counts(spark):
    df = g.multi_source(g.ids(spark, 100_000))["A"]
    counts = {r.conflict_type: r["count"] for r in df.filter("has_conflict").groupBy("conflict_type").count().collect()}
    assert counts == {"date": 1627, "measure": 1568, "other": 813}


def test_basic_sources(spark):
    df = g.multi_source_basic(g.ids(spark, 20), 10)
    assert df.count() == 60
    assert {r["count"] for r in df.groupBy("source", "entity_id").count().collect()} == {2}


def test_wide(spark):
    df = g.wide_baseline(g.ids(spark, 3))
    assert len(df.columns) == 405 and df.first().metadata == {"source": "synthetic", "version": "1.0"}


def test_idempotent_write(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert not files.dataset_exists(spark, path)
    assert files.idempotent_write(g.products(g.ids(spark, 3)), path)
    assert not files.idempotent_write(g.products(g.ids(spark, 5)), path)
    assert spark.read.parquet(path).count() == 3
    assert files.idempotent_write(g.products(g.ids(spark, 5)), path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_partition_directories(spark, tmp_path):
    files.partitioned_write(g.products(g.ids(spark, 300)), f"{tmp_path}/p", ["category"])
    found = {p.name for p in tmp_path.joinpath("p").iterdir() if p.name.startswith("category=")}
    assert found == {f"category={c}" for c in ("Software", "Hardware", "Services", "Training", "Consulting")}
