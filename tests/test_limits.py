"""Data just beyond what used to be a limit, and erasure, matching and resuming that lose nothing."""

from pyspark.sql import functions as F

import __spark_entry__ as driver
from tidemark.operators import analytics, batching, evolution, pii, provenance, relations, selection, usage
from tidemark.session import new_path
from tidemark.sources import files


def test_reach_goes_to_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(20)] + [("n20", "n00")], "src string, dst string")
    found = relations.reach(edges, spark.createDataFrame([("n00",)], "node string"), join_levels=3).collect()
    assert sorted((r.node, r.depth) for r in found) == [(f"n{k:02d}", k) for k in range(21)]


def test_long_values_keep_their_type(spark):
    rows = spark.createDataFrame([("a" * 260 + f"{k}@example.com", f"123-45-{k:04d}") for k in range(20)], "contact string, code string")
    scans = pii.scan_values("t", rows, ["contact", "code"], "2024-06-01")
    found = {r.column: (r.value_type, r.value_confidence) for r in pii.by_values(scans).collect()}
    assert found == {"contact": ("EMAIL", 0.95), "code": ("SSN", 0.95)}


PEOPLE = [
    (1, "user1@example.com", "x"), (2, "superuser1@example.com", "x"), (3, "user_1@example.com", "x"), (4, "userx1@example.com", "x"), (5, "user1@example.com.au", "x"),
    (6, None, '{"user": "user1@example.com", "a": 1}'), (7, None, '{"user": "superuser1@example.com"}'), (8, None, "Mail user1@example.com."), (9, None, "user1@example.commerce"), (10, None, None),
    (11, "USER1@example.com", "x"), (12, None, "to:user1@example.com;cc"),
]


def test_erasure_hits_the_subject_only(spark):
    people = spark.createDataFrame(PEOPLE, "id int, mail string, params string")
    who = F.lit("user1@example.com")
    left = pii.erase_subject(people, ["mail", "params"], who)
    assert sorted(r.id for r in left.collect()) == [2, 3, 4, 5, 7, 9, 10, 11]
    found = pii.find_subject({"people": (people, ["mail", "params"])}, who)
    assert sorted((r.column, r.rows) for r in found.collect()) == [("mail", 1), ("params", 3)]
    people.createOrReplaceTempView("people_to_erase")
    for row in pii.erasure_plan(found, who).collect():
        condition = row.statement.removeprefix("DELETE FROM people WHERE ").removesuffix(";").replace("\\", "\\\\")
        assert spark.sql(f"SELECT id FROM people_to_erase WHERE {condition}").count() == row.rows


def test_erasure_takes_special_characters_literally(spark):
    rows = spark.createDataFrame([(1, "user_1%@a.b"), (2, "userx1y@a.b"), (3, "o'neil+x@a.b"), (4, "o'neilx@a.b")], "id int, mail string")
    assert [r.id for r in pii.erase_subject(rows, ["mail"], F.lit("user_1%@a.b")).collect()] == [2, 3, 4]
    assert [r.id for r in pii.erase_subject(rows, ["mail"], F.lit("o'neil+x@a.b")).collect()] == [1, 2, 4]


def test_best_match_of_a_block(spark):
    kind = "record string, block string, mail string, phone string"
    left = spark.createDataFrame([("L1", "b", "m", "p"), ("L2", "b", "m", "z"), ("L3", "b", None, "z"), ("L4", "c", "m", "p"), ("L5", None, "m", "p"), ("L6", "b", "q", "q")], kind)
    right = spark.createDataFrame([("R1", "b", "x", "y"), ("R2", "b", "m", "p"), ("R3", "b", "m", "p"), ("R4", "b", None, "k"), ("R5", None, "m", "p")], kind)
    found = analytics.match_to_block(left, right, ["block"], "record", ["mail", "phone"]).collect()
    assert sorted(map(tuple, found)) == [("L1", "R2", 1.0), ("L2", "R2", 0.5), ("L3", "R4", 0.5), ("L6", "R1", 0.0)]


def test_groups_left_out_are_named(spark):
    rows = spark.createDataFrame([(g, g * 1000 + n, 1, 1) for g, size in ((1, 5), (2, 60), (3, 20)) for n in range(size)], "grp int, item bigint, tokens bigint, priority bigint")
    out = {r.grp: (r["items"], r.reason) for r in selection.left_out(rows, 11, 50).collect()}
    assert out == {1: (5, "fewer than 11 items"), 2: (60, "more than 50 items")}
    assert {r.grp for r in selection.knapsack_select(rows, 9, 11, 50).collect()} == {3}
    every = selection.auto_select(rows, 12, exhaustive=0, knapsack=0).collect()
    assert {(r.grp, r.strategy) for r in every} == {(1, "greedy"), (2, "greedy"), (3, "greedy")}


def test_batch_size_from_all_rows(spark):
    rows = spark.range(300).select(F.lit("g").alias("grp"), "id", F.when(F.col("id") < 100, 1000).otherwise(100_000).alias("size"))
    whole = batching.adaptive_batch_size(rows, "grp", "id", F.col("size")).first()
    assert whole.mean_size == 67_000.0 and batching.adaptive_batch_size(rows, "grp", "id", F.col("size"), sampled_rows=100).first().mean_size == 1000.0


def test_similar_schemas_at_a_share_that_doubles_round(spark):
    columns = [("a", f"c{k}") for k in range(100)] + [("b", f"c{k}") for k in range(55)]
    _, pairs = usage.similar_schemas(spark.createDataFrame(columns, "table_id string, name string"), 0.55)
    assert [(r.a, r.b, r.jaccard) for r in pairs.collect()] == [("a", "b", 0.55)]


def test_late_rows_open_their_unit_again(spark):
    folder = new_path(spark, "late")
    first = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "unit int, value int")
    more = first.unionByName(spark.createDataFrame([(1, 12), (3, 30)], "unit int, value int"))
    seen = []

    def process(df):
        seen.append(sorted(r.unit for r in df.select("unit").distinct().collect()))
        return df.groupBy("unit").agg(F.sum("value").alias("total"))

    provenance.resume(spark, first, "unit", process, folder)
    assert {r.unit: r.total for r in provenance.resume(spark, more, "unit", process, folder).collect()} == {1: 33, 2: 20, 3: 30}
    assert {r.unit: r.total for r in provenance.resume(spark, more, "unit", process, folder).collect()} == {1: 33, 2: 20, 3: 30}
    assert seen == [[1, 2], [1, 3]]


def test_row_that_arrives_during_a_run(spark):
    folder, source = new_path(spark, "during"), new_path(spark, "source")
    spark.createDataFrame([(1, 10)], "unit int, value int").write.parquet(source)

    def process(df):
        if spark.read.parquet(source).count() == 1:
            spark.createDataFrame([(1, 5)], "unit int, value int").write.mode("append").parquet(source)
        return df.groupBy("unit").agg(F.sum("value").alias("total"))

    provenance.resume(spark, spark.read.parquet(source), "unit", process, folder)
    done = provenance.resume(spark, spark.read.parquet(source), "unit", process, folder)
    assert [(r.unit, r.total) for r in done.collect()] == [(1, 15)]


def test_half_written_folder_is_replaced(spark):
    path = new_path(spark, "half")
    df = spark.range(10)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert files.dataset_exists(spark, path) and not files.is_complete(spark, path)
    assert files.idempotent_write(spark.range(20), path) and not files.idempotent_write(df, path)
    assert spark.read.parquet(path).count() == 20


def test_one_join_serves_all_tables(spark):
    plan = driver.queries()["certainty_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6 and plan.count("FileScan") == 15


def schema(spark, names):
    return spark.createDataFrame([(1, n, "string") for n in names], "table_id int, name string, type string")


def test_splits_of_any_words_and_proof_by_values(spark):
    old, new = schema(spark, ["address", "cust_id", "tag", "x_code"]), schema(spark, ["street_address", "city_address", "customer_id", "order_id", "a_code", "b_code"])
    found = evolution.split_merge_candidates(evolution.schema_diff(old, new))
    assert sorted((r.change, r.whole, tuple(r.parts)) for r in found.collect()) == [("split", "address", ("city_address", "street_address")), ("split", "x_code", ("a_code", "b_code"))]
    shares = spark.createDataFrame([(1, "address", 0.98), (1, "x_code", 0.1)], "table_id int, whole string, share double")
    assert [r.whole for r in evolution.proven(found, shares).collect()] == ["address"]


def test_statements_undo_each_other(spark):
    old, new = schema(spark, ["full_name", "home_phone", "work_phone"]), schema(spark, ["first_name", "last_name", "phone"])
    there = {r.change: (r.statement, r.reverse) for r in evolution.migration_plan(evolution.classify_changes(old, new), F.lit("t")).collect()}
    back = {r.change: (r.statement, r.reverse) for r in evolution.migration_plan(evolution.classify_changes(new, old), F.lit("t")).collect()}
    assert set(there) == set(back) == {"split", "merged"}
    assert there["split"] == back["merged"][::-1] and there["merged"] == back["split"][::-1]
    rows = spark.createDataFrame([("Ann Lee",)], "full_name string")
    halves = evolution.apply_migration(rows, [("split", "full_name", ["first_name", "last_name"], " ")])
    assert halves.columns == ["first_name", "last_name"] and evolution.apply_migration(halves, [("merge", ["first_name", "last_name"], "full_name", " ")]).collect() == rows.collect()
