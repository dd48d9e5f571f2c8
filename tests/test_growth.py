"""What must not grow with the input: broadcasts, rows of one task, pairs that are compared."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import relations, similarity
from tidemark.plans import fixtures
from tidemark.plans import pii as pii_plans
from tidemark.session import MOST_BROADCAST_ROWS, cut_lineage
from tidemark.sources import ledger


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(relations, "cut_lineage", lambda df: plans.append(plan(df)) or cut_lineage(df))
    many = MOST_BROADCAST_ROWS + 10
    found = relations.connected_groups(spark.range(many).select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 1000).alias("dst")))
    assert found.count() == many and found.filter("grp <> node - node % 1000").isEmpty()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_groups_shrink_by_the_round_whatever_the_graph(spark, monkeypatch):
    """Chains, stars, loops, lone nodes, null ends and repeated edges; all links were joined again in every round."""
    draw = random.Random(3)
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(3000)]
    shuffled = [(f"s{a}", f"s{b}") for order in [draw.sample(range(2000), 2000)] for a, b in zip(order, order[1:], strict=False)]
    pairs = [(f"r{draw.randrange(900)}", f"r{draw.randrange(900)}") for _ in range(600)]
    odd = [("x", "x"), (None, "y"), ("z", None), (None, None), ("a", "b"), ("b", "a"), ("a", "b"), ("q", "c0000"), ("q", None)]
    edges = chain + shuffled + pairs + odd + [("hub", f"leaf{k}") for k in range(500)]
    group = {}
    for a, b in edges:
        if a is not None and b is not None:
            one, two = group.setdefault(a, {a}), group.setdefault(b, {b})
            if one is not two:
                one |= two
                group.update(dict.fromkeys(two, one))
    written = []
    monkeypatch.setattr(relations, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    found = relations.connected_groups(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == sorted((node, min(nodes)) for node, nodes in group.items())
    assert written.count(["src", "dst"]) <= 8  # links are written once, and in each round those that are left
    assert relations.connected_groups(spark.createDataFrame([(None, "y")], "src string, dst string")).count() == 0


def test_names_that_are_not_alike_rarely_meet(spark):
    """Invented names of a few letters share single grams by the thousand; meetings must grow as the names do, not with their square."""
    met, count = [], 4000
    for many in (count, 4 * count):
        left = spark.range(many).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("name"))
        right = left.select(F.concat(F.substring("name", 1, 7), F.lit("x"), F.substring("name", 9, 8)).alias("name"))
        names = left.selectExpr("'l' side", "name").union(right.selectExpr("'r' side", "name"))
        pairs = similarity.candidate_names(names, 60)[0]
        met.append(pairs.count())
    assert met[0] >= count and met[1] < 6 * met[0]


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_any_number_of_grams_in_a_key_gives_the_same_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST_GRAMS", most)
    names = ["anna", "anne", "hanna", "a", "", "x", "annabelle smith", "annabele smith", "anabelle smith", "bob"]
    rows = spark.createDataFrame([(s, n) for s in "lr" for n in names], "side string, name string")
    got = {(r.l, r.r): r.similarity for r in similarity.similar_names(rows, 50).collect()}
    sets = {n: {f"##{n}##"[k : k + 3] for k in range(len(n) + 2)} for n in names}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in names for b in names}
    assert got == {pair: share for pair, share in want.items() if share >= 0.5}


@pytest.mark.parametrize("made", [fixtures.sources, pii_plans.contacts, fixtures.old_columns, fixtures.new_columns])
def test_rows_that_become_many_are_dealt_to_all_tasks_first(spark, made):
    """One task reads a small file, but may not alone make and sort all that comes of it; rows may repeat and keys be null."""
    keys = [None, None, *range(200), 7, 7]
    customer = spark.createDataFrame([(k, f"n{k}", 1, "x") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1)
    part = spark.createDataFrame([(k, f"t{k}", 3) for k in keys], "p_partkey long, p_type string, p_size int").coalesce(1)
    rows = made(SimpleNamespace(customer=customer, part=part))
    share = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.sum("count")).first()[0]
    assert share < 0.5


def test_a_task_reads_a_footer_once(tmp_path, monkeypatch):
    """A footer grows with its file; read for every row group it made a stream's work grow with the square of the file."""
    for name in ("a", "b"):
        pq.write_table(pa.table({"id": list(range(40))}), f"{tmp_path}/{name}.parquet", row_group_size=4)
    reader = ledger.LedgerReader(T.StructType([T.StructField("id", T.LongType())]), {"path": str(tmp_path), "ledger": f"{tmp_path}/ledger"})
    opened, file = [], pq.ParquetFile
    monkeypatch.setattr(ledger.pq, "ParquetFile", lambda source: opened.append(source) or file(source))
    found = [i for batch in reader.read(ledger.Groups([(n, g) for n in ("a.parquet", "b.parquet") for g in range(10)])) for i in batch.column(0).to_pylist()]
    assert sorted(found) == sorted([*range(40)] * 2) and len(opened) == 2
