"""Key discovery with sketches first: the same pairs as the exact method, for less of the shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import relations as r


def made(spark, rows=3000):
    """A parent, children of several kinds, and columns that only look like children."""
    rng = random.Random(4)
    ids = [f"k{n:06d}" for n in rng.sample(range(10**6), rows)]
    parent = spark.createDataFrame([(i, n % 7, None if n % 3 else i) for n, i in enumerate(ids)], "id string, few int, holes string")
    inside = [rng.choice(ids) for _ in range(rows)]
    ends = [min(ids), max(ids)]
    child = spark.createDataFrame(
        [(i, ids[n % 9], ends[n % 2] if n < 4 else f"k{rng.randrange(10**6):06d}", n % 5, i if n else "zzz") for n, i in enumerate(inside)],
        "fk string, hot string, ends string, small int, nearly string",
    )
    empty = spark.createDataFrame([(None,)], "x string")
    tables = {"p": parent, "c": child, "e": empty}
    return {f"{t}.{c}": c for t, df in tables.items() for c in df.columns}, tables


@pytest.mark.parametrize("log_entries", [4, 8, 12])
def test_same_pairs_as_the_exact_method(spark, log_entries):
    columns, tables = made(spark)
    exact = sorted(map(tuple, r.fk_discovery(columns, tables).collect()))
    assert sorted(map(tuple, r.fk_discovery_sketched(columns, tables, log_entries=log_entries).collect())) == exact
    assert {("c.fk", "p.id"), ("c.hot", "p.id")} <= {pair[:2] for pair in exact}
    candidates = set(map(tuple, r.key_candidates(columns, tables).collect()))
    assert ("c.nearly", "p.id") not in candidates and ("c.ends", "p.id") not in candidates and not any("e.x" in pair for pair in candidates)


def test_normalized_values(spark):
    columns, tables = made(spark, 200)
    tables = {**tables, "c": tables["c"].withColumn("fk", F.upper("fk"))}
    lower = lambda v: F.lower(v.cast("string"))
    assert ("c.fk", "p.id") not in {row[:2] for row in r.fk_discovery_sketched(columns, tables).collect()}
    exact = sorted(map(tuple, r.fk_discovery(columns, tables, normalize=lower).collect()))
    assert sorted(map(tuple, r.fk_discovery_sketched(columns, tables, lower).collect())) == exact


def _stages(store):
    listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [listed.apply(k) for k in range(listed.size())]


def test_fifty_columns_shuffle_less_than_a_third(spark):
    folder = "/root/testdata/sf0.1"
    names = ["orders", "lineitem", "customer", "part", "supplier", "events", "nation", "region", "documents", "labels"]
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet").drop("text", "embedding") for n in names}
    columns = {f"{n}.{c}": c for n in names for c in tables[n].columns}
    assert len(columns) >= 50

    def shuffled(find):
        store = spark.sparkContext._jsc.sc().statusStore()
        seen = {(s.stageId(), s.attemptId()) for s in _stages(store)}
        rows = sorted(map(tuple, find().collect()))
        return rows, sum(s.shuffleWriteBytes() for s in _stages(store) if (s.stageId(), s.attemptId()) not in seen)

    exact, much = shuffled(lambda: r.fk_discovery(columns, tables))
    rows, little = shuffled(lambda: r.fk_discovery_sketched(columns, tables))
    assert rows == exact and len(rows) > 5
    assert little < much / 3, (little, much)  # what is left are the values of keys that do hold
