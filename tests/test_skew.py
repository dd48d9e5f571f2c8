"""One key with most rows, and results against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, ordered, provenance, search, security, selection
from tidemark.session import new_path


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows of which key 0 owns nine tenths."""
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.9 else rng.randrange(1, 20), i, rng.randrange(1000), rng.randrange(100)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k int, id bigint, at bigint, x bigint")


def per_key(rows):
    groups = {}
    for k, i, at, x in sorted(rows, key=lambda r: (r[2], r[1])):
        groups.setdefault(k, []).append((i, at, x))
    return groups


CELLS = [None, "floor(at / 10)"]


@pytest.fixture(params=CELLS)
def cell(request):
    return request.param and F.expr(request.param)


def test_positions(skewed, cell):
    rows, df = skewed
    got = {r.id: r.pos for r in ordered.positions(df, ["k"], ["at", "id"], cell).collect()}
    assert got == {i: n + 1 for group in per_key(rows).values() for n, (i, _, _) in enumerate(group)}


def test_positions_without_keys(skewed, cell):
    rows, df = skewed
    got = {r.id: r.pos for r in ordered.positions(df, [], ["at", "id"], cell).collect()}
    assert got == {r[1]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}


def test_running(skewed, cell):
    rows, df = skewed
    done = ordered.running(df, ["k"], ["at", "id"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, cell)
    want = {}
    for group in per_key(rows).values():
        total, most = 0, -1
        for i, _, x in group:
            total, most = total + x, max(most, x)
            want[i] = (total, most)
    assert {r.id: (r.s, r.m) for r in done.collect()} == want


def test_previous_over_chunks(skewed):
    rows, df = skewed
    placed = ordered.positions(df, ["k"], ["at", "id"])
    done = ordered.with_previous(placed, ["k"], "pos", ["id"], depth=3, chunk=7)
    want = {}
    for group in per_key(rows).values():
        ids = [i for i, _, _ in group]
        for n, i in enumerate(ids):
            want[i] = [ids[n - d] if n >= d else None for d in (1, 2, 3)]
    got = {r.id: [p.id if p else None for p in (r.prev_1, r.prev_2, r.prev_3)] for r in done.collect()}
    assert got == want


def test_last_before_over_cells(skewed):
    rows, df = skewed
    placed = ordered.positions(df, ["k"], ["at", "id"])
    kept = F.when(F.col("x") % 5 == 0, F.col("x"))
    done = ordered.last_before(placed, ["k"], ["pos"], kept, "seen", F.floor(F.col("pos") / 11))
    want = {}
    for group in per_key(rows).values():
        last = None
        for i, _, x in group:
            want[i] = last
            last = x if x % 5 == 0 else last
    assert {r.id: r.seen for r in done.collect()} == want


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, at bigint")
    got = sorted((r.at, r.pos) for r in ordered.positions(df, ["k"], ["at"]).collect())
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_cells_are_even_for_a_hot_key(skewed, spark):
    _, df = skewed
    sizes = [r["count"] for r in ordered.range_cells(df, ["k"], ["at", "id"], 8).groupBy("range_cell").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * 3000 / 8


def test_repeat_attackers(spark):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.8 else "cold", start + datetime.timedelta(seconds=rng.randrange(2000))) for _ in range(600)]
    got = {(r.src, r.ts): r.attacks for r in security.repeat_attackers(spark.createDataFrame(rows, "src string, ts timestamp"), "src", "ts").collect()}
    want = {}
    for src, ts in rows:
        n = sum(s == src and 0 <= (ts - u).total_seconds() < 60 for s, u in rows)
        if n >= 5:
            want[(src, ts)] = n
    assert got == want


def test_loop_in_one_long_run(spark):
    rng = random.Random(3)
    rows = [(1, n + 1, "f", rng.choice("ab"), rng.choice("cd")) for n in range(2000)]
    log = spark.createDataFrame(rows, "run int, seq bigint, field string, old_value string, new_value string")
    done = audit.exact_repeat(log, chunk=100).orderBy("seq").collect()
    seen, last = set(), None
    for r, row in zip(done, rows):
        assert r.last_accepted == last and r.rejected == (row[2:] in seen)
        if row[2:] not in seen:
            last = row[4]
        seen.add(row[2:])


def brute_greedy(items, budget):
    taken = []
    for grp in {i[0] for i in items}:
        left = budget
        for i in sorted((i for i in items if i[0] == grp), key=lambda i: (-i[3] / max(i[2], 1), i[1])):
            if i[2] <= left:
                taken.append(i)
                left -= i[2]
    return sorted(taken)


def test_greedy_is_brute_force(spark):
    rng = random.Random(11)
    items = [("hot" if rng.random() < 0.8 else rng.choice("abc"), n, rng.randrange(0, 40), rng.choice([1, 5, 10, 15])) for n in range(1500)]
    df = spark.createDataFrame(items, "grp string, item bigint, tokens bigint, priority bigint")
    assert sorted(tuple(r) for r in selection.greedy_select(df, 200).collect()) == brute_greedy(items, 200)


def test_knapsack_is_exhaustive(spark):
    rng = random.Random(5)
    items = [(g, g * 100 + n, rng.randrange(1, 30), rng.choice([1, 5, 10, 15])) for g in range(30) for n in range(rng.randrange(1, 11))]
    df = spark.createDataFrame(items, "grp int, item bigint, tokens bigint, priority bigint")

    def totals(selected):
        return {r.grp: r.p for r in selected.groupBy("grp").agg(F.sum("priority").alias("p")).collect()}

    best = totals(selection.exhaustive_select(df, 60))
    assert totals(selection.knapsack_select(df, 60, least=1)) == best
    greedy = totals(selection.greedy_select(df, 60))
    assert all(greedy[g] <= best[g] for g in best)


def test_auto_select_splits_by_size(spark):
    items = [(g, g * 1000 + n, 1 + n % 5, 1 + n % 7) for g, size in ((1, 4), (2, 30), (3, 90)) for n in range(size)]
    df = spark.createDataFrame(items, "grp int, item bigint, tokens bigint, priority bigint")
    found = {(r.grp, r.strategy) for r in selection.auto_select(df, 40).collect()}
    assert found == {(1, "optimal"), (2, "knapsack"), (3, "greedy")}


def test_search_loses_nothing(spark):
    rows = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("id")))
    keys = spark.range(0, 20_000, 97).withColumnRenamed("id", "key").unionByName(spark.createDataFrame([(7,), (None,)], "key bigint"))
    exact = rows.join(keys, rows.k == keys.key, "left_semi").count()
    assert search.exact_verify(rows, "k", keys, "key").count() == exact
    found = search.certainty_search({"a": (rows, "k"), "b": (rows.limit(0), "id"), "c": (rows, "id")}, keys, "key").collect()
    assert sum(r.matches for r in found if r.dataset == "a") == exact
    assert sum(r.matches for r in found if r.dataset == "c") == 208 and {r.dataset for r in found} == {"a", "c"}


def test_interrupted_run_equals_one_run(spark):
    work = spark.range(1000).select((F.col("id") % 7).alias("unit"), "id")

    def process(df):
        return df.groupBy("unit").agg(F.sum("id").alias("total"))

    whole, parts = new_path(spark, "whole"), new_path(spark, "parts")
    one = provenance.resume(spark, work, "unit", process, whole)
    for limit in (F.col("unit") < 3, F.col("unit") < 5, None):
        two = provenance.resume(spark, work, "unit", process, parts, limit)
    assert sorted((r.unit, r.total) for r in one.collect()) == sorted((r.unit, r.total) for r in two.collect())


def test_repeated_run_changes_nothing(spark):
    work = spark.range(100).select((F.col("id") % 5).alias("unit"), "id")
    folder = new_path(spark, "again")
    for _ in range(2):
        done = provenance.resume(spark, work, "unit", lambda df: df, folder)
    assert done.count() == 100
