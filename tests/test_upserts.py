"""The levelled upsert table: bounded reads, crashes, repeats, late changes, versions."""

import random

import pytest

from tidemark.session import new_path
from tidemark.sources.manifest import Conflict, Manifests
from tidemark.streaming.upserts import UpsertTable

SCHEMA = "key int, version bigint, op string, value int"


def changes(seed, batches, rows, keys):
    rng = random.Random(seed)
    numbers = list(range(batches * rows))
    rng.shuffle(numbers)  # versions arrive in any order
    return [[(rng.randrange(keys), v, rng.choice(["upsert", "upsert", "delete"]), rng.randrange(100)) for v in numbers[b * rows : (b + 1) * rows]] for b in range(batches)]


def want(parts):
    newest = {}
    for row in sorted((r for part in parts for r in part), key=lambda r: r[1]):
        newest[row[0]] = row
    return sorted((k, v, x) for k, v, op, x in newest.values() if op != "delete")


def got(table, version=None):
    return sorted(tuple(r) for r in table.read(version).select("key", "version", "value").collect())


def table_in(spark, name, **options):
    return UpsertTable(spark, new_path(spark, name), ["key"], ["version"], **options)


def test_two_hundred_batches_read_a_bounded_number_of_files(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        table, parts = table_in(spark, "levels", fanout=4), changes(1, 200, 5, 120)
        most = 0
        for number, part in enumerate(parts):
            assert table.apply(spark.createDataFrame(part, SCHEMA).coalesce(1), number)
            runs = table.manifests.newest()[1]["runs"]
            most = max(most, len(runs))
            if number in (0, 63, 101):
                assert got(table) == want(parts[: number + 1])
        assert got(table) == want(parts)
        assert most <= 3 * 4  # three runs of each of four levels
        assert len(table.read().inputFiles()) <= 2 * most
        assert len(table.manifests.versions()) <= 12
        assert len(table.manifests.folders(f"{table.folder}/runs")) <= most + 4 * 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


class Crash(Exception):
    pass


def test_a_crash_between_merge_and_manifest_changes_nothing(spark, monkeypatch):
    table, parts = table_in(spark, "crash", fanout=3), changes(2, 9, 6, 20)
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    for number in (0, 1):
        table.apply(frames[number], number)
    commit, calls = UpsertTable._commit, []

    def dies(self, version, document):
        calls.append(version)
        if len(calls) == 2:  # the first call is the batch's own
            raise Crash
        commit(self, version, document)

    monkeypatch.setattr(UpsertTable, "_commit", dies)
    with pytest.raises(Crash):
        table.apply(frames[2], 2)
    monkeypatch.setattr(UpsertTable, "_commit", commit)
    again = UpsertTable(spark, table.folder, ["key"], ["version"], fanout=3)
    assert got(again) == want(parts[:3])
    assert not again.apply(frames[2], 2)  # the batch is in, although its merge died
    left = set(again.manifests.folders(f"{again.folder}/runs"))
    for number in range(3, 9):
        again.apply(frames[number], number)
    assert got(again) == want(parts)
    again.keep_versions = 1
    again.vacuum()
    assert got(again) == want(parts)
    assert not left & set(again.manifests.folders(f"{again.folder}/runs"))


def test_a_crash_before_the_manifest_of_a_batch_is_repeated(spark, monkeypatch):
    table, parts = table_in(spark, "before"), changes(3, 2, 8, 10)
    table.apply(spark.createDataFrame(parts[0], SCHEMA), 0)
    commit = UpsertTable._commit

    def dies(self, version, document):
        raise Crash

    monkeypatch.setattr(UpsertTable, "_commit", dies)
    with pytest.raises(Crash):
        table.apply(spark.createDataFrame(parts[1], SCHEMA), 1)
    monkeypatch.setattr(UpsertTable, "_commit", commit)
    assert got(table) == want(parts[:1])
    assert table.apply(spark.createDataFrame(parts[1], SCHEMA), 1)
    assert got(table) == want(parts)


def test_late_changes_lose_against_deletes_until_settled(spark):
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    for settled, alive in ((None, []), ("version < 100", [(1, 3, 30)])):
        table = table_in(spark, "late", fanout=2, settled=settled)
        table.apply(rows((1, 5, "delete", 0)), 0)
        table.apply(rows((2, 6, "delete", 0)), 1)  # both merge into the lowest level
        table.apply(rows((1, 3, "upsert", 30)), 2)
        assert got(table) == alive


def test_versions_streams_and_new_columns(spark):
    table = table_in(spark, "versions")
    table.apply(spark.createDataFrame([(1, 1, "upsert", 10)], SCHEMA), 0, "a")
    version = table.manifests.newest()[0]
    assert table.apply(spark.createDataFrame([(1, 2, "upsert", 20)], SCHEMA), 0, "b")  # another stream counts its own batches
    assert not table.apply(spark.createDataFrame([(1, 9, "upsert", 90)], SCHEMA), 0, "b")
    table.apply(spark.createDataFrame([(2, 3, "upsert", 30, "x")], SCHEMA + ", note string"), 1, "a")
    assert got(table) == [(1, 2, 20), (2, 3, 30)] and got(table, version) == [(1, 1, 10)]
    assert {r.key: r.note for r in table.read().collect()} == {1: None, 2: "x"}
    with pytest.raises(TypeError):
        table.apply(spark.createDataFrame([(2, 3, "upsert", "text")], "key int, version bigint, op string, value string"), 2, "a")


def test_one_of_two_writers_is_told(spark):
    manifests = Manifests(spark, new_path(spark, "manifest"))
    assert manifests.newest() == (0, {})
    manifests.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        manifests.commit(1, {"a": 2})
    assert manifests.newest() == (1, {"a": "é"})
    manifests.commit(2, {})
    assert manifests.forget(1) == [{}] and manifests.versions() == [2]
