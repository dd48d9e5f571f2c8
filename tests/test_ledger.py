"""The byte-bounded streaming source: admission, restarts, crashes, late files and late rows."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import new_path
from tidemark.sources import ledger
from tidemark.sources.ledger import Groups, LedgerReader, drain, drain_lanes, lane_streams, ledger_stream

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("note", T.StringType())])
START = datetime.datetime(2024, 1, 1)


def put(folder, name, ids, rows_per_group=10, minutes=0, columns=("id", "ts", "note")):
    os.makedirs(folder, exist_ok=True)
    data = {"id": list(ids), "ts": [START + datetime.timedelta(minutes=minutes + i) for i in range(len(ids))], "note": [f"n{i}" * 20 for i in ids]}
    table = pa.table({c: data[c] for c in columns})
    pq.write_table(table, f"{folder}/.{name}", row_group_size=rows_per_group)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def group_bytes(folder):
    footers = [pq.ParquetFile(f"{folder}/{n}").metadata for n in os.listdir(folder) if n.endswith(".parquet")]
    return [f.row_group(g).total_byte_size for f in footers for g in range(f.num_row_groups)]


def run(spark, base, most, batches, fail_at=None):
    def each(batch, number):
        rows = [(r.id, r.note) for r in batch.select("id", "note").collect()]
        if number == fail_at:
            raise RuntimeError("lost")
        batches[number] = rows

    drain(ledger_stream(spark, f"{base}/in", SCHEMA, f"{base}/ledger", most), each, f"{base}/checkpoint")


def test_one_huge_file_is_spread_and_small_files_share_a_batch(spark):
    base, batches = new_path(spark, "ledger"), {}
    put(f"{base}/in", "huge.parquet", range(100))
    for k in range(6):
        put(f"{base}/in", f"small{k}.parquet", range(100 + 2 * k, 102 + 2 * k))
    sizes = group_bytes(f"{base}/in")
    most = 3 * max(sizes)
    run(spark, base, most, batches)
    assert sorted(i for rows in batches.values() for i, _ in rows) == list(range(112))
    per_id = max(sizes) / 10
    assert len(batches) >= 4 and all(len(rows) * per_id <= most * 1.05 or len(rows) <= 12 * 3 for rows in batches.values())
    assert max(len(rows) for rows in batches.values()) <= 40


def test_restarts_crashes_and_files_with_old_names(spark):
    base, batches = new_path(spark, "ledger"), {}
    put(f"{base}/in", "m.parquet", range(40))
    most = max(group_bytes(f"{base}/in"))
    with pytest.raises(Exception, match="lost"):
        run(spark, base, most, batches, fail_at=2)
    assert sorted(batches) == [0, 1]
    put(f"{base}/in", "a.parquet", range(40, 55))  # sorts before what was read already
    run(spark, base, most, batches)
    assert sorted(i for rows in batches.values() for i, _ in rows) == list(range(55))
    done = dict(batches)
    run(spark, base, most, batches)
    assert batches == done  # nothing new, nothing again
    put(f"{base}/in", "b.parquet", range(55, 60), columns=("id", "ts"))
    run(spark, base, most, batches)
    new = [row for number, rows in batches.items() if number not in done for row in rows]
    assert sorted(new) == [(i, None) for i in range(55, 60)]


def test_a_reader_goes_on_from_its_cursor(tmp_path):
    put(str(tmp_path / "in"), "x.parquet", range(50))
    most = 2 * max(group_bytes(str(tmp_path / "in")))
    options = {"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger"), "maxBytes": str(most)}
    reader, at, offsets = LedgerReader(SCHEMA, options), {"file": 0, "group": 0}, []
    for _ in range(3):
        end = LedgerReader(SCHEMA, options).latestOffset()  # a new process each time
        assert end == reader.latestOffset() == LedgerReader(SCHEMA, options).latestOffset()
        rows = [i for part in reader.partitions(at, end) for batch in reader.read(part) for i in batch.column("id").to_pylist()]
        offsets.append((end, rows))
        at = end
    assert [rows for _, rows in offsets] == [list(range(20)), list(range(20, 40)), list(range(40, 50))]
    assert reader.latestOffset() == at == {"file": 1, "group": 0}
    assert list(reader.partitions(at, at)) == []


def test_late_rows_are_dropped_by_the_watermark(spark):
    base = new_path(spark, "ledger")
    stream = ledger_stream(spark, f"{base}/in", SCHEMA, f"{base}/ledger")
    counted = stream.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    seen = {}

    def each(batch, number):
        seen.update({r.window.start: r.n for r in batch.collect()})

    for name, ids, minutes in (("one", range(60), 0), ("two", range(60, 90), 200), ("late", range(90, 95), 0), ("end", range(95, 96), 900)):
        put(f"{base}/in", f"{name}.parquet", ids, minutes=minutes)
        query = counted.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{base}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
    assert seen[START] == 30 and sum(seen.values()) == 90  # the five late rows are nowhere


def test_empty_folder(spark):
    base, batches = new_path(spark, "ledger"), {}
    os.makedirs(f"{base}/in")
    run(spark, base, 1000, batches)
    assert not any(batches.values())


@pytest.mark.parametrize("lanes", [1, 3])
def test_lanes_hold_each_row_group_once_in_bounded_batches(tmp_path, lanes):
    put(str(tmp_path / "in"), "x.parquet", range(70))
    for k in range(5):
        put(str(tmp_path / "in"), f"y{k}.parquet", [100 + k])
    footers = {f"{n}.parquet": pq.ParquetFile(tmp_path / "in" / f"{n}.parquet").metadata for n in ("x", "y0", "y1", "y2", "y3", "y4")}
    sizes = {(n, g): f.row_group(g).total_byte_size for n, f in footers.items() for g in range(f.num_row_groups)}
    seen = []
    for lane in range(lanes):
        options = {"path": str(tmp_path / "in"), "ledger": str(tmp_path / f"ledger{lane}"), "maxBytes": str(2 * max(sizes.values())), "lane": str(lane), "lanes": str(lanes)}
        reader, at = LedgerReader(SCHEMA, options), {"file": 0, "group": 0}
        while (end := reader.latestOffset()) != at:
            groups = [item for part in reader.partitions(at, end) for item in part.items]
            assert sum(sizes[item] for item in groups) <= 2 * max(sizes.values())
            seen.append(groups)
            at = end
    assert sorted(item for groups in seen for item in groups) == sorted(sizes) and max(map(len, seen)) > 1


def test_lanes_run_side_by_side_and_go_on_after_a_restart(spark):
    base, batches = new_path(spark, "ledger"), {}
    put(f"{base}/in", "m.parquet", range(60))
    most = max(group_bytes(f"{base}/in"))

    def each(lane, batch, number):
        batches[lane, number] = [r.id for r in batch.select("id").collect()]

    def go():
        drain_lanes(lane_streams(spark, f"{base}/in", SCHEMA, f"{base}/ledger", 3, most), each, lambda lane: f"{base}/checkpoint/{lane}")

    go()
    assert sorted(i for rows in batches.values() for i in rows) == list(range(60))
    assert {lane for (lane, _), rows in batches.items() if rows} == {0, 1, 2} and max(map(len, batches.values())) == 10
    put(f"{base}/in", "a.parquet", range(60, 95))
    go()
    assert sorted(i for rows in batches.values() for i in rows) == list(range(95))


def test_a_worker_reads_a_footer_once_for_all_batches(tmp_path, monkeypatch):
    put(str(tmp_path / "in"), "x.parquet", range(40))
    reader = LedgerReader(SCHEMA, {"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger")})
    opened, file = [], pq.ParquetFile
    monkeypatch.setattr(ledger.pq, "ParquetFile", lambda source: opened.append(source) or file(source))
    batches = [[i for batch in reader.read(Groups([("x.parquet", g)])) for i in batch.column("id").to_pylist()] for g in range(4)]
    assert sum(batches, []) == list(range(40)) and len(opened) == 1
