"""A streaming source over a growing folder of Parquet files, with offsets of its own and batches bounded in bytes.

Spark's file source admits whole files by count. Here a file's row groups are admitted one by one: a batch takes row groups
until ``maxBytes`` of data are reached (one at least), so one huge file is spread over many batches and many tiny
files share one.

Files get numbers in the order in which they were first seen; this ledger is kept in ``ledger``, a folder of the
stream's own on the shared store, in pieces that are never changed. An offset is ``(file, group)``: all row groups before it are
done. The ledger does not depend on names or times of files, so nothing that arrives with an old name is missed.
The engine logs the end of a batch before it plans it, and planning writes the same end to the ledger's cursor, so after a restart both
agree; a batch that died is planned again from the engine's log.

The engine takes the batches of a stream one after the other, and each costs its log, its plan and its job however few its bytes are. So
row groups can be dealt to several streams (``lanes``) that run side by side, each with batches, ledger and log of its own;
a row group is in exactly one lane, whenever its file comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "tidemark_ledger"
#: Row groups of one batch are dealt to tasks of about so many bytes.
TASK_BYTES = 32 << 20
BATCH_BYTES = 256 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@lru_cache(maxsize=2)
def parquet_file(folder: str, name: str, size: int, changed: int | None) -> pq.ParquetFile:
    """An open file with its footer, kept for the next batches of this worker: a footer grows with its file, and every batch would read it again."""
    store, folder = opened(folder)
    return pq.ParquetFile(store.open_input_file(f"{folder}/{name}"))


class Groups(InputPartition):
    """Row groups of some files."""

    def __init__(self, items: Sequence[tuple[str, int]]):
        super().__init__(None)
        self.items = list(items)


class LedgerReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.folder = schema, options["path"]
        self.batch_bytes, self.task_bytes = int(options.get("maxBytes", BATCH_BYTES)), int(options.get("taskBytes", TASK_BYTES))
        self.suffix = options.get("suffix", ".parquet")
        self.lane, self.lanes = int(options.get("lane", 0)), int(options.get("lanes", 1))
        self.store, self.ledger = opened(options["ledger"])
        self.store.create_dir(self.ledger, recursive=True)
        self.files, self.sizes = self._known(), {}
        cursor = self._read("cursor.json")
        self.at = (cursor["file"], cursor["group"]) if cursor else (0, 0)

    # the ledger's own files

    def _read(self, name: str):
        if self.store.get_file_info(f"{self.ledger}/{name}").type == fs.FileType.NotFound:
            return None
        with self.store.open_input_stream(f"{self.ledger}/{name}") as stream:
            return json.loads(stream.read())

    def _write(self, name: str, document) -> None:
        draft = f"{self.ledger}/.{name}"
        with self.store.open_output_stream(draft) as stream:
            stream.write(json.dumps(document).encode())
        self.store.move(draft, f"{self.ledger}/{name}")

    def _known(self) -> list[str]:
        infos = self.store.get_file_info(fs.FileSelector(self.ledger))
        pieces = sorted(i.base_name for i in infos if i.base_name.startswith("files-"))
        return [name for piece in pieces for name in self._read(piece)]

    # offsets

    def initialOffset(self) -> dict:
        return {"file": 0, "group": 0}

    def latestOffset(self) -> dict:
        self._discover()
        file, group = self.at
        taken = 0
        while file < len(self.files):
            for size in self._sizes(file)[group:]:
                if self._own(file, group):
                    if taken and taken + size > self.batch_bytes:
                        return {"file": file, "group": group}
                    taken += size
                group += 1
            file, group = file + 1, 0
        return {"file": file, "group": group}

    def _own(self, file: int, group: int) -> bool:
        return (file + group) % self.lanes == self.lane

    def _discover(self) -> None:
        """Numbers the files that were not seen before, in the order of their times and names."""
        store, folder = opened(self.folder)
        known = set(self.files)
        infos = [i for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and i.base_name.endswith(self.suffix) and i.base_name[0] not in "._"]
        new = [i.base_name for i in sorted(infos, key=lambda i: (i.mtime_ns or 0, i.base_name)) if i.base_name not in known]
        if new:
            self._write(f"files-{len(self.files):012d}.json", new)
            self.files += new

    def _sizes(self, file: int) -> list[int]:
        """Bytes of each row group, from the file's footer."""
        if file not in self.sizes:
            store, folder = opened(self.folder)
            with store.open_input_file(f"{folder}/{self.files[file]}") as source:
                footer = pq.ParquetFile(source).metadata
                self.sizes = {k: v for k, v in self.sizes.items() if k >= self.at[0]} | {file: [footer.row_group(g).total_byte_size for g in range(footer.num_row_groups)]}
        return self.sizes[file]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._write("cursor.json", end)
        self.at = (end["file"], end["group"])
        parts, own, size = [], [], 0
        for file in range(start["file"], min(end["file"] + 1, len(self.files))):
            sizes = self._sizes(file)
            first = start["group"] if file == start["file"] else 0
            last = end["group"] if file == end["file"] else len(sizes)
            for group in filter(lambda g: self._own(file, g), range(first, last)):  # noqa: B023
                if own and size + sizes[group] > self.task_bytes:
                    parts.append(Groups(own))
                    own, size = [], 0
                own.append((self.files[file], group))
                size += sizes[group]
        return [*parts, Groups(own)] if own else parts

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        store, folder = opened(self.folder)
        schema = to_arrow_schema(self.schema)
        for name, items in groupby(partition.items, lambda item: item[0]):
            info = store.get_file_info(f"{folder}/{name}")
            file = parquet_file(self.folder, name, info.size, info.mtime_ns)
            there = set(file.schema_arrow.names)
            for _, group in items:
                for batch in file.iter_batches(row_groups=[group], columns=[f.name for f in schema if f.name in there]):
                    columns = [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def commit(self, end: dict) -> None:
        """Nothing to release: pieces of the ledger are never changed."""


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("give the schema of the stream")

    def streamReader(self, schema: T.StructType) -> LedgerReader:
        return LedgerReader(schema, self.options)


def ledger_stream(spark: SparkSession, folder: str, schema: T.StructType, ledger: str, batch_bytes: int = BATCH_BYTES, **options) -> DataFrame:
    """A stream of the Parquet files of ``folder``, with at most ``batch_bytes`` a batch (or one row group); a column that a file lacks is null."""
    return _stream(spark, LedgerSource, folder, schema, ledger, batch_bytes, **options)


def _stream(spark: SparkSession, source: type[LedgerSource], folder: str, schema: T.StructType, ledger: str, batch_bytes: int, **options) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).schema(schema).option("ledger", ledger).option("maxBytes", batch_bytes)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(folder)


def lane_streams(spark: SparkSession, folder: str, schema: T.StructType, ledger: str, lanes: int, batch_bytes: int = BATCH_BYTES, **options) -> list[DataFrame]:
    """``ledger_stream`` dealt to ``lanes`` streams, which hold each row group once between them; the batches of each are bounded alike.

    Each is a source with a name of its own: streams of one registered source share its environment, which the engine changes while it plans.
    """

    def source(lane):
        return type(f"LedgerSource{lane}", (LedgerSource,), {"name": classmethod(lambda cls: f"{FORMAT}_{lane}")})

    return [_stream(spark, source(lane), folder, schema, f"{ledger}/lane={lane}", batch_bytes, lane=lane, lanes=lanes, **options) for lane in range(lanes)]


def drain(stream: DataFrame, each, checkpoint: str) -> None:
    """Hands each micro-batch to ``each`` until the source has nothing more.

    ``availableNow`` asks such a source for its end only once and so would take one batch; this
    runs batch after batch and stops when all are done.
    """
    drain_lanes([stream], lambda lane, batch, number: each(batch, number), lambda lane: checkpoint)


def drain_lanes(streams: Sequence[DataFrame], each, checkpoint) -> None:
    """The same for several streams side by side: ``each(lane, batch, number)``, and ``checkpoint(lane)`` names the folder of each."""
    queries = []
    try:
        for lane, stream in enumerate(streams):
            queries.append(stream.writeStream.foreachBatch(partial(each, lane)).option("checkpointLocation", checkpoint(lane)).start())
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
