"""A table kept up to date by micro-batches of changes, in levels that are merged as they fill.

Each micro-batch, reduced to its newest row per key, becomes a run of level 0. As soon as a level holds ``fanout`` runs they are
merged into one run of the next level. So a row is rewritten once per level, about ``log(batches) / log(fanout)``
times however long the stream lives, and a read merges fewer than ``fanout`` runs of each level. Runs are folders that
never change; which of them make up the table stands in a manifest, whose next version is put in place by one atomic
rename. What dies between the writing of a run and its manifest leaves a folder that nothing refers to.

The manifest also holds the last batch number of every stream that writes to the table, so a batch that is handed over again after
a restart changes nothing. Readers of an older version are safe for ``keep_versions`` versions.

A deleted key stays as a row that says so: a change of the same key that arrives late must still lose against it. If the caller
knows that no change before some point can arrive any more, ``settled`` (an SQL condition on a row) lets merges into the
lowest level drop such rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.analytics import latest, union_tables
from tidemark.sources.manifest import Manifests


class UpsertTable:
    """A table of keyed rows in ``folder``; the newest row of a key, by ``order``, counts."""

    def __init__(
        self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str], op: str = "op",
        fanout: int = 4, keep_versions: int = 10, settled: str | None = None,
    ):
        self.spark, self.folder, self.keys, self.order, self.op = spark, folder.rstrip("/"), list(keys), list(order), op
        self.fanout, self.keep_versions, self.settled = fanout, keep_versions, settled
        self.manifests = Manifests(spark, f"{self.folder}/manifest")

    def apply(self, batch: DataFrame, number: int, stream: str = "") -> bool:
        """Adds a micro-batch; false if this batch of this stream is in the table already."""
        version, document = self.manifests.newest()
        streams = document.get("streams", {})
        if streams.get(stream, -1) >= number:
            return False
        run = self._write(latest(batch, self.keys, self.order), 0)
        document = {
            "schema": self._schema(document, batch).jsonValue(),
            "streams": {**streams, stream: number},
            "runs": [*document.get("runs", []), run],
        }
        self._commit(version + 1, document)
        self.compact()
        return True

    def compact(self) -> None:
        """Merges every level that is full into the next one, lowest first."""
        while True:
            version, document = self.manifests.newest()
            levels: dict[int, list[dict]] = {}
            for run in document.get("runs", []):
                levels.setdefault(run["level"], []).append(run)
            full = [level for level, runs in levels.items() if len(runs) >= self.fanout]
            if not full:
                return
            level = min(full)
            rows = self._merged(document, levels[level])
            if self.settled and level == max(levels):
                rows = rows.filter(f"NOT ({self.op} = 'delete' AND coalesce({self.settled}, false))")
            merged = self._write(rows, level + 1)
            rest = [run for run in document["runs"] if run["level"] != level]
            self._commit(version + 1, {**document, "runs": [*rest, merged]})
            self.vacuum()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the table, now or as of a manifest version that is still kept."""
        document = self.manifests.newest()[1] if version is None else self.manifests.read(version)
        if not document:
            raise FileNotFoundError(f"{self.folder} holds no table")
        return self._merged(document, document["runs"]).filter(F.col(self.op) != "delete").drop(self.op)

    def vacuum(self) -> list[str]:
        """Removes old manifest versions, and runs that none of the kept ones names; by the writer only."""
        kept = {run["path"] for document in self.manifests.forget(self.keep_versions) for run in document["runs"]}
        gone = [name for name in self.manifests.folders(f"{self.folder}/runs") if name not in kept]
        for name in gone:
            self.manifests.remove(f"{self.folder}/runs/{name}")
        return gone

    def _commit(self, version: int, document: dict) -> None:
        self.manifests.commit(version, document)

    def _write(self, rows: DataFrame, level: int) -> dict:
        """A run in the order of its keys, so that statistics of its row groups can exclude keys."""
        name = uuid.uuid4().hex[:16]
        rows.sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/runs/{name}")
        return {"path": name, "level": level}

    def _merged(self, document: dict, runs: Sequence[dict]) -> DataFrame:
        schema = T.StructType.fromJson(document["schema"])
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/runs/{run['path']}") for run in runs]
        return latest(union_tables(parts), self.keys, self.order)

    def _schema(self, document: dict, batch: DataFrame) -> T.StructType:
        """All columns so far; a column that came later reads as null in earlier runs."""
        fields = {f.name: f for f in T.StructType.fromJson(document["schema"]).fields} if document else {}
        for field in latest(batch, self.keys, self.order).schema.fields:
            if field.name in fields and fields[field.name].dataType != field.dataType:
                raise TypeError(f"column {field.name} changed from {fields[field.name].dataType} to {field.dataType}")
            fields[field.name] = T.StructField(field.name, field.dataType)
        return T.StructType(list(fields.values()))
