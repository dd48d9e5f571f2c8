"""What several operators for training text share: reading tables, and broadcasts behind a counted size."""

from __future__ import annotations

import shutil
import tempfile
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.ledger import opened

#: A written table of more rows is never broadcast; joins on it then shuffle.
MOST_BROADCAST_ROWS = 100_000
#: Rows of text handed to a Python worker at once; long texts make larger batches too much for its memory.
BATCH_ROWS = 500
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small(written: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast a written table if it has at most ``most`` rows, else the table as it is."""
    return F.broadcast(written) if written.count() <= most else written


def in_batches(rows: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` on batches of at most ``BATCH_ROWS`` rows, a setting of the session from then on."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return rows.mapInArrow(work, schema)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Python workers get ``rows`` rows at once in the jobs that run inside; the session's own setting is restored after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@lru_cache(maxsize=4)
def mapped(uri: str) -> np.ndarray:
    """The bytes of a file of the shared folder, mapped: all workers of a machine share one copy, which can be read again and so takes no memory of theirs.

    A file of a remote store is copied to a file without a name first, which ends with the mapping.
    """
    store, path = opened(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r").view(np.ndarray)
    with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as source:
        shutil.copyfileobj(source, copy, 1 << 20)
        copy.flush()
        return np.memmap(copy, np.uint8, "r").view(np.ndarray)
