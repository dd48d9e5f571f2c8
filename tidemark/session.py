"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and a fixed time zone.

    Shuffle partitions are left to the cluster's own setting; adaptive execution coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would not outlive its machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = os.environ.get("TIDEMARK_LOCAL_FOLDER") or tempfile.mkdtemp(prefix="tidemark-")
        os.environ["TIDEMARK_LOCAL_FOLDER"] = folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: A written table of more rows is never broadcast.
MOST_BROADCAST_ROWS = 100_000


def by_rows(written: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A written table as one side of joins that broadcast it at most when it has few rows.

    The planner goes by the size of files, and a few MB of well compressed ids can be millions of rows in the driver's memory.
    """
    return written if written.count() <= most else written.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, dealt to as many tasks as the session shuffles into; rows that agree in ``columns`` (all by default) stay together.

    For a table whose rows each become many: a small, well compressed file is read by one task, however many rows it makes of it. The
    number is named because adaptive execution would put so few bytes together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(columns or df.columns))


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """The rows as written to the shared folder, with the writer's ``options``: computed once, and safe from the loss of any executor.

    ``checkpoint()`` would do the same but computes the rows twice, once to count and once to save.
    """
    path = new_path(df.sparkSession, "step")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
