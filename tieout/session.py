"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tieout", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators expect. On a cluster the master
    and the shuffle width come from the submit command, not from here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the checkpoint
    folder set on the context. A machine-local folder is used only in local mode
    with both absent (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"tieout-{os.getpid()}")
    return "file://" + folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so later rounds neither replan
    nor recompute it and a lost executor costs nothing but a re-read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """A plain file scan on at least as many tasks as there are cores, for work
    that is heavy per row. A large input has more splits than that already and
    is returned as it is; a small single-split file is dealt out once. With
    ``rows_per_task`` the tasks grow with the rows (counted in the file footers)."""
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        tasks = max(tasks, -(-scan.count() // rows_per_task))
    return scan if scan.rdd.getNumPartitions() >= tasks else scan.repartition(tasks)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast a materialised table of at most ``max_rows`` rows; a larger one
    is left to a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
