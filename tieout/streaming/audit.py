"""Audit events as a stream: the append-only log and the status of every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.operators import runs
from tieout.session import cut_lineage

EVENT_SCHEMA = "run_id bigint, ts timestamp_ntz, seq bigint, action string"


def audit_append(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = EVENT_SCHEMA) -> None:
    """Append the events of every file new in ``source`` to ``target`` and stop.

    The checkpoint remembers what was read and the file sink commits whole
    batches, so a restart neither loses nor repeats an event.
    """
    events = spark.readStream.schema(schema).parquet(source)
    query = (events.withColumn("event_date", F.to_date("ts")).writeStream.format("parquet").partitionBy("event_date")
             .option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def audit_trail(spark: SparkSession, target: str, run_id: int | None = None) -> DataFrame:
    """Events of one run (or all) in time order."""
    events = spark.read.parquet(target)
    if run_id is not None:
        events = events.where(F.col("run_id") == run_id)
    return events.select("run_id", "ts", "seq", "action").orderBy("run_id", "ts", "seq")


def follow_run_status(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = EVENT_SCHEMA, files_per_batch: int | None = None) -> None:
    """Fold the events of every file new in ``source`` into the status of their runs and stop.

    The state store keeps one row per run: how many events it had, its last
    action and last decision with their times, and whether anybody took it up.
    Events may come late or in any order, the latest time counts. Each
    micro-batch writes the runs that it changed to a folder of its own under
    ``target``; a batch that a restart repeats writes the same folder again, so
    no status is lost or counted twice.
    """
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    query = (runs.run_status(events).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_run_status(spark: SparkSession, target: str) -> DataFrame:
    """The latest status that ``follow_run_status`` wrote for each run, in the columns of ``runs.run_status``."""
    written = spark.read.parquet(target)
    names = [c for c in written.columns if c != "batch"]
    last = written.groupBy("run_id").agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return last.select("_r.*")


def fold_run_status(spark: SparkSession, target: str) -> None:
    """Rewrite the folders under ``target`` as one, with the latest row of each run, so that
    reading stays as large as the runs and not as the batches. Not while a stream writes."""
    last = spark.read.parquet(target).select("batch").agg(F.max("batch")).first()[0]
    if last is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(target)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) < last]
        status = cut_lineage(current_run_status(spark, target))
        status.write.mode("overwrite").parquet(f"{target}/batch={last}")
        for path in old:
            files.delete(path, True)
