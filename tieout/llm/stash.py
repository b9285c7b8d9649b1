"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.session import scratch_path


#: Spark removes the shuffle files of a finished write where this is on.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: later steps
    neither recompute it nor depend on the executors that made it. Its path is
    added to ``passing``, for ``discard``. The shuffle files of the write are not
    needed afterwards and go at once."""
    path = scratch_path(df.sparkSession, name)
    if passing is not None:
        passing.append(path)
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, passing: list[str]) -> None:
    """Delete tables that ``stash`` wrote and nothing reads any more."""
    for path in passing:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_key(text: str = "text") -> Column:
    """32-bit hash of a text: with ``doc_id`` it tells rows apart that share a
    doc_id. Rows with equal doc_id and text are one document."""
    return F.hash(F.coalesce(F.col(text), F.lit("")))


def id_key(doc_id: str = "doc_id") -> Column:
    """``doc_id`` for joins and order: a null comes before all numbers."""
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)))


def pick(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The given columns under the operator's own names (bare columns only), so
    that further columns of the caller cannot clash with the operator's."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in names.items()])


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
