"""Result files and the hashes that tie them to a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, bytes, SHA-256 (one file per task)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("source_file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                        F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def input_manifest(spark: SparkSession, path: str, rows: DataFrame, slot: str = "input") -> DataFrame:
    """Files of an input with hash, size and the rows read from each. ``rows``
    is the table read from them and has ``source_file``."""
    columns = [c for c in rows.columns if c not in ("source_file", "source_row_index")]
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    # The two readers spell a local path differently (file:/x and file:///x).
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    hashed = file_hashes(spark, path).withColumn("_p", plain("source_file"))
    return (hashed.join(counts.select(plain("source_file").alias("_p"), "n_rows"), "_p", "left")
            .select(F.lit(slot).alias("slot"), "file_name", "n_bytes", "sha256", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.lit(len(columns)).cast("bigint").alias("n_columns")))


def write_results(df: DataFrame, path: str, fmt: str = "csv", order: list[str] | None = None) -> str:
    """Write a result table with columns in a stable order. Nested columns go
    to CSV as JSON text."""
    out = df.select(*(order or df.columns))
    if fmt == "csv":
        nested = [c for c, t in out.dtypes if t.startswith(("array", "map", "struct"))]
        out = out.withColumns({c: F.to_json(c) for c in nested}) if nested else out
        out.write.mode("errorifexists").option("header", True).csv(path)
    else:
        out.write.mode("errorifexists").format(fmt).save(path)
    return path


def output_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Hash of every data file under an output folder."""
    return file_hashes(spark, path).where(F.col("file_name").startswith("part-")).select("file_name", "n_bytes", "sha256")
