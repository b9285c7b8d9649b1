"""Exact dedup against a persistent digest index.

The index is a Parquet table in a shared folder, bucketed and sorted by the
SHA-256 of the normalised text: one row per distinct text ever seen, with the
document that keeps it, a partition per batch. A batch of new documents is
folded to its distinct digests (map-side, so a group of copies crosses the
network once per task), meets the index in a sort-merge anti-join on the buckets
(the index is not shuffled), and what is new is appended as the batch's
partition. Texts that the index already had are appended to a second table of
the same layout, as counts. Texts never move: only digests do.

A partition is written by one Spark job, so a lost executor or a failed job leaves the
index as it was, and adding the same batch again writes the same partition again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm.stash import id_key, pick, stash
from tieout.session import scratch_path

#: Fixed value: what separates words; each run of it counts as one blank.
BLANKS = r"[\x20\x09-\x0D]+"
_SHAPES = {"known": "digest binary, d bigint, rows bigint, batch bigint", "more": "digest binary, rows bigint, batch bigint"}


def normalised(text: str = "text") -> Column:
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """A digest index at ``path``, in ``buckets`` buckets. Its two tables are named
    in the session's catalog after the path."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """Make the index, or find one that an earlier session left at ``path``.
        The bucket count is fixed when it is made (the session's shuffle width by
        default) and kept beside the tables."""
        path = path.rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place.suffix("/layout/_SUCCESS")):
            stored = spark.read.parquet(f"{path}/layout").first().buckets
            if buckets not in (None, stored):
                raise ValueError(f"{path} has {stored} buckets, not {buckets}")
            buckets = stored
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
        index = DigestIndex(spark, path, buckets)
        for part, shape in _SHAPES.items():
            files.mkdirs(place.suffix(f"/{part}"))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {index._name(part)} ({shape}) USING parquet PARTITIONED BY (batch) "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
            spark.sql(f"MSCK REPAIR TABLE {index._name(part)}")
        return index

    def _name(self, part: str) -> str:
        return f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:20]}_{part}"

    def known(self) -> DataFrame:
        """digest, d (id of the document that keeps the text), rows and batch: one row per distinct text."""
        return self.spark.table(self._name("known"))

    def more(self) -> DataFrame:
        """digest, rows and batch: rows of later batches whose text the index had."""
        return self.spark.table(self._name("more"))

    def next_batch(self) -> int:
        last = self.known().select("batch").union(self.more().select("batch")).agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def groups(self) -> DataFrame:
        """digest, d and rows of all batches, one row per distinct text; both tables share their buckets."""
        again = self.more().groupBy("digest").agg(F.sum("rows").alias("again"))
        every = self.known().join(again.hint("merge"), "digest", "left")
        return every.select("digest", "d", (F.col("rows") + F.coalesce("again", F.lit(0))).alias("rows"))

    def add(self, digests: DataFrame, batch: int) -> None:
        """Index a batch: ``digests`` has digest and d, a row per document. Of equal
        texts in a batch the smallest d keeps the text, and a text that an earlier
        batch (a smaller number) brought stays with that batch's document."""
        groups = digests.groupBy("digest").agg(F.min("d").alias("d"), F.count("*").alias("rows"))
        earlier = self.known().where(F.col("batch") < batch).select("digest").hint("merge")
        fresh = stash(groups.join(earlier, "digest", "left_anti").select("digest", "d", "rows"), "fresh")
        again = groups.join(earlier, "digest", "left_semi").select("digest", "rows")
        for part, rows in (("more", again), ("known", fresh.repartition(self.buckets, "digest"))):
            rows.createOrReplaceTempView(f"{self._name(part)}_rows")
            self.spark.sql(f"INSERT OVERWRITE {self._name(part)} PARTITION (batch = {int(batch)}) SELECT * FROM {self._name(part)}_rows")
            self.spark.catalog.dropTempView(f"{self._name(part)}_rows")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id with null as the smallest id) and digest of every row."""
    rows = pick(docs, {"doc_id": "doc_id", "text": "text"})
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), id_key().cast("bigint").alias("d"), digest().alias("digest"))


def report(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of every row of ``digests``
    (the stored rows of ``fingerprints``), by an index that holds their batches.

    Rows and groups meet by a shuffled join: a digest that holds a third of all
    rows is split by the adaptive skew join. A null doc_id counts as the smallest id
    and keeps its text; rows that repeat id and text are all counted and share
    their result."""
    owner = F.col("g.d")
    met = digests.alias("r").join(stash(index.groups(), "groups").alias("g"), "digest")
    return met.select(F.col("r.doc_id").alias("doc_id"), "digest", F.when(owner != -(2**63), owner).alias("keep_id"), F.col("g.rows").alias("group_size"), (F.col("r.d") == owner).alias("kept"))


def only_new(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the index did not hold before,
    one per text (the smallest doc_id; of rows that repeat it, one). They are the
    index's next batch."""
    batch = index.next_batch()
    index.add(stash(fingerprints(docs), "fingerprints"), batch)
    fresh = index.known().where(F.col("batch") == batch).select("digest", "d")
    keyed = docs.select(id_key().cast("bigint").alias("d"), digest().alias("digest"), F.struct("*").alias("row"))
    return keyed.join(fresh, ["digest", "d"], "left_semi").dropDuplicates(["digest", "d"]).select("row.*")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with digest, keep_id, group_size and kept.

    The rows go into the index as ``batches`` batches in the order of doc_id (equal
    ranges of ids, nulls first), so the smallest doc_id of a text keeps it. Without
    an ``index`` a new one is made in the shared folder; one that holds earlier
    batches goes on from there, and their documents keep their texts. An empty
    table gives no rows."""
    spark = docs.sparkSession
    index = index or DigestIndex.open(spark, scratch_path(spark, "digests"))
    digests = stash(fingerprints(docs), "fingerprints")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [] if low is None else sorted({low + (high - low + 1) * i // batches for i in range(1, batches)})
    first = index.next_batch()
    for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = digests if a is None else digests.where(F.col("d") >= a)
        index.add(part if b is None else part.where(F.col("d") < b), first + i)
    return report(digests, index)
