"""Ranks and running sums by file order that survive a hot key.

A window over one key puts that key's rows into one task. Here each key is cut
into chunks of consecutive rows: the window runs per (key, chunk), and a second,
small window over the chunk totals supplies what came before the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CHUNK_ROWS = 1 << 20


def chunk_of(order: Column | str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a numeric order column (never decreasing along it)."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(rows)).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
            sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """Add inclusive running sums (and a 1-based rank) per key in ``order``.

    ``keys`` must not be null. ``chunk`` must not decrease along ``order``.
    """
    values = dict(sums)
    if rank:
        values[rank] = F.lit(1).cast("bigint")
    part = [*keys, "_chunk"]
    base = df.withColumn("_chunk", chunk)
    for name, value in values.items():
        base = base.withColumn(f"_v_{name}", value)

    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in values])

    totals = base.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values])

    joined = local.join(offsets, part, "left")
    out = []
    for name in values:
        value = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_o_{name}"), F.lit(0))
        out.append((value.cast("bigint") if name == rank else value).alias(name))
    return joined.select(*df.columns, *out)


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn") -> DataFrame:
    """1-based position within the key, in ``order``."""
    return running(df, keys, order, chunk, {}, rank=name)


def keep_last(df: DataFrame, keys: list[str], order: Column, value_cols: list[str]) -> DataFrame:
    """One row per key: the values of the last row in ``order``. An aggregate,
    so each task sends one candidate per key and no key is ever collected."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in value_cols])


def keep_first(df: DataFrame, keys: list[str], order: Column, value_cols: list[str]) -> DataFrame:
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*value_cols), order).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in value_cols])
