"""Band join: equal keys plus ``|left - right| <= width`` on number or date columns.

``abs(a - b) <= w`` alone makes Spark compare every row with every row. Each
band is cut into buckets of a few widths and the right side is copied to every
bucket that its reach touches (one and a half on average), which leaves an
equi-join with an exact residual test.

The callers feed *cells* (distinct values with counts), not rows: however many
rows share a value they are one cell, so the number of partners of a cell is
limited by the width of the band in cents and days and not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of one bucket: the wider, the fewer copies of the right side and the more pairs to test.
BUCKET_WIDTHS = 4
#: The same where both sides share one deal: every row travels, so copies cost more than tests.
SHARED_WIDTHS = 16


@dataclass(frozen=True)
class Band:
    left: str
    right: str
    width: object  # int days for dates, number or Decimal for amounts


def _number(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    return F.unix_date(col) if dict(df.dtypes)[name] == "date" else col


def bucket(value: Column, width, widths: int = BUCKET_WIDTHS) -> Column:
    return F.floor(value / F.lit(width * widths)).cast("bigint")


def buckets_in_reach(value: Column, width, reach, widths: int = BUCKET_WIDTHS) -> Column:
    """Every bucket that holds a value at most ``reach`` away."""
    return F.sequence(bucket(value - reach, width, widths), bucket(value + reach, width, widths))


def _reach(df: DataFrame, columns: set[str], width):
    # the difference of two floating numbers may be rounded down to the width
    return width * 2 if {t for c, t in df.dtypes if c in columns} & {"float", "double"} else width


def shared_buckets(df: DataFrame, widths: dict[str, object]) -> tuple[DataFrame, list[str]]:
    """A table that is to meet itself, dealt out once for both sides: each row in its own
    bucket (``_own`` 1) and as a copy in every other one within reach (0), under the key
    columns returned. Two rows that are near share the own bucket of either."""
    keys, own = [], F.lit(True)
    for i, (name, width) in enumerate(widths.items()):
        value, key = _number(df, name), f"_k{i}"
        if width:
            reach = F.lit(_reach(df, {name}, width))
            df = df.withColumn(key, F.explode(buckets_in_reach(value, width, reach, SHARED_WIDTHS)))
            own &= F.col(key) == bucket(value, width, SHARED_WIDTHS)
        else:
            df = df.withColumn(key, value)
        keys.append(key)
    return df.withColumn("_own", own.cast("int")), keys


def band_join(left: DataFrame, right: DataFrame, eq: list[tuple[str, str]], bands: list[Band]) -> DataFrame:
    """Inner join; column names of both sides must differ. Each pair comes once."""
    conds = [F.col(a) == F.col(b) for a, b in eq]
    drop = []
    for i, band in enumerate(bands):
        lv, rv = _number(left, band.left), _number(right, band.right)
        if not band.width:
            conds.append(F.col(band.left) == F.col(band.right))
            continue
        width = F.lit(band.width)
        reach = F.lit(max(_reach(left, {band.left}, band.width), _reach(right, {band.right}, band.width)))
        lb, rb = f"_lb{i}", f"_rb{i}"
        left = left.withColumn(lb, bucket(lv, band.width))
        right = right.withColumn(rb, F.explode(buckets_in_reach(rv, band.width, reach)))
        conds += [F.col(lb) == F.col(rb), F.abs(lv - rv) <= width]
        drop += [lb, rb]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return left.join(right, cond).drop(*drop)
