"""Name similarity: matched characters over all characters (2M/T)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-block similarity of two names; feed it distinct pairs only."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None
                      for x, y in zip(a, b)])


#: Scored pairs that one task remembers.
SCORES_KEPT = 1 << 16


def with_ratio(pairs: DataFrame, a: str, b: str, min_ratio: float) -> DataFrame:
    """``pairs`` whose names in columns a and b reach the ratio, with it as ``ratio``. For very many
    pairs that may repeat: they pass through as they come and wait nowhere; names without the common letters
    that the ratio needs are not compared, and a task scores a pair again only when it forgot it."""

    def score(batches):
        import pyarrow as pa

        seen: dict[tuple[str, str], float | None] = {}
        for batch in batches:
            found = []
            for pair in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                if pair not in seen:
                    if len(seen) >= SCORES_KEPT:
                        seen.clear()
                    both = SequenceMatcher(None, *pair) if None not in pair else None
                    seen[pair] = ratio if both and both.quick_ratio() >= min_ratio and (ratio := both.ratio()) >= min_ratio else None
                found.append(seen[pair])
            ratios = pa.array(found, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ratios], names=[*batch.schema.names, "ratio"]).filter(ratios.is_valid())

    return pairs.mapInArrow(score, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())]))


def few_edits(a: Column, b: Column, min_ratio: float) -> Column:
    """Whether two names are as few edits apart as the ratio needs: what does not match
    can be taken out of either, which is (1 - ratio) of the letters of both."""
    return F.levenshtein(a, b) <= (F.length(a) + F.length(b)) * F.lit(1 - min_ratio) + 1e-9


def ratio_ceiling(a: Column, b: Column) -> Column:
    """What the ratio can reach at most given the two lengths."""
    return F.try_divide(F.least(F.length(a), F.length(b)) * 2.0, F.length(a) + F.length(b))


# ------------------------------------------------------------ candidates for a ratio
#
# A name is the set of its numbered letters ("a1", "a2" for two a). Matched
# characters are letters that both names have, so a ratio asks for so many common
# numbered letters, which is a set overlap: with the letters of all names in one order, rarest
# first, two names of that overlap share a letter among the first few of each.


def numbered_letters(name: Column) -> Column:
    """Each letter with how many of its kind stand up to it; all different."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(
        F.substring(name, i, F.lit(1)), (i - F.length(F.replace(F.substring(name, F.lit(1), i), F.substring(name, i, F.lit(1)), F.lit("")))).cast("string")))


def overlap_needed(n: Column, m: Column, min_ratio: float) -> Column:
    """Common letters that names of n and m letters need for the ratio."""
    return F.ceil((n + m) * F.lit(min_ratio / 2) - 1e-9)


def letter_order(names: DataFrame) -> DataFrame:
    """(letter, names): in how many of ``names`` (name, distinct) each numbered letter stands."""
    return names.select(F.explode(numbered_letters(F.col("name"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("names"))


def prefix_lists(names: DataFrame, order: DataFrame, min_ratio: float) -> DataFrame:
    """(name, letters, n): the first letters of each of ``names`` (name, distinct)
    in the order of rarity, as many as the ratio leaves open; n letters in all."""
    each = names.select("name", F.explode(numbered_letters(F.col("name"))).alias("letter")).join(order, "letter")
    lists = each.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("names", "letter"))).alias("_l"))  # a name's own letters
    n = F.size("_l")
    # the shorter of two names has at least r / (2 - r) of the longer one's letters, and all of them may be needed
    open_ = n - F.ceil(n * F.lit(min_ratio / (2 - min_ratio)) - 1e-9) + 1
    return lists.select("name", F.slice("_l", F.lit(1), F.least(open_, n).cast("int"))["letter"].alias("letters"), n.alias("n"))


def prefix_rows(names: DataFrame, order: DataFrame, min_ratio: float) -> DataFrame:
    """(name, letter, place, n): ``prefix_lists`` as a row per letter."""
    return prefix_lists(names, order, min_ratio).select("name", F.posexplode("letters").alias("place", "letter"), "n")


def can_reach(n: Column, m: Column, place_a: Column, place_b: Column, min_ratio: float) -> Column:
    """Whether names that first meet at these places have letters enough behind them."""
    return F.least(n - place_a, m - place_b) >= overlap_needed(n, m, min_ratio)


def enough_letters(a: Column, b: Column, min_ratio: float) -> Column:
    """Whether two names have the common letters that the ratio needs."""
    both = F.size(F.array_intersect(numbered_letters(a), numbered_letters(b)))
    return both >= overlap_needed(F.length(a), F.length(b), min_ratio)


def ratio_candidates(left: DataFrame, right: DataFrame, min_ratio: float) -> DataFrame:
    """(a, b): pairs of names (column ``name`` of either side) that may have the
    ratio; every pair that has it is among them."""
    l, r = left.select("name").where("name <> ''").distinct(), right.select("name").where("name <> ''").distinct()
    order = letter_order(l.union(r))
    sides = [prefix_rows(x, order, min_ratio).select("letter", *[F.col(c).alias(f"{c}_{k}") for c in ("name", "place", "n")]) for x, k in ((l, "a"), (r, "b"))]
    met = sides[0].join(sides[1], "letter").where(can_reach(F.col("n_a"), F.col("n_b"), F.col("place_a"), F.col("place_b"), min_ratio))
    pairs = met.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()
    return pairs.where(enough_letters(F.col("a"), F.col("b"), min_ratio))


# ------------------------------------------------------------ candidates for a part


def grams(name: Column) -> Column:
    """Pairs of neighbouring letters, and each letter on its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    return F.array_distinct(F.concat(pairs, F.split(name, "")))


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): the short names that stand within a long one. A short name looks
    only under its rarest pair of letters (its letter, if it has one)."""
    known = long.select(F.col("name").alias("long"), F.explode(grams(F.col("name"))).alias("gram"))
    often = known.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.least(F.length("name"), F.lit(2))
    asked = short.select("name", F.explode(F.filter(grams(F.col("name")), lambda g: F.length(g) == size)).alias("gram")).join(often, "gram")
    rarest = asked.groupBy(F.col("name").alias("short")).agg(F.min(F.struct("n", "gram")).alias("_g"))
    return rarest.select("short", F.col("_g.gram").alias("gram")).join(known, "gram").where(F.contains("long", "short")).select("short", "long")


def containing_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b), distinct: names of which one stands within the other."""
    l, r = left.select("name").where("name <> ''").distinct(), right.select("name").where("name <> ''").distinct()
    one = _inside(l, r).select(F.col("short").alias("a"), F.col("long").alias("b"))
    return one.union(_inside(r, l).select(F.col("long").alias("a"), F.col("short").alias("b"))).distinct()
