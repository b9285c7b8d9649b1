"""Budget against actuals.

Both tables carry some of the key columns (fund, account, department, object),
``row_id`` (file order) and ``amount``. A key listed twice keeps its last row.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators.ordered import keep_last, running
from tieout.operators.profiling import TOTAL_LABEL
from tieout.session import broadcast_if_small, cut_lineage

KEY_COLUMNS = ("fund", "account", "department", "object")

# Default thresholds.
DOLLAR_THRESHOLD = Decimal("10000")
PCT_THRESHOLD = 10.0
ROLLUP_REL_TOL = Decimal("0.005")
ROLLUP_MIN_CHILDREN = 2
BASIS_ROWCOUNT_RATIO = 3.0
BASIS_MAGNITUDE_RATIO = 8.0

SUM_TYPE = "decimal(28,2)"

#: Rows of a group that are compared where they are.
GROUP_ROWS = 128


def shared_keys(budget: DataFrame, actuals: DataFrame) -> list[str]:
    return [k for k in KEY_COLUMNS if k in budget.columns and k in actuals.columns]


def _is_total_row(df: DataFrame, keys: list[str]) -> Column:
    """All keys blank, or a total / footer label in any cell."""
    no_key = reduce(lambda a, b: a & b, [s.is_blank(k) for k in keys])
    texts = [c for c, t in df.dtypes if t == "string" and c != "row_id"]
    label = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(TOTAL_LABEL), F.lit(False)) for c in texts])
    return no_key | label


def report_total_rows_skipped(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total and footer lines, which stay out of the comparison."""
    return df.where(_is_total_row(df, keys))


def account_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """One line per key: totals left out, the last row of a repeated key kept."""
    lines = df.where(~_is_total_row(df, keys)).select(*[s.text_key(k).alias(k) for k in keys], "row_id", "amount")
    return keep_last(lines, keys, F.col("row_id"), ["row_id", "amount"])


def budget_vs_actual(budget: DataFrame, actuals: DataFrame, dollar=DOLLAR_THRESHOLD, pct: float = PCT_THRESHOLD) -> DataFrame:
    """Keys in both tables with their variance; flagged if either threshold is
    met, severity high if the dollar one is."""
    keys = shared_keys(budget, actuals)
    zero = F.lit(0).cast(s.MONEY)
    b = account_lines(budget, keys).select(*keys, F.coalesce("amount", zero).alias("budget_amount"))
    a = account_lines(actuals, keys).select(*keys, F.coalesce("amount", zero).alias("actual_amount"))
    variance = F.col("actual_amount") - F.col("budget_amount")
    joined = b.join(a, keys).withColumn("dollar_variance", variance.cast(s.MONEY))
    joined = joined.withColumn("pct_variance", s.pct_of(F.col("dollar_variance"), F.col("budget_amount")))
    by_dollar = F.abs("dollar_variance") >= F.lit(dollar)
    by_pct = F.coalesce(F.abs(s.pct_of(F.col("dollar_variance"), F.col("budget_amount"))) >= pct, F.lit(False))
    return (joined.withColumn("flagged", by_dollar | by_pct)
            .withColumn("severity", F.when(by_dollar, "high").when(by_pct, "medium").otherwise("info")))


def one_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    keys = shared_keys(left, right)
    return account_lines(left, keys).join(account_lines(right, keys).select(*keys), keys, "left_anti").select(*keys, "amount")


def missing_accounts(chart: DataFrame, budget: DataFrame, actuals: DataFrame) -> DataFrame:
    """Chart lines whose key neither table holds, compared on the columns all
    three share."""
    keys = [k for k in shared_keys(budget, actuals) if k in chart.columns]
    out = chart.select(*[s.text_key(k).alias(k) for k in keys])
    for side in (budget, actuals):
        present = account_lines(side, shared_keys(budget, actuals)).select(*keys)
        out = out.join(present, keys, "left_anti")
    return out


def variance_by(budget: DataFrame, actuals: DataFrame, column: str) -> DataFrame:
    lines = budget_vs_actual(budget, actuals)
    return lines.groupBy(column).agg(*[F.sum(c).cast(SUM_TYPE).alias(c)
                                       for c in ("budget_amount", "actual_amount", "dollar_variance")])


def key_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many keys are shared, and how many only one side has."""
    keys = shared_keys(left, right)
    tagged = (account_lines(left, keys).select(*keys, F.lit(1).alias("in_left"), F.lit(0).alias("in_right"))
              .unionByName(account_lines(right, keys).select(*keys, F.lit(0).alias("in_left"), F.lit(1).alias("in_right"))))
    sides = tagged.groupBy(*keys).agg(F.max("in_left").alias("l"), F.max("in_right").alias("r"))
    return sides.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"),
                     F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"))


def budget_basis_mismatch(budget: DataFrame, actuals: DataFrame) -> DataFrame:
    """One row: are the two sides on different bases? Row counts at least three
    times apart, else totals at least eight times apart."""
    keys = shared_keys(budget, actuals)

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(~_is_total_row(df, keys) & F.col("amount").isNotNull())
        return rows.agg(F.count(F.lit(1)).alias(f"{name}_rows"),
                        F.coalesce(F.sum("amount"), F.lit(0)).cast(SUM_TYPE).alias(f"{name}_total")).withColumn("_one", F.lit(1))

    both = side(budget, "budget").join(side(actuals, "actual"), "_one")

    def apart(a: Column, b: Column) -> Column:
        return F.try_divide(F.greatest(a, b).cast("double"), F.least(a, b).cast("double"))

    rows = F.coalesce(apart(F.col("budget_rows"), F.col("actual_rows")) >= BASIS_ROWCOUNT_RATIO, F.lit(False))
    totals = F.coalesce(apart(F.abs("budget_total"), F.abs("actual_total")) >= BASIS_MAGNITUDE_RATIO, F.lit(False))
    reason = F.when(rows, "row_count").when(totals & (F.col("budget_rows") > 0) & (F.col("actual_rows") > 0), "magnitude")
    return both.select("budget_rows", "actual_rows", "budget_total", "actual_total", reason.alias("reason"))


def subtotal_rollup_signal(rows: DataFrame, group: list[str], order: str, chunk: Column, together: int = GROUP_ROWS) -> DataFrame:
    """Per group, how many rows look like a subtotal of other rows of it.

    A row qualifies when its amount is within half a percent of the running
    total of at least two rows before it, of the running total past it without
    itself, or of the total of all other rows. Zero amounts are ignored.

    Rows are dealt out by group once, and small groups are settled where they are. A group of more
    than ``together`` rows is spread over its chunks: running totals are folded to distinct values with
    their first and last position before they meet the amounts, on logarithmic buckets one
    slack wide, so it is never compared with itself row by row.
    """
    vals = rows.where("amount <> 0").select(*group, F.col(order).alias("_ord"), "amount", chunk.alias("_ck")).dropna(subset=group)
    large = cut_lineage(vals.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).select(*group))
    spread = not large.isEmpty()
    small = (vals.join(broadcast_if_small(large), group, "left_anti") if spread else vals).drop("_ck").repartition(*group)
    whole = W.partitionBy(*group)
    so_far = whole.orderBy("_ord").rowsBetween(W.unboundedPreceding, 0)
    run = (small.withColumns({"_p": F.sum("amount").over(so_far), "_k": F.count(F.lit(1)).over(so_far)})
           .withColumns({"_total": F.sum("amount").over(whole), "_n": F.count(F.lit(1)).over(whole)}).where(F.col("_n") >= ROLLUP_MIN_CHILDREN + 1))
    marks = run.select(*[F.col(c).alias(f"m{c}") for c in (*group, "_k", "_p")])
    same = reduce(Column.__and__, [F.col(c) == F.col(f"m{c}") for c in group])
    counted = (F.col("m_k") >= ROLLUP_MIN_CHILDREN) & (F.col("m_p") != 0)
    past = F.col("m_k") >= ROLLUP_MIN_CHILDREN + 1
    hits = run.join(marks, same & (_of_rest() | (counted & (_before("m_k", "m_p") | (past & _after("m_k", "m_p"))))), "left_semi").select(*group)
    if spread:
        hits = hits.unionByName(_spread_hits(vals.join(broadcast_if_small(large), group, "left_semi"), group))
    return hits.groupBy(*group).agg(F.count(F.lit(1)).alias("n_signals"))


def _slack() -> Column:
    return F.abs("amount") * F.lit(ROLLUP_REL_TOL)


def _of_rest() -> Column:
    """The amount is the total of all other rows."""
    others = F.col("_total") - F.col("amount")
    return (others != 0) & (F.abs(F.col("amount") - others) <= _slack())


def _before(position: str, total: str) -> Column:
    """The amount is a running total strictly before the row."""
    return (F.col(position) < F.col("_k")) & (F.abs(F.col("amount") - F.col(total)) <= _slack())


def _after(position: str, total: str) -> Column:
    """The amount is a running total past the row, without itself."""
    return (F.col(position) > F.col("_k")) & (F.abs(F.col(total) - F.col("amount") * 2) <= _slack())


def _spread_hits(vals: DataFrame, group: list[str]) -> DataFrame:
    """The group of each row that qualifies, in groups that no task takes whole."""
    totals = vals.groupBy(*group).agg(F.sum("amount").alias("_total"), F.count(F.lit(1)).alias("_n"))
    run = running(vals, group, ["_ord"], F.col("_ck"), {"_p": F.col("amount")}, rank="_k")
    run = run.join(totals, group).where(F.col("_n") >= ROLLUP_MIN_CHILDREN + 1)
    amt, total, past = F.col("amount"), F.col("_p"), F.col("_past")

    sign = lambda c: F.when(c < 0, -1).otherwise(1)
    bucket = lambda c: F.floor(F.log(F.abs(c).cast("double")) / F.lit(0.01)).cast("bigint")
    cand = run.where(~_of_rest()).select(*group, "amount", "_k").withColumns({"_s": sign(amt), "_b": bucket(amt)})
    # Totals past the row hold it as well, so half of them is its neighbour.
    marks = (run.where((F.col("_k") >= ROLLUP_MIN_CHILDREN) & (total != 0)).select(*group, "_k", "_p", F.explode(F.array(F.lit(False), F.lit(True))).alias("_past"))
             .where(~past | (F.col("_k") >= ROLLUP_MIN_CHILDREN + 1))
             .groupBy(*group, "_past", "_p").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
             .withColumns({"_s": sign(total), "_mb": F.when(past, bucket(total / F.lit(2))).otherwise(bucket(total))})
             .withColumn("_b", F.explode(F.sequence(F.col("_mb") - 1, F.col("_mb") + 1)))
             .select(*[F.col(c).alias(f"m{c}") for c in (*group, "_s", "_b", "_past", "_p", "_first", "_last")]))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"m{c}") for c in (*group, "_s", "_b")])
    near = F.when(F.col("m_past"), _after("m_last", "m_p")).otherwise(_before("m_first", "m_p"))
    return run.where(_of_rest()).select(*group).unionByName(cand.join(marks, same & near, "left_semi").select(*group))
