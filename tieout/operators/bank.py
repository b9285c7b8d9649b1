"""Bank reconciliation beyond matching: totals and what a file check looks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.operators.ordered import chunk_of, numbered

# Thresholds of the file checks.
SIGN_MIN_SHARED = 4
SIGN_MIN_FRACTION = 0.6
BATCH_MIN_COMPONENTS = 3
PRIOR_PERIOD_GAP_DAYS = 45
PRIOR_PERIOD_MIN_DATES = 4

SUM_TYPE = "decimal(28,2)"


def _total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast(SUM_TYPE).alias("total"))


def reconciliation_summary(bank: DataFrame, ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: row counts, matched, timing and unmatched counts, totals."""
    kinds = pairs.agg(F.count_if(F.col("match_kind") == "exact").alias("matched"),
                      F.count_if(F.col("match_kind") == "timing").alias("timing"))
    b = _total(bank).select(F.col("n").alias("bank_rows"), F.col("total").alias("bank_total"))
    g = _total(ledger).select(F.col("n").alias("ledger_rows"), F.col("total").alias("ledger_total"))
    one = F.lit(1).alias("_one")
    joined = (b.select("*", one).join(g.select("*", one), "_one").join(kinds.select("*", one), "_one"))
    used = F.col("matched") + F.col("timing")
    return joined.select("bank_rows", "ledger_rows", "matched", "timing",
                         (F.col("bank_rows") - used).alias("unmatched_bank"),
                         (F.col("ledger_rows") - used).alias("unmatched_ledger"),
                         "bank_total", "ledger_total",
                         (F.col("bank_total") - F.col("ledger_total")).cast(SUM_TYPE).alias("difference"))


def sign_convention_mismatch(bank: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: among magnitudes on both sides, how often the first occurrences
    have opposite signs, and whether that is systematic."""
    def first_sign(rows: DataFrame, name: str) -> DataFrame:
        return (rows.where("amount <> 0").groupBy(F.abs("amount").alias("mag"))
                .agg((F.min_by("amount", "row_index") < 0).alias(name)))

    shared = first_sign(bank, "b_neg").join(first_sign(ledger, "l_neg"), "mag")
    counts = shared.agg(F.count(F.lit(1)).alias("shared"),
                        F.count_if(F.col("b_neg") != F.col("l_neg")).alias("opposite"))
    enough = F.bround(F.col("shared") * F.lit(SIGN_MIN_FRACTION), 0)
    return counts.withColumn("mismatch", (F.col("shared") >= SIGN_MIN_SHARED) & (F.col("opposite") >= enough))


def prior_period_items(rows: DataFrame, gap_days: int = PRIOR_PERIOD_GAP_DAYS) -> DataFrame:
    """Rows dated far outside the middle half of all dates.

    The quartile positions (n//4 and 3n//4 of the sorted dates) come from the
    counts per date, so the ordered window runs over distinct dates only.
    """
    per_day = rows.where("txn_date is not null").groupBy("txn_date").agg(F.count(F.lit(1)).alias("n"))
    upto = W.orderBy("txn_date").rowsBetween(W.unboundedPreceding, 0)
    ranked = per_day.select("txn_date", F.sum("n").over(upto).alias("upto"), F.col("n"))
    total = per_day.agg(F.sum("n").alias("total"))
    spots = ranked.join(total, F.col("total") >= PRIOR_PERIOD_MIN_DATES)

    def holds(position):
        return (F.col("upto") > position) & (F.col("upto") - F.col("n") <= position)

    span = spots.agg(F.max(F.when(holds(F.floor(F.col("total") / 4)), F.col("txn_date"))).alias("lo"),
                     F.max(F.when(holds(F.floor(F.col("total") * 3 / 4)), F.col("txn_date"))).alias("hi"))
    far = ((F.datediff("lo", "txn_date") > gap_days) | (F.datediff("txn_date", "hi") > gap_days))
    return rows.join(span, far).select("row_index", "amount", "txn_date", F.col("lo").alias("span_start"),
                                       F.col("hi").alias("span_end"))


def _runs(many: DataFrame, k: int) -> DataFrame:
    """Sums of k consecutive rows of one date, as an aggregate: every row votes
    for the k runs it belongs to."""
    placed = numbered(many, ["txn_date"], ["row_index"], chunk_of("row_index"), "pos")
    votes = placed.withColumn("start", F.explode(F.sequence(F.col("pos") - (k - 1), F.col("pos"))))
    return (votes.groupBy("txn_date", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("batch_total"))
            .where(F.col("n") == k)
            .groupBy("batch_total").agg(F.count(F.lit(1)).alias("n_batches"))
            .select("batch_total", F.lit("run").alias("batch_kind"), F.lit(k).cast("bigint").alias("n_components"),
                    "n_batches"))


def _batches(many: DataFrame, run_lengths: tuple[int, ...]) -> DataFrame:
    many = many.where("amount <> 0 and txn_date is not null")
    by_day = (many.groupBy("txn_date").agg(F.count(F.lit(1)).alias("n_components"), F.sum("amount").alias("batch_total"))
              .where(F.col("n_components") >= BATCH_MIN_COMPONENTS)
              .groupBy("batch_total", "n_components").agg(F.count(F.lit(1)).alias("n_batches"))
              .select("batch_total", F.lit("date").alias("batch_kind"), "n_components", "n_batches"))
    for k in run_lengths:
        by_day = by_day.unionByName(_runs(many, k))
    return by_day


def batch_total_match(bank: DataFrame, ledger: DataFrame, run_lengths: tuple[int, ...] = (3,)) -> DataFrame:
    """Rows of one side equal to a batch total of the other (all rows of a date,
    or a run of consecutive rows of a date) that have no 1:1 partner there."""
    def side(one: DataFrame, many: DataFrame, name: str) -> DataFrame:
        singles = many.select("amount").distinct()
        lone = one.where("amount <> 0").join(singles, "amount", "left_anti")
        return (lone.join(_batches(many, run_lengths), F.col("amount") == F.col("batch_total"))
                .select(F.lit(name).alias("total_side"), "row_index", "amount", "batch_kind",
                        F.col("n_components").cast("bigint"), "n_batches"))

    return side(ledger, bank, "ledger").unionByName(side(bank, ledger, "bank"))
