"""Report review: does a long-layout report tie out?

``report`` and ``prior`` have row_id (file order), section, account_code,
account_name, line_type (line_item, subtotal, grand_total) and amount.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators.ordered import keep_last

# Recognised layout words, default thresholds.
LINE_TYPES = ("line_item", "subtotal", "grand_total", "section_header", "header", "total")
NESTED_MARKERS = ("sub_subtotal", "subsubtotal", "sub_total_2", "subtotal_2", "rollup", "group_subtotal")
DEPTH_COLUMNS = ("level", "indent", "depth", "tier")
PRIOR_CHANGE_PCT = 25.0
PRIOR_CHANGE_MIN = Decimal("10000")

SUM_TYPE = "decimal(28,2)"


def _is(kind: str) -> Column:
    return F.lower("line_type") == kind


def line_items(report: DataFrame) -> DataFrame:
    return report.where(_is("line_item"))


def _amount() -> Column:
    return F.coalesce(F.col("amount"), F.lit(0).cast(s.MONEY))


def subtotal_tie_out(report: DataFrame) -> DataFrame:
    """Stated subtotals that differ from the sum of their section's line items.
    A section without line items sums to 0."""
    sums = report.groupBy("section").agg(
        F.coalesce(F.sum(F.when(_is("line_item"), _amount())), F.lit(0)).cast(SUM_TYPE).alias("line_item_sum"))
    stated = report.where(_is("subtotal")).select("row_id", "section", _amount().cast(SUM_TYPE).alias("stated"))
    return (stated.join(sums, "section").where("stated <> line_item_sum")
            .select("row_id", "section", "stated", "line_item_sum",
                    (F.col("stated") - F.col("line_item_sum")).cast(SUM_TYPE).alias("difference")))


def grand_total_tie_out(report: DataFrame) -> DataFrame:
    """Grand totals that differ from the sum of all subtotals."""
    total = report.agg(F.coalesce(F.sum(F.when(_is("subtotal"), _amount())), F.lit(0)).cast(SUM_TYPE).alias("subtotal_sum"))
    stated = report.where(_is("grand_total")).select("row_id", _amount().cast(SUM_TYPE).alias("stated"))
    return (stated.join(total, F.col("stated") != F.col("subtotal_sum"))
            .select("row_id", "stated", "subtotal_sum", (F.col("stated") - F.col("subtotal_sum")).cast(SUM_TYPE).alias("difference")))


def missing_sections(report: DataFrame, required: DataFrame) -> DataFrame:
    """Required sections (a ``section`` column) the report does not have."""
    return required.select("section").distinct().join(report.select("section").distinct(), "section", "left_anti")


def report_duplicate_lines(report: DataFrame) -> DataFrame:
    """Line items equal in section, code, name and amount text to an earlier
    one, each with that first row."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}")
           for c in ("section", "account_code", "account_name", "amount")]
    rows = line_items(report).select("row_id", *key)
    names = [c for c in rows.columns if c != "row_id"]
    first = rows.groupBy(*names).agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (rows.join(first, names).where("row_id > first_row")
            .select("row_id", "first_row", F.col("k_section").alias("section"), F.col("k_account_code").alias("account_code")))


def negative_not_allowed(report: DataFrame, sections: list[str]) -> DataFrame:
    return (line_items(report).where(F.col("section").isin(*sections) & (F.col("amount") < 0))
            .select("row_id", "section", "account_code", "amount"))


def invalid_account_code(report: DataFrame, chart: DataFrame) -> DataFrame:
    """Line items whose (non-blank) code the chart does not list."""
    codes = chart.select(s.text_key("account_code").alias("account_code")).where("account_code <> ''").distinct()
    rows = line_items(report).select("row_id", s.text_key("account_code").alias("account_code"), "section")
    return rows.where("account_code <> ''").join(codes, "account_code", "left_anti")


def inconsistent_naming(report: DataFrame) -> DataFrame:
    """Codes labelled with more than one name."""
    pairs = (line_items(report).select(s.text_key("account_code").alias("account_code"),
                                       s.text_key("account_name").alias("account_name"))
             .where("account_code <> ''").distinct())
    return (pairs.groupBy("account_code")
            .agg(F.count(F.lit(1)).alias("n_names"), F.min("account_name").alias("first_name"),
                 F.max("account_name").alias("last_name")).where("n_names > 1"))


def prior_version_change(report: DataFrame, prior: DataFrame, pct: float = PRIOR_CHANGE_PCT,
                         minimum=PRIOR_CHANGE_MIN) -> DataFrame:
    """Line items that moved by at least ``minimum`` and ``pct`` percent since
    the prior version (last row per code; a prior value of 0 counts as 0 %)."""
    before = line_items(prior).select(s.text_key("account_code").alias("account_code"), "row_id",
                                      _amount().alias("prior_amount")).where("account_code <> ''")
    last = keep_last(before, ["account_code"], F.col("row_id"), ["prior_amount"])
    rows = line_items(report).select("row_id", "section", s.text_key("account_code").alias("account_code"),
                                     _amount().alias("amount"))
    change = F.col("amount") - F.col("prior_amount")
    moved = F.coalesce(F.abs(s.pct_of(change, F.col("prior_amount"))), F.lit(0.0))
    return (rows.join(last, "account_code").withColumn("change", change.cast(s.MONEY))
            .where((F.abs("change") >= F.lit(minimum)) & (moved >= pct))
            .select("row_id", "section", "account_code", "prior_amount", "amount", "change", moved.alias("change_pct")))


def report_structure(report: DataFrame, profile: DataFrame) -> DataFrame:
    """One row of layout signals: wide layout (no amount column, at least three
    columns at least 80 % numeric), no recognised line type, nested subtotals.

    ``profile`` is the column profile of the same report (see ``profiling``).
    """
    numeric = profile.agg(F.count_if(F.col("amount_confidence") >= 0.8).alias("n_numeric"))
    kind = F.lower(F.trim("line_type")) if "line_type" in report.columns else F.lit(None).cast("string")
    aggs = [F.count_if(kind != "").alias("n_typed"), F.count_if(kind.isin(*LINE_TYPES)).alias("n_known"),
            F.count_if(kind.isin(*NESTED_MARKERS)).alias("n_nested")]
    depth = [c for c in DEPTH_COLUMNS if c in report.columns]
    for c in depth:
        level = F.trim(F.col(c).cast("string"))
        aggs.append(F.count_distinct(F.when(level.rlike(r"^-*\d+$"), level)).alias(f"d_{c}"))
    found = report.agg(*aggs)
    deepest = F.greatest(*[F.col(f"d_{c}") for c in depth]) if len(depth) > 1 else (
        F.col(f"d_{depth[0]}") if depth else F.lit(0))
    no_amount = "amount" not in report.columns
    one = F.lit(1).alias("_one")
    return (found.select("*", one).join(numeric.select("*", one), "_one")
            .select((F.lit(no_amount) & (F.col("n_numeric") >= 3)).alias("wide_layout"),
                    ((F.col("n_typed") > 0) & (F.col("n_known") == 0)).alias("unknown_line_types"),
                    ((F.col("n_nested") > 0) | (deepest >= 3)).alias("nested_rollup")))
