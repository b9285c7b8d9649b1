"""Payables review: duplicate, split and suspicious payments.

Inputs (columns used): ``invoices`` row_id, vendor_number, vendor_name,
invoice_number, invoice_date, invoice_amount, po_number, check_number;
``vendors`` vendor_number, vendor_name, status; ``checks`` row_id,
check_number, check_date, vendor_number, status, invoice_numbers.
Group results carry counts, totals and the first row; the member rows are a
join on the group key away, so no group is ever gathered in one place.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.functions.similarity import can_reach, few_edits, letter_order, prefix_lists, ratio_ceiling, with_ratio
from tieout.operators.bands import Band, band_join, shared_buckets
from tieout.session import broadcast_if_small, cut_lineage

SUM_TYPE = "decimal(28,2)"

# Default thresholds of the payables checks.
NEAR_DAYS = 7
AMOUNT_TOL = Decimal("0.01")
NAME_RATIO = 0.88
SPLIT_LIMIT = Decimal("5000")
SPLIT_DAYS = 3
PO_REQUIRED_FROM = Decimal("5000")

#: Check lines that one task looks at.
CHECKS_PER_TASK = 500_000


def _keyed(invoices: DataFrame) -> DataFrame:
    return (invoices.withColumn("vendor_number", s.text_key("vendor_number"))
            .withColumn("invoice_number", s.text_key("invoice_number")))


def _vendor_map(vendors: DataFrame) -> DataFrame:
    """One row per vendor number, the last one listed."""
    named = vendors.select(s.text_key("vendor_number").alias("vendor_number"),
                           s.text_key("vendor_name").alias("list_name"), s.text_key("status").alias("vendor_status"),
                           F.col("row_id").alias("_o")).where("vendor_number <> ''")
    return named.groupBy("vendor_number").agg(F.max_by("list_name", "_o").alias("list_name"),
                                              F.max_by("vendor_status", "_o").alias("vendor_status"))


def fill_vendor_names(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Blank vendor names taken from the vendor list ('' when unknown)."""
    names = _vendor_map(vendors).select(F.col("vendor_number").alias("_vn"), "list_name")
    name = F.when(s.is_blank("vendor_name"), F.coalesce("list_name", F.lit(""))).otherwise(F.col("vendor_name"))
    return (invoices.join(names, s.text_key("vendor_number") == F.col("_vn"), "left")
            .withColumn("vendor_name", name).select(*invoices.columns))


# ------------------------------------------------------------ duplicates

def duplicate_invoice(invoices: DataFrame) -> DataFrame:
    """Vendor and invoice number on more than one row."""
    rows = _keyed(invoices).where("vendor_number <> '' and invoice_number <> ''")
    return (rows.groupBy("vendor_number", "invoice_number")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"),
                 F.min("invoice_amount").alias("min_amount"), F.max("invoice_amount").alias("max_amount"),
                 F.sum("invoice_amount").cast(SUM_TYPE).alias("total_amount"))
            .where("n_rows > 1")
            .withColumn("group_id", s.group_id("D1", F.concat_ws("|", "vendor_number", "invoice_number"))))


def duplicate_invoice_rows(invoices: DataFrame) -> DataFrame:
    """The rows behind ``duplicate_invoice``, each with its group and the first row."""
    groups = duplicate_invoice(invoices).select("vendor_number", "invoice_number", "group_id", "first_row")
    return (_keyed(invoices).join(groups, ["vendor_number", "invoice_number"])
            .select("group_id", "row_id", "first_row", "vendor_number", "invoice_number", "invoice_amount"))


def _void_checks(checks: DataFrame) -> DataFrame:
    """Check numbers with a void line: a check void on any line is void everywhere."""
    return (checks.where(F.lower(s.text_key("status")) == "void")
            .select(s.text_key("check_number").alias("check_number")).distinct())


def _each_invoice(lines: DataFrame, *keep: str) -> DataFrame:
    """A row per invoice named in ``invoice_numbers``."""
    return (lines.select(*keep, F.explode(F.split(F.coalesce("invoice_numbers", F.lit("")), ";")).alias("_inv"))
            .select(*keep, F.trim("_inv").alias("invoice_number")).where("invoice_number <> ''"))


def multi_check_invoice(checks: DataFrame) -> DataFrame:
    """Invoice numbers paid by more than one distinct check that is not void.

    Tasks grow with the check lines: of a large register each holds about ``CHECKS_PER_TASK``.
    """
    spark = checks.sparkSession
    lines = checks.select(s.text_key("check_number").alias("check_number"), "invoice_numbers")
    void = _void_checks(checks)
    tasks = -(-checks.count() // CHECKS_PER_TASK)
    if tasks > spark.sparkContext.defaultParallelism:
        # up to the width of the session's shuffles the join would deal both sides again
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")) + 1)
        lines, void = (df.repartition(tasks, "check_number") for df in (lines, void))
        void = void.hint("merge")  # a broadcast would go back to the tasks of the scan
    live = _each_invoice(lines.join(void, "check_number", "left_anti"), "check_number")
    return (live.select("invoice_number", "check_number").distinct()
            .groupBy("invoice_number")
            .agg(F.count(F.lit(1)).alias("n_checks"), F.min("check_number").alias("first_check"),
                 F.max("check_number").alias("last_check"))
            .where("n_checks > 1")
            .withColumn("group_id", s.group_id("D1b", F.col("invoice_number"))))


def same_vendor_near_duplicate(invoices: DataFrame, amount_tol=AMOUNT_TOL, days: int = NEAR_DAYS) -> DataFrame:
    """Same vendor, amount within tolerance, dates within ``days``, another
    invoice number: one line per row with the number of such partners and one of
    them (smallest other invoice number, else the largest).

    Rows are first folded to cells (vendor, amount, date), which keep how many
    rows and which invoice numbers at either end they hold; cells then meet
    their neighbours. Rows of the same invoice are subtracted the same way.
    """
    rows = (_keyed(invoices).where("vendor_number <> '' and invoice_amount is not null and invoice_date is not null")
            .select("row_id", "vendor_number", "invoice_number", "invoice_amount", "invoice_date"))
    bands = [Band("amt", "o_amt", Decimal(str(amount_tol))), Band("day", "o_day", days)]

    def neighbourhood(source: DataFrame, keys: list[str], *aggs, out: list) -> DataFrame:
        cells = source.groupBy(*keys, F.col("invoice_amount").alias("amt"), F.col("invoice_date").alias("day")).agg(*aggs)
        other = cells.select(*[F.col(c).alias(f"o_{c}") for c in cells.columns])
        return (band_join(cells.select(*keys, "amt", "day"), other, [(k, f"o_{k}") for k in keys], bands)
                .groupBy(*keys, "amt", "day").agg(*out))

    n = F.count(F.lit(1)).alias("n")
    all_near = neighbourhood(
        rows, ["vendor_number"], n, F.min("invoice_number").alias("lo"), F.max("invoice_number").alias("hi"),
        out=[F.sum("o_n").alias("n_all"), F.min("o_lo").alias("lo"), F.max("o_hi").alias("hi")])
    # Materialised: both uses below read it, and few cells leave the rows where they are.
    all_near = broadcast_if_small(cut_lineage(all_near.where("lo <> hi")))
    # The own-invoice count is needed only for invoices with such a row.
    hits = rows.join(all_near.select("vendor_number", F.col("amt").alias("invoice_amount"), F.col("day").alias("invoice_date"), "n_all", "lo", "hi"),
                     ["vendor_number", "invoice_amount", "invoice_date"])
    hits = cut_lineage(hits)
    invoices_hit = broadcast_if_small(cut_lineage(hits.select("vendor_number", "invoice_number").distinct()))
    same = neighbourhood(rows.join(invoices_hit, ["vendor_number", "invoice_number"], "left_semi"),
                         ["vendor_number", "invoice_number"], n, out=[F.sum("o_n").alias("n_same")])
    return (hits.withColumnsRenamed({"invoice_amount": "amt", "invoice_date": "day"})
            .join(same, ["vendor_number", "invoice_number", "amt", "day"])
            .select("row_id", "vendor_number", "invoice_number", F.col("amt").alias("invoice_amount"),
                    F.col("day").alias("invoice_date"), (F.col("n_all") - F.col("n_same")).alias("n_partners"),
                    F.when(F.col("lo") != F.col("invoice_number"), F.col("lo")).otherwise(F.col("hi"))
                    .alias("partner_invoice")))


def similar_vendor_same_amount(invoices: DataFrame, min_ratio: float = NAME_RATIO, amount_tol=AMOUNT_TOL,
                               days: int = NEAR_DAYS, crowded: int = 512) -> DataFrame:
    """Invoices of two vendors with similar names, equal amounts and near dates.

    One line per pair of cells (vendor, amount, date) with how many rows each
    holds. Amount and date are compared first and names last, where the pair is met:
    pairs are many more than rows, so rows are dealt out once for both sides and
    pairs never. Where more than ``crowded`` rows share a bucket of amounts and dates,
    names must also share a piece of text before they meet, so a popular amount does
    not compare all vendors. Every pair above the ratio shares one, whatever the
    ratio, so this changes the plan and never the answer.
    """
    rows = _keyed(invoices).where("vendor_number <> ''")
    first_name = rows.groupBy("vendor_number").agg(F.min_by(s.text_key("vendor_name"), "row_id").alias("vendor_name"))
    names = cut_lineage(first_name.withColumn("bare", s.strip_legal_suffix("vendor_name")).where("bare <> ''"))
    dated = (rows.where("invoice_amount is not null and invoice_date is not null")
             .select("vendor_number", F.col("invoice_amount").alias("amt"), F.col("invoice_date").alias("day"), "row_id"))
    tol = Decimal(str(amount_tol))
    dealt, keys = shared_buckets(dated.join(broadcast_if_small(names, 200_000), "vendor_number"), {"amt": tol, "day": days})
    busy = cut_lineage(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded).select(*keys))

    def cells(source: DataFrame) -> DataFrame:
        return (source.groupBy(*keys, "vendor_number", "amt", "day", "vendor_name", "bare", "_own")
                .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")))

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for side in "ab")

    # The bucket of the left cell decides, so every pair is found once. Both sides stand in
    # the test, or the sides would be filtered apart and dealt out apart.
    once = (F.col("vendor_number_a") < F.col("vendor_number_b")) & (F.col("_own_a") * 2 + F.col("_own_b") >= 2)
    near = s.amounts_match(F.col("amt_a"), F.col("amt_b"), tol) & s.dates_within(F.col("day_a"), F.col("day_b"), days)
    same = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys]
    crowds = not busy.isEmpty()
    a, b = sides(cells((dealt.join(broadcast_if_small(busy), keys, "left_anti") if crowds else dealt).repartition(*keys)))
    met = a.join(b, reduce(Column.__and__, same) & near & once)
    if crowds:
        bare = names.select(F.col("bare").alias("name")).distinct()
        first = prefix_lists(bare, letter_order(bare), min_ratio).select(F.col("name").alias("bare"), "letters", F.col("n").alias("size"))
        lettered = cells(dealt.join(broadcast_if_small(busy), keys, "left_semi")).join(first, "bare").select("*", F.posexplode("letters").alias("place", "letter"))
        a, b = sides(lettered)
        far = [F.col(c) for c in ("size_a", "size_b", "place_a", "place_b")]
        # at the first letter that both have
        crowd = (band_join(a.where("_own_a = 1"), b, [(f"{c}_a", f"{c}_b") for c in (*keys, "letter")], [Band("amt_a", "amt_b", tol), Band("day_a", "day_b", days)])
                 .where(once & (F.array_intersect("letters_a", "letters_b")[0] == F.col("letter_a")) & can_reach(*far, min_ratio)))
        met = met.unionByName(crowd.select(met.columns))
    one, two = F.col("bare_a"), F.col("bare_b")
    # Equal names need no score; written as an equation they would be a join key, by which both sides are dealt out again.
    equal = met.where((one <= two) & (one >= two) & F.lit(min_ratio <= 1)).withColumn("ratio", F.lit(1.0))
    other = met.where((one != two) & (ratio_ceiling(one, two) >= min_ratio) & few_edits(one, two, min_ratio))
    return (equal.unionByName(with_ratio(other, "bare_a", "bare_b", min_ratio))
            .select(F.col("vendor_number_a").alias("vendor_a"), F.col("vendor_name_a").alias("vendor_name_a"),
                    F.col("vendor_number_b").alias("vendor_b"), F.col("vendor_name_b").alias("vendor_name_b"),
                    F.col("amt_a").alias("amount_a"), F.col("amt_b").alias("amount_b"),
                    F.col("day_a").alias("date_a"), F.col("day_b").alias("date_b"),
                    F.col("n_a").alias("rows_a"), F.col("n_b").alias("rows_b"),
                    F.col("first_row_a"), F.col("first_row_b"), F.round("ratio", 4).alias("similarity")))


# ------------------------------------------------------------ references and vendors

def missing_po_over_threshold(invoices: DataFrame, minimum=PO_REQUIRED_FROM) -> DataFrame:
    return (invoices.where(s.is_blank("po_number") & (F.col("invoice_amount") >= F.lit(minimum)))
            .select("row_id", "vendor_number", "invoice_number", "invoice_amount"))


def _check_dates(checks: DataFrame) -> DataFrame:
    """Check number to its first known date, in file order."""
    dated = checks.where("check_date is not null").select(s.text_key("check_number").alias("check_number"),
                                                          F.col("check_date").alias("paid_on"), "row_id")
    return dated.groupBy("check_number").agg(F.min_by("paid_on", "row_id").alias("paid_on"))


def _linked_checks(checks: DataFrame) -> DataFrame:
    """Invoices named on checks that are not void, with the first known date of the check.

    What is known of a check is one aggregate, and its lines are taken apart after
    they met it, so a line travels once by check and its invoices once by invoice.
    """
    number = s.text_key("check_number").alias("check_number")
    known = F.when(F.col("check_date").isNotNull(), F.col("row_id"))
    void = F.coalesce(F.max(F.lower(s.text_key("status")) == "void"), F.lit(False))
    facts = checks.groupBy(number).agg(F.min_by("check_date", known).alias("paid_on"), void.alias("void")).where("paid_on is not null and not void")
    lines = checks.select(number, s.text_key("vendor_number").alias("vendor_number"), "invoice_numbers").join(facts.drop("void"), "check_number")
    return _each_invoice(lines, "check_number", "vendor_number", "paid_on")


def payment_before_invoice(invoices: DataFrame, checks: DataFrame) -> DataFrame:
    """Invoices paid before they were dated. The check is the one named on the
    invoice row; an invoice table without a check column uses the register's
    vendor and invoice link instead."""
    rows = _keyed(invoices).where("invoice_date is not null")
    if "check_number" in invoices.columns:
        named = rows.withColumn("check_number", s.text_key("check_number")).where("check_number <> ''")
        paid = named.join(_check_dates(checks), "check_number")
    else:
        paid = rows.join(_linked_checks(checks), ["vendor_number", "invoice_number"])
    return (paid.where("paid_on < invoice_date")
            .select("row_id", "vendor_number", "invoice_number", "invoice_date", "check_number",
                    F.col("paid_on").alias("check_date"),
                    F.datediff("invoice_date", "paid_on").cast("bigint").alias("days_early")))


def inactive_vendor(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    listed = _vendor_map(vendors).where("lower(vendor_status) = 'inactive'")
    return (_keyed(invoices).join(listed, "vendor_number")
            .select("row_id", "vendor_number", F.col("list_name").alias("vendor_name"), "vendor_status",
                    "invoice_number", "invoice_amount"))


def unknown_vendor(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    listed = _vendor_map(vendors).select("vendor_number")
    return (_keyed(invoices).where("vendor_number <> ''").join(listed, "vendor_number", "left_anti")
            .select("row_id", "vendor_number", "vendor_name", "invoice_number", "invoice_amount"))


# ------------------------------------------------------------ split payments

def _split_days(invoices: DataFrame, limit, days: int) -> DataFrame:
    """Per vendor and day of small positive invoices: which cluster it is in.

    Works on daily sums, so a vendor contributes at most one row per calendar
    day to the windows, however many invoices it has.
    """
    daily = (_keyed(invoices).where("vendor_number <> '' and invoice_date is not null")
             .where((F.col("invoice_amount") > 0) & (F.col("invoice_amount") < F.lit(limit)))
             .groupBy("vendor_number", "invoice_date")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("invoice_amount").alias("day_total"))
             .withColumn("day", F.unix_date("invoice_date")))
    span = W.partitionBy("vendor_number").orderBy("day").rangeBetween(-days, 0)
    ends = (daily.select("*", F.sum("n").over(span).alias("win_n"), F.sum("day_total").over(span).alias("win_total"),
                         F.min("day").over(span).alias("win_start"))
            .withColumn("hit", (F.col("win_n") >= 2) & (F.col("win_total") >= F.lit(limit))))
    # A qualifying window starts a new cluster unless it overlaps an earlier one.
    prior = W.partitionBy("vendor_number").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    hits = ends.where("hit").select("vendor_number", "day", "win_start")
    marked = hits.withColumn("last_end", F.max("day").over(prior)).withColumn(
        "opens", F.when(F.col("last_end").isNull() | (F.col("win_start") > F.col("last_end")), 1).otherwise(0))
    upto = W.partitionBy("vendor_number").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    clusters = (marked.withColumn("cluster", F.sum("opens").over(upto))
                .groupBy("vendor_number", "cluster").agg(F.min("win_start").alias("start_day"), F.max("day").alias("end_day")))
    return (daily.join(clusters, "vendor_number").where("day between start_day and end_day")
            .select("vendor_number", "invoice_date", "cluster", "n", "day_total"))


def split_payments(invoices: DataFrame, limit=SPLIT_LIMIT, days: int = SPLIT_DAYS) -> DataFrame:
    """Clusters of invoices, each below the limit, that reach it together within
    ``days``; overlapping windows are one cluster."""
    return (_split_days(invoices, limit, days).groupBy("vendor_number", "cluster")
            .agg(F.sum("n").alias("n_invoices"), F.sum("day_total").cast(SUM_TYPE).alias("total"),
                 F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"))
            .withColumn("group_id", s.group_id("D8", F.concat_ws("|", "vendor_number", F.col("first_date").cast("string"))))
            .drop("cluster"))


def split_payment_rows(invoices: DataFrame, limit=SPLIT_LIMIT, days: int = SPLIT_DAYS) -> DataFrame:
    """The invoices behind ``split_payments``."""
    days_in = _split_days(invoices, limit, days)
    start = days_in.groupBy("vendor_number", "cluster").agg(F.min("invoice_date").alias("first_date"))
    tagged = days_in.join(start, ["vendor_number", "cluster"]).select("vendor_number", "invoice_date", "first_date")
    return (_keyed(invoices).where((F.col("invoice_amount") > 0) & (F.col("invoice_amount") < F.lit(limit)))
            .join(tagged, ["vendor_number", "invoice_date"])
            .select("row_id", "vendor_number", "invoice_number", "invoice_date", "invoice_amount", "first_date"))
