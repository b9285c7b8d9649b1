"""Invoices against purchase orders.

``po`` has row_id (file order), po_number, vendor_number, line, status, qty,
unit_price, line_amount, received_qty, invoiced_qty, last_activity_date;
``invoices`` as in the payables review, with qty and unit_price.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.functions.similarity import ratio_ceiling, sequence_ratio
from tieout.operators.ap import _vendor_map, missing_po_over_threshold

SUM_TYPE = "decimal(28,2)"

# Default tolerances.
OVER_PCT = 0.0
PRICE_PCT = 1.0
QTY_TOL = 0
GRACE_DAYS = 0
NAME_RATIO = 0.82


def _keyed(df: DataFrame) -> DataFrame:
    out = df.withColumn("po_number", s.text_key("po_number"))
    if "vendor_number" in df.columns:
        out = out.withColumn("vendor_number", s.text_key("vendor_number"))
    return out


def _with_po(invoices: DataFrame) -> DataFrame:
    return _keyed(invoices).where("po_number <> ''")


def _po_numbers(po: DataFrame) -> DataFrame:
    return _keyed(po).where("po_number <> ''").select("po_number").distinct()


def invoice_exceeds_po(invoices: DataFrame, po: DataFrame, over_pct: float = OVER_PCT) -> DataFrame:
    """Orders invoiced beyond the total of their lines plus tolerance."""
    ordered = (_keyed(po).where("po_number <> ''").groupBy("po_number")
               .agg(F.coalesce(F.sum("line_amount"), F.lit(0)).cast(SUM_TYPE).alias("po_total")))
    billed = (_with_po(invoices).groupBy("po_number")
              .agg(F.coalesce(F.sum("invoice_amount"), F.lit(0)).cast(SUM_TYPE).alias("total_invoiced"),
                   F.count(F.lit(1)).alias("n_invoices")))
    allowed = F.col("po_total") * F.lit(1 + over_pct / 100).cast("decimal(10,4)")
    return (billed.join(ordered, "po_number").where(F.col("total_invoiced") > allowed)
            .select("po_number", "po_total", "total_invoiced", "n_invoices",
                    (F.col("total_invoiced") - F.col("po_total")).cast(SUM_TYPE).alias("overage")))


def po_wrong_vendor(invoices: DataFrame, po: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """Invoices by a vendor the order was not issued to. ``po_vendor`` is the
    smallest vendor of the order; with a vendor list the row also says whether
    the two names are similar (a possible mis-keyed vendor)."""
    lines = _keyed(po).where("po_number <> ''")
    issued = lines.select("po_number", "vendor_number").distinct()
    to = lines.groupBy("po_number").agg(F.min("vendor_number").alias("po_vendor"))
    wrong = (_with_po(invoices).where("vendor_number <> ''").join(issued, ["po_number", "vendor_number"], "left_anti")
             .join(to, "po_number").select("row_id", "po_number", "vendor_number", "invoice_number", "po_vendor"))
    if vendors is None:
        return wrong
    names = _vendor_map(vendors).select("vendor_number", s.strip_trailing_suffix("list_name").alias("nm"))
    pairs = (wrong.select("vendor_number", "po_vendor").distinct()
             .join(names.withColumnRenamed("nm", "name_a"), "vendor_number")
             .join(names.select(F.col("vendor_number").alias("po_vendor"), F.col("nm").alias("name_b")), "po_vendor")
             .where(ratio_ceiling(F.col("name_a"), F.col("name_b")) >= NAME_RATIO)
             .withColumn("name_ratio", F.round(sequence_ratio("name_a", "name_b"), 4)).where(F.col("name_ratio") >= NAME_RATIO)
             .select("vendor_number", "po_vendor", "name_ratio"))
    return wrong.join(pairs, ["vendor_number", "po_vendor"], "left").select(*wrong.columns, "name_ratio")


def po_missing(invoices: DataFrame, po: DataFrame) -> DataFrame:
    return (_with_po(invoices).join(_po_numbers(po), "po_number", "left_anti")
            .select("row_id", "po_number", "vendor_number", "invoice_number", "invoice_amount"))


def po_closed_usage(invoices: DataFrame, po: DataFrame, grace_days: int = GRACE_DAYS) -> DataFrame:
    """Invoices dated after the last activity (plus grace) of an order whose
    first line is closed."""
    first = (_keyed(po).where("po_number <> ''").groupBy("po_number")
             .agg(F.min_by(F.struct(F.col("status"), F.col("last_activity_date")), "row_id").alias("f"))
             .where("lower(trim(f.status)) = 'closed'")
             .select("po_number", F.col("f.last_activity_date").alias("last_activity_date")))
    return (_with_po(invoices).join(first, "po_number")
            .where(F.col("invoice_date") > F.date_add("last_activity_date", grace_days))
            .select("row_id", "po_number", "invoice_number", "invoice_date", "last_activity_date"))


def best_po_line(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Invoice rows with quantity and price, each with the order line it is
    compared to: the first line of equal quantity, else the first line.

    Lines are reduced to one per (order, quantity) and one per order before the
    join, so an order with many lines and invoices does not multiply.
    """
    lines = _keyed(po).where("po_number <> ''")
    # ordered by its first field, so the row id travels once
    first = F.min(F.when(F.col("row_id").isNotNull(), F.struct("row_id", "line", "qty", "unit_price")))
    by_qty = (lines.where("qty is not null").groupBy(F.col("po_number").alias("_po"), F.col("qty").alias("_q"))
              .agg(first.alias("best")))
    by_po = lines.groupBy("po_number").agg(first.alias("best"))
    rows = (_with_po(invoices).where("qty is not null and unit_price is not null")
            .select("row_id", "po_number", "invoice_number", "qty", "unit_price"))
    met = rows.join(by_qty, (F.col("po_number") == F.col("_po")) & (F.col("qty") == F.col("_q")), "left").select(*rows.columns, "best")
    # Only rows without a line of their quantity go on to the first line of the order.
    rest = met.where("best is null").drop("best").join(by_po, "po_number")
    return (met.where("best is not null").unionByName(rest)
            .select(*rows.columns, F.col("best.row_id").alias("po_row"), F.col("best.line").alias("po_line"),
                    F.col("best.qty").alias("po_qty"), F.col("best.unit_price").alias("po_unit_price")))


def po_unit_price_mismatch(invoices: DataFrame, po: DataFrame, pct: float = PRICE_PCT) -> DataFrame:
    dev = s.deviation_pct(F.col("unit_price"), F.col("po_unit_price"))
    return (best_po_line(invoices, po).withColumn("deviation_pct", dev).where(F.col("deviation_pct") > pct)
            .select("row_id", "po_number", "invoice_number", "po_row", "po_line", "unit_price", "po_unit_price", "deviation_pct"))


def po_quantity_mismatch(invoices: DataFrame, po: DataFrame, tol=QTY_TOL) -> DataFrame:
    return (best_po_line(invoices, po).withColumn("overage", F.col("qty") - F.col("po_qty"))
            .where(F.col("overage") > F.lit(tol))
            .select("row_id", "po_number", "invoice_number", "po_row", "po_line", "qty", "po_qty",
                    F.col("overage").cast(s.MONEY).alias("overage")))


def received_not_invoiced(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Received lines not invoiced, with no invoice by that vendor on the order."""
    open_lines = _keyed(po).where("received_qty > 0 and coalesce(invoiced_qty, 0) <= 0")
    billed = _keyed(invoices).select("po_number", "vendor_number").distinct()
    return (open_lines.join(billed, ["po_number", "vendor_number"], "left_anti")
            .select("row_id", "po_number", "vendor_number", "line", "received_qty"))


def invoiced_not_received(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Lines invoiced beyond what was received, with the number of invoice rows
    on the order and the first of them (all of them join on the order number)."""
    over = _keyed(po).where("invoiced_qty > received_qty")
    billed = _keyed(invoices).groupBy("po_number").agg(F.count(F.lit(1)).alias("n_invoices"), F.min("row_id").alias("first_invoice"))
    return (over.join(billed, "po_number", "left")
            .select("row_id", "po_number", "vendor_number", "line", "received_qty", "invoiced_qty",
                    F.coalesce("n_invoices", F.lit(0)).cast("bigint").alias("n_invoices"), "first_invoice"))


def _judged(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Invoice rows on an order, each with ``known`` (the order exists) and ``flagged`` (any rule
    of this module). Invoices and order lines are dealt out by order once, together; every rule
    is a column of that one frame."""
    number, vendor = s.text_key("po_number").alias("po_number"), s.text_key("vendor_number").alias("vendor_number")
    billed = invoices.select(number, vendor, "qty", F.lit(False).alias("_line"), F.struct(
        "row_id", "invoice_number", "invoice_date", "invoice_amount", "unit_price").alias("_i"))
    lines = po.select(number, vendor, "qty", F.lit(True).alias("_line"), F.struct(
        "row_id", "line", "unit_price", "line_amount", "status", "last_activity_date",
        F.coalesce(F.col("invoiced_qty") > F.col("received_qty"), F.lit(False)).alias("over")).alias("_p"))
    both = billed.unionByName(lines, allowMissingColumns=True).where("po_number <> ''").repartition("po_number")

    order, by_vendor, by_qty = (W.partitionBy("po_number", *c) for c in ([], ["vendor_number"], ["qty"]))
    line = F.struct("_p.row_id", "_p.line", "qty", F.col("_p.unit_price").alias("po_price"))
    first = F.when(F.col("_p.row_id").isNotNull(), line)
    both = (both.withColumn("_issued", F.max("_line").over(by_vendor))
            .withColumn("_same", F.min(F.when(F.col("qty").isNotNull(), first)).over(by_qty))
            .withColumns({"_first": F.min(first).over(order), "known": F.max("_line").over(order), "_over": F.max("_p.over").over(order),
                          "_state": F.min_by(F.struct("_p.status", "_p.last_activity_date"), "_p.row_id").over(order),
                          "_ordered": F.coalesce(F.sum("_p.line_amount").over(order), F.lit(0)).cast(SUM_TYPE),
                          "_billed": F.coalesce(F.sum("_i.invoice_amount").over(order), F.lit(0)).cast(SUM_TYPE)}))
    both = both.where("not _line").withColumn("_best", F.coalesce("_same", "_first"))
    dev = s.deviation_pct(F.col("_i.unit_price"), F.col("_best.po_price"))
    exceeds = F.col("_billed") > F.col("_ordered") * F.lit(1 + OVER_PCT / 100).cast("decimal(10,4)")
    off_line = F.col("qty").isNotNull() & F.col("_i.unit_price").isNotNull() & ((dev > PRICE_PCT) | (F.col("qty") - F.col("_best.qty") > QTY_TOL))
    wrong_vendor = (F.col("vendor_number") != "") & ~F.col("_issued")
    closed = (F.lower(F.trim("_state.status")) == "closed") & (F.col("_i.invoice_date") > F.date_add("_state.last_activity_date", GRACE_DAYS))
    rules = [F.coalesce(r, F.lit(False)) for r in (exceeds, F.col("_over"), off_line, wrong_vendor, closed)]
    return both.select("_i.row_id", "po_number", "_i.invoice_number", "vendor_number", "_i.invoice_amount", "known",
                       (~F.col("known") | reduce(Column.__or__, rules)).alias("flagged"))


def flagged_invoices(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Row ids of invoices in any exception."""
    on_order = _judged(invoices, po).where("flagged").select("row_id")
    return on_order.unionByName(missing_po_over_threshold(invoices).select("row_id")).distinct()


def po_clean_matches(invoices: DataFrame, po: DataFrame) -> DataFrame:
    """Invoices on a known order that are in no exception: no row of their id is (a row without
    an id is told apart from none and stays). A flagged row travels as its id alone."""
    judged = _judged(invoices, po)
    out = ["row_id", "po_number", "invoice_number", "vendor_number", "invoice_amount"]
    clean = F.when(F.col("known") & (~F.col("flagged") | F.col("row_id").isNull()), F.struct(*out))
    missing = missing_po_over_threshold(invoices).where("row_id is not null").select("row_id", F.lit(None).cast(judged.select(clean.alias("c")).schema["c"].dataType).alias("_c"))
    rows = judged.select("row_id", clean.alias("_c")).where("row_id is not null or _c is not null").unionByName(missing)
    spotless = F.col("row_id").isNull() | (F.count_if(F.col("_c").isNull()).over(W.partitionBy("row_id")) == 0)
    return rows.withColumn("_ok", spotless).where("_ok").select(*[f"_c.{c}" for c in out])
