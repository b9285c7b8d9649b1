"""Finance tables derived from the star-schema tables the queries run on.

Views cover their whole base tables, but for drafts (the view events are the
drafts) and written searches (one per supplier of a range of balances). ``SQL`` holds the same views as plain
SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.scalars import MONEY
from tieout.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def _line_id() -> Column:
    """Unique and sortable key of a line item (order and line number alone repeat)."""
    return F.concat_ws("-", F.lpad(_text("l_orderkey"), 12, "0"), _text("l_linenumber"), F.lpad(_text("l_partkey"), 10, "0"),
                       F.lpad(_text("l_suppkey"), 10, "0"), _money("l_extendedprice").cast("string"))


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("row_id", _line_id())


#: Drafts and their material that one task reads claims from.
_DRAFTS_PER_TASK = 50_000


def wide_table(spark: SparkSession, sf: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    """A table for per-row parsing and text work, on all cores."""
    return spread(table(spark, sf, name), rows_per_task)


# ------------------------------------------------------------ payables and orders


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    po = F.when(F.col("l_linenumber") == 7, "").otherwise(_text("l_orderkey"))
    return line_items(spark, sf).select(
        "row_id", _text("l_suppkey").alias("vendor_number"), F.lit("").alias("vendor_name"), _text("l_orderkey").alias("invoice_number"),
        _day("l_shipdate").alias("invoice_date"), _money("l_extendedprice").alias("invoice_amount"), po.alias("po_number"),
        _money("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


def dated_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices dated by their order, with the check that paid them at shipping."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _day("o_orderdate").alias("invoice_date"))
    # the row id is put together behind the join, so its parts travel as numbers
    return table(spark, sf, "lineitem").join(orders, "l_orderkey").withColumn("row_id", _line_id()).select(
        "row_id", _text("l_suppkey").alias("vendor_number"), _text("l_orderkey").alias("invoice_number"), "invoice_date",
        _money("l_extendedprice").alias("invoice_amount"), _check_number().alias("check_number"))


def event_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Events as small invoices of the user."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), _text("user_id").alias("vendor_number"), _text("event_id").alias("invoice_number"),
        _day("ts").alias("invoice_date"), _money("value").alias("invoice_amount"))


def _renamed(key: str, flaw: Column) -> Column:
    """A key as text; rows with the flaw carry a key that nothing refers to."""
    return F.when(flaw, F.concat(F.lit("X"), _text(key))).otherwise(_text(key))


def _vendor_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("s_suppkey").alias("row_id"), "vendor_number", F.col("s_name").alias("vendor_name"),
                       F.when(F.col("s_acctbal") < 0, "Inactive").otherwise("Active").alias("status"))


def vendors(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers; those with a balance over 9 000 are listed under another number."""
    return _vendor_rows(table(spark, sf, "supplier").withColumn("vendor_number", _renamed("s_suppkey", F.col("s_acctbal") > 9000)))


def all_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return _vendor_rows(table(spark, sf, "supplier").withColumn("vendor_number", _text("s_suppkey")))


def _check_number() -> Column:
    return F.concat_ws("-", _text("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd"))


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """One line per line item: a supplier is paid by one check per shipping day."""
    void = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.08)
    return line_items(spark, sf).select(
        "row_id", _check_number().alias("check_number"), _day("l_shipdate").alias("check_date"),
        _text("l_suppkey").alias("vendor_number"), F.when(void, "Void").otherwise("Cleared").alias("status"),
        _money("l_extendedprice").alias("check_amount"),
        F.concat(_text("l_orderkey"), F.lit("; P"), _text("l_partkey")).alias("invoice_numbers"))


def po_headers(spark: SparkSession, sf: str) -> DataFrame:
    """One purchase order per order; those under 5 000 are filed under another number."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), _renamed("o_orderkey", F.col("o_totalprice") < 5000).alias("po_number"), _money("o_totalprice").alias("line_amount"),
        F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open").alias("status"),
        _day("o_orderdate").alias("last_activity_date"))


def po_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    qty = _money("l_quantity")
    nil = F.lit(0).cast(MONEY)
    # the row id is put together behind the join, so its parts travel as numbers
    return table(spark, sf, "lineitem").join(part, "l_partkey").withColumn("row_id", _line_id()).select(
        "row_id", _renamed("l_orderkey", F.col("l_returnflag") == "R").alias("po_number"), _text("l_suppkey").alias("vendor_number"),
        _text("l_linenumber").alias("line"), qty.alias("qty"), F.col("p_retailprice").alias("unit_price"),
        F.when(F.col("l_linestatus") == "F", qty).otherwise(nil).alias("received_qty"),
        F.when(F.col("l_returnflag") == "A", qty).otherwise(nil).alias("invoiced_qty"),
        _money("l_extendedprice").alias("line_amount"),
        F.when(F.col("l_linestatus") == "F", "Closed").otherwise("Open").alias("status"), _day("l_shipdate").alias("last_activity_date"))


# ------------------------------------------------------------ bank


#: Every event stands on one side.
_BANK_EVENTS, _LEDGER_EVENTS = ("purchase", "signup"), ("click", "view", "error")


def _event_rows(spark: SparkSession, sf: str, kinds: tuple[str, ...], sign: int) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type").isin(*kinds)).select(
        F.col("event_id").alias("row_index"), (_money("value") * sign).cast(MONEY).alias("amount"), _day("ts").alias("txn_date"))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    return _event_rows(spark, sf, _BANK_EVENTS, 1)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The other events, booked with the opposite sign."""
    return _event_rows(spark, sf, _LEDGER_EVENTS, -1)


# ------------------------------------------------------------ budget


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("fund"), F.col("n_name").alias("department"))


def _by_key(rows: DataFrame, tag: str) -> DataFrame:
    keys = ["fund", "account", "department"]
    return rows.groupBy(*keys).agg(F.sum("amount").cast(MONEY).alias("amount")).select(
        F.concat_ws("|", F.lit(tag), *keys).alias("row_id"), *keys, "amount")


def budget(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered value per segment, nation and month, with total lines in between."""
    rows = table(spark, sf, "orders").join(_customers(spark, sf), "o_custkey").select(
        "fund", F.date_format("o_orderdate", "yyyy-MM").alias("account"), "department", _money("o_totalprice").alias("amount"))
    lines = _by_key(rows, "b")
    blank = F.lit("")
    per_fund = lines.groupBy("fund").agg(F.sum("amount").cast(MONEY).alias("amount")).select(
        F.concat(F.lit("bt|"), "fund").alias("row_id"), blank.alias("fund"),
        F.concat(F.lit("TOTAL "), "fund").alias("account"), blank.alias("department"), "amount")
    overall = lines.agg(F.sum("amount").cast(MONEY).alias("amount")).select(
        F.lit("bz|").alias("row_id"), blank.alias("fund"), blank.alias("account"), blank.alias("department"), "amount")
    return lines.unionByName(per_fund).unionByName(overall)


def actuals(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped value on the same keys."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = table(spark, sf, "lineitem").join(orders, "l_orderkey").join(_customers(spark, sf), "o_custkey").select(
        "fund", F.date_format("l_shipdate", "yyyy-MM").alias("account"), "department", _money("l_extendedprice").alias("amount"))
    return _by_key(rows, "a")


def budget_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment and nation that has customers, for the months 1995-2001."""
    months = F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))
    return _customers(spark, sf).select("fund", "department").distinct().withColumn("_m", F.explode(months)).select(
        "fund", F.date_format("_m", "yyyy-MM").alias("account"), "department")


# ------------------------------------------------------------ report


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Order value per priority (section) and customer (account), customer
    balances as a section of their own, stated subtotals and a grand total. The
    low-priority subtotal misses pending orders."""
    orders = table(spark, sf, "orders")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    big = F.max("o_totalprice") > 400000
    lines = (orders.groupBy("o_orderpriority", "o_custkey").agg(F.sum(_money("o_totalprice")).cast(MONEY).alias("amount"), big.alias("_big"))
             .join(names, "o_custkey").select(
                 F.concat_ws("|", "o_orderpriority", F.lpad(_text("o_custkey"), 12, "0")).alias("row_id"),
                 F.col("o_orderpriority").alias("section"), _text("o_custkey").alias("account_code"),
                 F.when(F.col("_big"), F.upper("c_name")).otherwise(F.col("c_name")).alias("account_name"),
                 F.lit("line_item").alias("line_type"), "amount"))
    balances = names.select(F.concat(F.lit("BALANCES|"), F.lpad(_text("o_custkey"), 12, "0")).alias("row_id"), F.lit("BALANCES").alias("section"),
                            _text("o_custkey").alias("account_code"), F.col("c_name").alias("account_name"),
                            F.lit("line_item").alias("line_type"), _money("c_acctbal").alias("amount"))

    def stated(rows: DataFrame, section: Column, row_id: Column, kind: str) -> DataFrame:
        return rows.select(row_id.alias("row_id"), section.alias("section"), F.lit("").alias("account_code"), F.lit("").alias("account_name"),
                           F.lit(kind).alias("line_type"), F.col("amount").cast(MONEY).alias("amount"))

    counted = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(0)).otherwise(_money("o_totalprice"))
    subs = orders.groupBy("o_orderpriority").agg(F.sum(counted).alias("amount"))
    subtotal = stated(subs, F.col("o_orderpriority"), F.concat("o_orderpriority", F.lit("~")), "subtotal")
    bal_sub = stated(names.agg(F.sum(_money("c_acctbal")).alias("amount")), F.lit("BALANCES"), F.lit("BALANCES~"), "subtotal")
    grand = stated(orders.agg(F.sum(_money("o_totalprice")).alias("amount")), F.lit("TOTAL"), F.lit("~~"), "grand_total")
    out = lines
    for part in (balances, subtotal, bal_sub, grand):
        out = out.unionByName(part)
    return out


def prior_report(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped value on the same lines."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    sums = table(spark, sf, "lineitem").join(orders, "l_orderkey").groupBy("o_orderpriority", "o_custkey").agg(
        F.sum(_money("l_extendedprice")).cast(MONEY).alias("amount"))
    return sums.select(F.concat_ws("|", "o_orderpriority", F.lpad(_text("o_custkey"), 12, "0")).alias("row_id"),
                       F.col("o_orderpriority").alias("section"), _text("o_custkey").alias("account_code"), F.lit("").alias("account_name"),
                       F.lit("line_item").alias("line_type"), "amount")


def report_detail(spark: SparkSession, sf: str) -> DataFrame:
    """One report line per line item: flag (section), part (account), quantity."""
    return line_items(spark, sf).select(
        "row_id", F.concat("l_returnflag", "l_linestatus").alias("section"), _text("l_partkey").alias("account_code"),
        _text("l_linenumber").alias("account_name"), F.lit("line_item").alias("line_type"), _money("l_quantity").alias("amount"))


def account_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(_renamed("c_custkey", F.col("c_acctbal") < 0).alias("account_code"))


def required_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the report plus one per market segment, which it lacks."""
    return (table(spark, sf, "orders").select(F.col("o_orderpriority").alias("section"))
            .unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("section"))).distinct())


# ------------------------------------------------------------ journals


def journal_draft(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as journal lines, all text, with the flaws of the data made visible."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    amount = F.when(q == 10, F.floor("l_extendedprice").cast("bigint").cast("string")).otherwise(_money("l_extendedprice").cast("string"))
    debit = F.when(q == 1, "").when((d >= 0.05) | (F.col("l_tax") == 0.08), F.when(q == 2, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount)).otherwise("")
    return wide_table(spark, sf, "lineitem").withColumn("row_id", _line_id()).select(
        "row_id", _text("l_orderkey").alias("journal"), _text("l_linenumber").alias("line"),
        F.when(q == 50, "").when(q == 49, "2000-02-30").otherwise(_day("l_shipdate").cast("string")).alias("date"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), "").otherwise(F.col("l_returnflag")).alias("fund"),
        F.col("l_linestatus").alias("org"), _text("l_suppkey").alias("object"), debit.alias("debit"),
        F.when(q == 1, "").when(d < 0.05, amount).otherwise("").alias("credit"),
        F.when(F.col("l_tax") == 0.01, "ab").otherwise("Shipment").alias("line_description"))


def journal_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as objects in two funds; org O only below a balance of 5 000."""
    orgs = F.when(F.col("s_acctbal") < 5000, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F")))
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.array(F.lit("A"), F.lit("N"))).alias("fund"), orgs.alias("orgs")).select(
        F.col("s_suppkey").alias("row_id"), "fund", F.explode("orgs").alias("org"), _text("s_suppkey").alias("object"),
        F.when(F.col("s_acctbal") < 0, "Inactive").when(F.col("s_acctbal") < 500, "").otherwise("Active").alias("status"))


def journal_history(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations in use; those shipped from April 1995 on had other object codes."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("fund"), F.col("l_linestatus").alias("org"), _renamed("l_suppkey", F.col("l_shipdate") >= "1995-04-01").alias("object")).distinct()


def clean_draft(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a balanced journal of two lines."""
    amount = _money("o_totalprice").cast("string")
    side = F.explode(F.array(F.struct(F.lit("1").alias("line"), amount.alias("debit"), F.lit("").alias("credit")),
                             F.struct(F.lit("2").alias("line"), F.lit("").alias("debit"), amount.alias("credit"))))
    return table(spark, sf, "orders").withColumn("_s", side).select(
        F.concat_ws("-", F.lpad(_text("o_orderkey"), 12, "0"), "_s.line").alias("row_id"), _text("o_orderkey").alias("journal"), "_s.line",
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), F.col("o_orderstatus").alias("fund"), F.col("o_orderpriority").alias("org"),
        _text("o_custkey").alias("object"), "_s.debit", "_s.credit", F.lit("Order value").alias("line_description"))


def clean_chart(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority", "o_custkey").agg(F.min("o_orderkey").alias("row_id")).select(
        "row_id", F.col("o_orderstatus").alias("fund"), F.col("o_orderpriority").alias("org"), _text("o_custkey").alias("object"),
        F.lit("Active").alias("status"))


# ------------------------------------------------------------ search


def search_modules(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("vendor_name"))
    gl = line_items(spark, sf).join(part, "l_partkey").select(
        "row_id", _day("l_shipdate").alias("date"), F.col("l_returnflag").alias("fund"), F.col("l_linestatus").alias("org"),
        _text("l_suppkey").alias("object"), F.concat_ws(" ", "p_name", "p_brand").alias("description"),
        _text("l_orderkey").alias("invoice_number"),
        F.when(F.col("l_returnflag") == "R", -_money("l_extendedprice")).otherwise(_money("l_extendedprice")).cast(MONEY).alias("amount"))
    ap = line_items(spark, sf).join(names, "l_suppkey").select(
        "row_id", "vendor_name", _text("l_orderkey").alias("invoice_number"), _day("l_shipdate").alias("invoice_date"),
        _money("l_extendedprice").alias("invoice_amount"), _text("l_orderkey").alias("po_number"))
    return {"gl_detail": gl, "ap_invoice_detail": ap,
            "check_register": checks(spark, sf).select("row_id", "check_number", "check_date", "check_amount"),
            "purchase_orders": table(spark, sf, "orders").select(
                F.lpad(_text("o_orderkey"), 12, "0").alias("row_id"), _text("o_orderkey").alias("po_number"),
                _day("o_orderdate").alias("po_date"), _money("o_totalprice").alias("line_amount"))}


def search_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Saved searches: invoices of vendors in debt, large ledger lines per
    object, and large orders per month."""
    sup = table(spark, sf, "supplier")
    by_vendor = sup.where("s_acctbal < 0").select(
        F.concat(F.lit("v"), _text("s_suppkey")).alias("query_id"), F.upper("s_name").alias("vendor"), F.lit("50000").alias("amount_min"))
    by_object = sup.where("s_acctbal >= 9500").select(
        F.concat(F.lit("o"), _text("s_suppkey")).alias("query_id"), _text("s_suppkey").alias("object_code"), F.lit("A").alias("fund"),
        F.lit("1999-01-01").alias("date_from"))
    months = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    by_month = months.select(F.concat(F.lit("m"), F.date_format("m", "yyyyMM")).alias("query_id"), F.lit("po").alias("module"),
                             _text("m").alias("date_from"), F.last_day("m").cast("string").alias("date_to"), F.lit("450000").alias("amount_min"))
    return by_vendor.unionByName(by_object, allowMissingColumns=True).unionByName(by_month, allowMissingColumns=True)


# ------------------------------------------------------------ exports, runs, drafts


def export_text(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices as an export prints them: dates in seven written forms, amounts
    with signs, brackets and commas, number and name of the vendor in one cell,
    and a total line per order date and priority."""
    day = _day("l_shipdate")
    fmts = ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MMM-yyyy", "MMM d, yyyy"]
    shown = F.lit("")
    for i, f in enumerate(fmts, 1):
        shown = F.when(F.col("l_linenumber") == i, F.date_format(day, f)).otherwise(shown)
    comma = F.format_number(_money("l_extendedprice"), 2)
    plain = _money("l_extendedprice").cast("string")
    amount = (F.when(F.col("l_quantity") == 50, "").when(F.col("l_returnflag") == "A", F.concat(F.lit("$"), comma))
              .when(F.col("l_returnflag") == "N", F.concat(F.lit("("), comma, F.lit(")"))).otherwise(F.concat(plain, F.lit("-"))))
    rows = wide_table(spark, sf, "lineitem").withColumn("row_id", _line_id()).select(
        "row_id", F.concat(_text("l_suppkey"), F.lit(" Supplier#"), F.lpad(_text("l_suppkey"), 9, "0")).alias("Vendor"),
        _text("l_orderkey").alias("Inv No"), F.when(F.col("l_quantity") == 49, "n/a").otherwise(shown).alias("Inv Date"),
        amount.alias("Gross Amount"), _text("l_partkey").alias("Purchase Order"), F.lit("Paid").alias("Invoice Status"))
    totals = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), F.lpad(_text("o_orderkey"), 12, "0")).alias("row_id"), F.lit("").alias("Vendor"), F.lit("").alias("Inv No"),
        F.lit("").alias("Inv Date"), _money("o_totalprice").cast("string").alias("Gross Amount"), F.lit("").alias("Purchase Order"),
        F.lit("Total").alias("Invoice Status"))
    return rows.unionByName(totals)


ACTIONS = {"signup": "created", "click": "mark_reviewed", "view": "add_note", "purchase": "approve_draft", "error": "reject_ai_explanation"}


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"),
                                             names[F.col("event_type")].alias("action"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.sum(_money("value")).alias("v"), F.max("event_id").alias("m"))
    return first.select(F.col("user_id").alias("run_id"), "created_at",
                        F.when(F.col("v") > 5000, "bank_reconciliation").otherwise("budget_variance").alias("workflow_type"),
                        F.when(F.col("v") > 2500, "completed").otherwise("failed").alias("status"))


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("draft_id"), F.col("ts").alias("created_at"),
        F.when(F.col("value") > 50, "t2").otherwise("t1").alias("template"), F.when(F.col("value") < 20, "m1").otherwise("m2").alias("model"),
        F.col("props").alias("summary"), (F.col("value") > 5).alias("passed"))


def draft_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Two cited rows per draft."""
    k = F.get_json_object("props", "$.k")
    refs = F.explode(F.array(F.concat(F.lit("events:"), k), F.concat(F.lit("users:"), _text("user_id"))))
    return table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("event_id").alias("draft_id"), F.col("user_id").alias("run_id"), refs.alias("ref"))


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_id"), F.date_add(F.lit("2024-01-10").cast("date"), F.col("c_nationkey")).alias("next_due"),
        F.when(seg == "BUILDING", "monthly").when(seg == "MACHINERY", "quarterly").otherwise("custom").alias("cadence"),
        F.when(seg == "AUTOMOBILE", 10).alias("interval_days"), (F.col("c_acctbal") > 0).alias("active"))


def order_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """One written sentence set per order, quoting its key, date and value."""
    total = F.format_number(_money("o_totalprice"), 2)
    return wide_table(spark, sf, "orders", _DRAFTS_PER_TASK).select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit("Order ORD-"), _text("o_orderkey"), F.lit(" dated "), _day("o_orderdate").cast("string"), F.lit(" has a value of $"), total,
        F.lit(", see orders:"), _text("o_orderkey"), F.lit(" (row "), _text("o_custkey"), F.lit(")."),
        F.when(F.col("o_orderstatus") == "F", " This report is approved. The batch was fully reconciled!").otherwise(" The batch needs review.")).alias("text"))


def order_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """What is known about an order: its date, its customer row, its rounded-down value."""
    return wide_table(spark, sf, "orders", _DRAFTS_PER_TASK).select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit("ORD-"), _text("o_orderkey"), F.lit(" | "), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("2000-01-01")).otherwise(_day("o_orderdate").cast("string")),
        F.lit(" | customers:"), _text("o_custkey"), F.lit(" | value "),
        F.when(F.col("o_orderstatus") == "P", F.lit("1.00")).otherwise(_money("o_totalprice").cast("string"))).alias("text"))


# ------------------------------------------------------------ the same views as SQL

M = "DECIMAL(18,2)"
_LINE_ID = (f"concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 10, '0'), "
            f"lpad(l_suppkey::VARCHAR, 10, '0'), (l_extendedprice::{M})::VARCHAR)")
_CHECK_NO = "concat_ws('-', l_suppkey::VARCHAR, strftime(l_shipdate, '%Y%m%d'))"

SQL: dict[str, str] = {
    "li": f"SELECT *, {_LINE_ID} AS row_id FROM lineitem",
    "ap": f"""SELECT row_id, l_suppkey::VARCHAR AS vendor_number, '' AS vendor_name, l_orderkey::VARCHAR AS invoice_number,
        l_shipdate::DATE AS invoice_date, l_extendedprice::{M} AS invoice_amount,
        CASE WHEN l_linenumber = 7 THEN '' ELSE l_orderkey::VARCHAR END AS po_number,
        l_quantity::{M} AS qty, l_extendedprice / l_quantity AS unit_price FROM li""",
    "ap_dated": f"""SELECT row_id, l_suppkey::VARCHAR AS vendor_number, l_orderkey::VARCHAR AS invoice_number,
        o_orderdate::DATE AS invoice_date, l_extendedprice::{M} AS invoice_amount, {_CHECK_NO} AS check_number
        FROM li JOIN orders ON o_orderkey = l_orderkey""",
    "ap_events": f"""SELECT event_id AS row_id, user_id::VARCHAR AS vendor_number, event_id::VARCHAR AS invoice_number,
        ts::DATE AS invoice_date, value::{M} AS invoice_amount FROM events""",
    "vendors": """SELECT s_suppkey AS row_id, CASE WHEN s_acctbal > 9000 THEN 'X' ELSE '' END || s_suppkey AS vendor_number, s_name AS vendor_name,
        CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status FROM supplier""",
    "checks": f"""SELECT row_id, {_CHECK_NO} AS check_number, l_shipdate::DATE AS check_date, l_suppkey::VARCHAR AS vendor_number,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0.08 THEN 'Void' ELSE 'Cleared' END AS status,
        l_extendedprice::{M} AS check_amount, l_orderkey::VARCHAR || '; P' || l_partkey::VARCHAR AS invoice_numbers FROM li""",
    "po_h": f"""SELECT o_orderkey AS row_id, CASE WHEN o_totalprice < 5000 THEN 'X' ELSE '' END || o_orderkey AS po_number, o_totalprice::{M} AS line_amount,
        CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS status, o_orderdate::DATE AS last_activity_date
        FROM orders""",
    "po_l": f"""SELECT row_id, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE '' END || l_orderkey AS po_number, l_suppkey::VARCHAR AS vendor_number, l_linenumber::VARCHAR AS line,
        l_quantity::{M} AS qty, p_retailprice AS unit_price,
        CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END::{M} AS received_qty,
        CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END::{M} AS invoiced_qty,
        l_extendedprice::{M} AS line_amount, CASE WHEN l_linestatus = 'F' THEN 'Closed' ELSE 'Open' END AS status,
        l_shipdate::DATE AS last_activity_date
        FROM li JOIN part ON p_partkey = l_partkey""",
    "bank": f"SELECT event_id AS row_index, value::{M} AS amount, ts::DATE AS txn_date FROM events WHERE event_type IN {_BANK_EVENTS}",
    "ledger": f"SELECT event_id AS row_index, -(value::{M}) AS amount, ts::DATE AS txn_date FROM events WHERE event_type IN {_LEDGER_EVENTS}",
    "cust": "SELECT c_custkey, c_mktsegment AS fund, n_name AS department FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "budget": f"""SELECT fund, strftime(o_orderdate, '%Y-%m') AS account, department, sum(o_totalprice::{M})::{M} AS amount
        FROM orders JOIN cust ON c_custkey = o_custkey GROUP BY ALL""",
    "actuals": f"""SELECT fund, strftime(l_shipdate, '%Y-%m') AS account, department, sum(l_extendedprice::{M})::{M} AS amount
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN cust ON c_custkey = o_custkey GROUP BY ALL""",
    "chart_b": """SELECT fund, strftime(m, '%Y-%m') AS account, department FROM (SELECT DISTINCT fund, department FROM cust),
        generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) AS g(m)""",
    "report": f"""SELECT o_orderpriority || '|' || lpad(c_custkey::VARCHAR, 12, '0') AS row_id, o_orderpriority AS section,
        c_custkey::VARCHAR AS account_code, CASE WHEN max(o_totalprice) > 400000 THEN upper(c_name) ELSE c_name END AS account_name,
        'line_item' AS line_type, sum(o_totalprice::{M})::{M} AS amount
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderpriority, c_custkey, c_name
        UNION ALL SELECT 'BALANCES|' || lpad(c_custkey::VARCHAR, 12, '0'), 'BALANCES', c_custkey::VARCHAR, c_name, 'line_item', c_acctbal::{M} FROM customer
        UNION ALL SELECT o_orderpriority || '~', o_orderpriority, '', '', 'subtotal',
          sum(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 0 ELSE o_totalprice::{M} END)::{M} FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'BALANCES~', 'BALANCES', '', '', 'subtotal', sum(c_acctbal::{M})::{M} FROM customer
        UNION ALL SELECT '~~', 'TOTAL', '', '', 'grand_total', sum(o_totalprice::{M})::{M} FROM orders""",
    "prior": f"""SELECT o_orderpriority || '|' || lpad(o_custkey::VARCHAR, 12, '0') AS row_id, o_orderpriority AS section,
        o_custkey::VARCHAR AS account_code, sum(l_extendedprice::{M})::{M} AS amount
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority, o_custkey""",
    "je": f"""SELECT row_id, l_orderkey::VARCHAR AS journal, l_linenumber::VARCHAR AS line, l_shipdate::DATE AS d, l_quantity AS q,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN '' ELSE l_returnflag END AS fund, l_linestatus AS org, l_suppkey::VARCHAR AS object,
        CASE WHEN l_quantity IN (49, 50) THEN NULL ELSE l_shipdate::DATE END AS eff_date,
        (CASE WHEN l_quantity = 1 THEN NULL WHEN l_discount >= 0.05 OR l_tax = 0.08 THEN
          CASE WHEN l_quantity = 2 THEN -1 ELSE 1 END * CASE WHEN l_quantity = 10 THEN floor(l_extendedprice)::DECIMAL(18,4) ELSE l_extendedprice::{M}::DECIMAL(18,4) END
          END)::DECIMAL(18,4) AS dr,
        (CASE WHEN l_quantity = 1 THEN NULL WHEN l_discount < 0.05 THEN
          CASE WHEN l_quantity = 10 THEN floor(l_extendedprice)::DECIMAL(18,4) ELSE l_extendedprice::{M}::DECIMAL(18,4) END END)::DECIMAL(18,4) AS cr,
        CASE WHEN l_tax = 0.01 THEN 'ab' ELSE 'Shipment' END AS line_description FROM li""",
    "coa": """SELECT fund, org, s_suppkey::VARCHAR AS object,
        CASE WHEN s_acctbal < 0 THEN 'inactive' WHEN s_acctbal < 500 THEN '' ELSE 'active' END AS status
        FROM supplier, (VALUES ('A'), ('N')) f(fund), (VALUES ('F'), ('O')) o(org) WHERE org = 'F' OR s_acctbal < 5000""",
    "hist": """SELECT DISTINCT l_returnflag AS fund, l_linestatus AS org,
        CASE WHEN l_shipdate >= TIMESTAMP '1995-04-01' THEN 'X' ELSE '' END || l_suppkey AS object FROM lineitem""",
    "s_gl": f"""SELECT 'gl_detail' AS module, row_id, NULL AS vendor_name, l_orderkey::VARCHAR AS invoice_number, NULL AS po_number,
        NULL AS check_number, l_returnflag AS fund, l_linestatus AS department, l_suppkey::VARCHAR AS object_code, l_shipdate::DATE AS txn_date,
        CASE WHEN l_returnflag = 'R' THEN -(l_extendedprice::{M}) ELSE l_extendedprice::{M} END AS amount, p_name || ' ' || p_brand AS description
        FROM li JOIN part ON p_partkey = l_partkey""",
    "s_ap": f"""SELECT 'ap_invoice_detail' AS module, row_id, s_name AS vendor_name, l_orderkey::VARCHAR AS invoice_number,
        l_orderkey::VARCHAR AS po_number, NULL AS check_number, NULL AS fund, NULL AS department, NULL AS object_code,
        l_shipdate::DATE AS txn_date, l_extendedprice::{M} AS amount, '' AS description FROM li JOIN supplier ON s_suppkey = l_suppkey""",
    "s_chk": """SELECT 'check_register' AS module, row_id, NULL AS vendor_name, NULL AS invoice_number, NULL AS po_number, check_number,
        NULL AS fund, NULL AS department, NULL AS object_code, check_date AS txn_date, check_amount AS amount, '' AS description FROM checks""",
    "s_po": f"""SELECT 'purchase_orders' AS module, lpad(o_orderkey::VARCHAR, 12, '0') AS row_id, NULL AS vendor_name, NULL AS invoice_number,
        o_orderkey::VARCHAR AS po_number, NULL AS check_number, NULL AS fund, NULL AS department, NULL AS object_code,
        o_orderdate::DATE AS txn_date, o_totalprice::{M} AS amount, '' AS description FROM orders""",
    "tx": "SELECT * FROM s_gl UNION ALL SELECT * FROM s_ap UNION ALL SELECT * FROM s_chk UNION ALL SELECT * FROM s_po",
    "hits": """SELECT 'v' || s_suppkey::VARCHAR AS query_id, module, row_id, txn_date, amount FROM supplier JOIN tx ON vendor_name = s_name
        AND abs(amount) >= 50000 WHERE s_acctbal < 0
        UNION ALL SELECT 'o' || s_suppkey::VARCHAR, module, row_id, txn_date, amount FROM supplier JOIN tx ON object_code = s_suppkey::VARCHAR
        AND fund = 'A' AND txn_date >= DATE '1999-01-01' WHERE s_acctbal >= 9500
        UNION ALL SELECT 'm' || strftime(txn_date, '%Y%m'), module, row_id, txn_date, amount FROM tx
        WHERE module = 'purchase_orders' AND abs(amount) >= 450000""",
    "acts": """SELECT user_id AS run_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'mark_reviewed'
        WHEN 'view' THEN 'add_note' WHEN 'purchase' THEN 'approve_draft' ELSE 'reject_ai_explanation' END AS action FROM events""",
    "runs": f"""SELECT user_id AS run_id, min(ts) AS created_at,
        CASE WHEN sum(value::{M}) > 5000 THEN 'bank_reconciliation' ELSE 'budget_variance' END AS workflow_type,
        CASE WHEN sum(value::{M}) > 2500 THEN 'completed' ELSE 'failed' END AS status FROM events GROUP BY user_id""",
    "drafts": """SELECT user_id AS run_id, event_id AS draft_id, ts AS created_at, CASE WHEN value > 50 THEN 't2' ELSE 't1' END AS template,
        CASE WHEN value < 20 THEN 'm1' ELSE 'm2' END AS model, props AS summary, value > 5 AS passed FROM events WHERE event_type = 'view'""",
    "refs": """SELECT event_id AS draft_id, user_id AS run_id, unnest(['events:' || json_extract_string(props, '$.k'), 'users:' || user_id::VARCHAR]) AS ref
        FROM events WHERE event_type = 'view'""",
}


def with_views(body: str) -> str:
    """``body`` with the views it names (and theirs) as common table expressions."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if name not in used and re.search(rf"(?<![\w.'])(?:FROM|JOIN|,|IN \(SELECT \w+ FROM)\s+{name}\b", text):
                need(SQL[name])
                if name not in used:
                    used.append(name)

    need(body)
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in used)
    return f"WITH {ctes}\n{body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {ctes},\n{body.lstrip()[5:]}"
