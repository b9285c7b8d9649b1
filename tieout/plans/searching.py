"""Queries: transaction search, criteria, profiling, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators import criteria, profiling, search
from tieout.plans import views as v
from tieout.plans.registry import add, query
from tieout.session import scratch_path
from tieout.sources import datasets, exports, files

# ------------------------------------------------------------ search

_TX = "module, row_id, txn_date, amount"


def _tx(spark, sf):
    return search.all_modules(v.search_modules(spark, sf))


def _out(df):
    return df.select("module", "row_id", "txn_date", "amount")


add("all_modules", lambda spark, sf: _out(_tx(spark, sf)), f"SELECT {_TX} FROM tx")
add("search_vendor", lambda spark, sf: _out(search.search_vendor(_tx(spark, sf), "supplier#00000001", None)),
    f"SELECT {_TX} FROM tx WHERE vendor_name LIKE 'Supplier#00000001%'")
add("search_vendor_similar", lambda spark, sf: _out(search.search_vendor(_tx(spark, sf), "supplier 000000013")))
add("search_reference", lambda spark, sf: _out(search.search_equal(_tx(spark, sf), "invoice_number", " 1234 ")),
    f"SELECT {_TX} FROM tx WHERE invoice_number = '1234'")
add("search_dimension", lambda spark, sf: _out(search.search_equal(search.search_equal(_tx(spark, sf), "department", "o"), "object_code", "17")),
    f"SELECT {_TX} FROM tx WHERE department = 'O' AND object_code = '17'")
add("search_date_range", lambda spark, sf: _out(search.search_date_range(_tx(spark, sf), "1998-03-01", "1998-03-31")),
    f"SELECT {_TX} FROM tx WHERE txn_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
add("search_amount_range", lambda spark, sf: _out(search.search_amount_range(_tx(spark, sf), 90000, 99000)),
    f"SELECT {_TX} FROM tx WHERE abs(amount) BETWEEN 90000 AND 99000")
add("search_keywords", lambda spark, sf: _out(search.search_keywords(_tx(spark, sf), ["Widget", "brand 17"])),
    f"SELECT {_TX} FROM tx WHERE description LIKE '%widget%' OR description LIKE '%Brand#17%'")


def _hits(spark, sf):
    return search.batch_search(v.search_criteria(spark, sf), _tx(spark, sf), None)


add("batch_search", _hits, "SELECT query_id, module, row_id, txn_date, amount FROM hits")
_RANK = "CASE module WHEN 'gl_detail' THEN 1 WHEN 'ap_invoice_detail' THEN 2 WHEN 'check_register' THEN 3 ELSE 4 END"
add("capped_search", lambda spark, sf: search.capped_search(_hits(spark, sf), 20), f"""
SELECT query_id, position::INTEGER AS position, module, row_id, txn_date, amount, n > 20 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
  row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, row_id) AS position FROM hits) WHERE position <= 20""")
add("search_summary", lambda spark, sf: search.search_summary(_hits(spark, sf)), """
SELECT query_id, module, count(*) AS n_matches, sum(amount)::DECIMAL(28,2) AS total_signed_amount,
  sum(count(*)) OVER (PARTITION BY query_id) > 200 AS truncated FROM hits GROUP BY query_id, module""")


def _written_queries(spark, sf):
    """One plain-language search per order."""
    month = F.date_format("o_orderdate", "MMMM yyyy")
    text = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("find payments over $"), F.col("o_totalprice").cast("bigint").cast("string"), F.lit(" in "), month))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string"), F.lit(" between $1,000 and $"),
                                                          F.col("o_totalprice").cast("bigint").cast("string"), F.lit(" asphalt repair")))
            .otherwise(F.concat(F.lit("check number "), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(" fund 100 to \"Acme\" in march"))))
    return v.wide_table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), text.alias("query"))


@query("parse_search_criteria", """
SELECT o_orderkey AS query_id,
  CASE o_orderstatus WHEN 'F' THEN trunc(o_totalprice)::BIGINT::DECIMAL(18,2) WHEN 'O' THEN CASE WHEN trunc(o_totalprice) >= 1000 THEN 1000::DECIMAL(18,2) END END AS amount_min,
  CASE o_orderstatus WHEN 'O' THEN CASE WHEN trunc(o_totalprice) >= 1000 THEN trunc(o_totalprice)::BIGINT::DECIMAL(18,2) END END AS amount_max,
  CASE o_orderstatus WHEN 'O' THEN 'PO-' || o_orderkey::VARCHAR END AS po_number,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN lpad(o_orderkey::VARCHAR, 6, '0') END AS check_number,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN '100' END AS fund,
  CASE o_orderstatus WHEN 'F' THEN date_trunc('month', o_orderdate)::DATE::VARCHAR END AS date_from,
  CASE o_orderstatus WHEN 'F' THEN last_day(o_orderdate)::VARCHAR END AS date_to,
  CASE o_orderstatus WHEN 'F' THEN 'ap' WHEN 'O' THEN 'po' END AS module,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Acme' END AS vendor,
  CASE o_orderstatus WHEN 'O' THEN 'asphalt,repair' ELSE '' END AS keywords,
  (CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 WHEN o_orderstatus = 'O' AND trunc(o_totalprice) < 1000 THEN 1 ELSE 0 END)::INTEGER AS n_unparsed
FROM orders""")
def parse_search_criteria(spark, sf):
    out = criteria.parse_search_criteria(_written_queries(spark, sf))
    return out.select("query_id", F.col("amount_min").cast(s.MONEY).alias("amount_min"), F.col("amount_max").cast(s.MONEY).alias("amount_max"),
                      "po_number", "check_number", "fund", "date_from", "date_to", "module", "vendor", F.array_join("keywords", ",").alias("keywords"),
                      F.size("unparsed").alias("n_unparsed"))


# ------------------------------------------------------------ profiling

_EXPORT = ["Vendor", "Inv No", "Inv Date", "Gross Amount", "Purchase Order", "Invoice Status"]


@query("parse_confidence", """
WITH n AS (SELECT count(*) AS c FROM lineitem), o AS (SELECT count(*) AS c FROM orders), d AS (SELECT count(*) FILTER (WHERE l_quantity = 49) AS bad,
  count(*) FILTER (WHERE l_quantity = 50) AS blank FROM lineitem)
SELECT * FROM (SELECT 'Vendor' AS "column", n.c AS non_blank, 0::DOUBLE AS date_confidence, 0::DOUBLE AS amount_confidence FROM n
  UNION ALL SELECT 'Inv No', n.c, 0, 1 FROM n UNION ALL SELECT 'Inv Date', n.c, (n.c - bad)::DOUBLE / n.c, 0 FROM n, d
  UNION ALL SELECT 'Gross Amount', n.c - blank + o.c, 0, 1 FROM n, o, d UNION ALL SELECT 'Purchase Order', n.c, 0, 1 FROM n
  UNION ALL SELECT 'Invoice Status', n.c + o.c, 0, 0 FROM n, o)""")
def parse_confidence(spark, sf):
    return profiling.parse_confidence(v.export_text(spark, sf), _EXPORT).select("column", "non_blank", "date_confidence", "amount_confidence")


def _with_headers(spark, sf):
    """The export with its header line repeated once per order, as page breaks print it."""
    rows = v.export_text(spark, sf)
    heads = v.table(spark, sf, "orders").select(F.concat(F.lit("h"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("row_id"),
                                                *[F.lit(c.upper()).alias(c) for c in _EXPORT])
    return rows.unionByName(heads)


add("repeated_header_rows", lambda spark, sf: profiling.repeated_header_rows(_with_headers(spark, sf), _EXPORT).select("row_id"),
    "SELECT 'h' || lpad(o_orderkey::VARCHAR, 12, '0') AS row_id FROM orders")
add("footer_total_rows", lambda spark, sf: profiling.footer_total_rows(v.export_text(spark, sf), _EXPORT).select("row_id", "Gross Amount"), """
SELECT 't' || lpad(o_orderkey::VARCHAR, 12, '0') AS row_id, (o_totalprice::DECIMAL(18,2))::VARCHAR AS "Gross Amount" FROM orders""")


def _event_rows(spark, sf):
    return v.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", F.to_date("ts").alias("day"))


_EV = "ev AS (SELECT event_id AS row_id, user_id::VARCHAR AS user_id, event_type, ts::DATE::VARCHAR AS day FROM events)"
add("duplicate_rows", lambda spark, sf: profiling.duplicate_rows(_event_rows(spark, sf)), f"""
WITH {_EV} SELECT row_id, first_row FROM (SELECT row_id, min(row_id) OVER (PARTITION BY user_id, event_type, day) AS first_row FROM ev) WHERE row_id <> first_row""")
add("duplicate_row_groups", lambda spark, sf: profiling.duplicate_row_groups(_event_rows(spark, sf)), f"""
WITH {_EV} SELECT user_id, event_type, day, count(*) AS n_rows, min(row_id) AS first_row FROM ev GROUP BY ALL HAVING count(*) > 1""")
add("file_profile", lambda spark, sf: profiling.file_profile(_with_headers(spark, sf), "invoices", _EXPORT), """
WITH n AS (SELECT count(*) AS c FROM lineitem), o AS (SELECT count(*) AS c FROM orders),
e AS (SELECT count(*) AS k FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey, CASE WHEN l_quantity = 49 THEN 'n/a' ELSE l_linenumber::VARCHAR || l_shipdate::VARCHAR END,
  CASE WHEN l_quantity = 50 THEN '' ELSE l_returnflag || l_extendedprice::VARCHAR END HAVING count(*) > 1
  UNION ALL SELECT count(*) FROM orders GROUP BY o_totalprice::DECIMAL(18,2) HAVING count(*) > 1 UNION ALL SELECT count(*) FROM orders HAVING count(*) > 1)
SELECT 'invoices' AS input_key, n.c + 2 * o.c AS n_rows, 6::BIGINT AS n_columns, o.c AS repeated_headers, o.c AS footer_totals,
  (SELECT sum(k - 1) FROM e)::BIGINT AS duplicate_rows, (SELECT count(*) FROM e) AS duplicate_groups, 0::BIGINT AS blank_columns FROM n, o""")


@query("semantic_mapping", """
SELECT * FROM (VALUES ('amount', 'gross_amount', 0.8::DOUBLE, 'unmapped', 1::BIGINT), ('description', 'vendor', 1.0, 'auto', 1),
  ('account_code', NULL, NULL, NULL, NULL)) t(semantic, mapped_column, confidence, source, n_candidates) WHERE mapped_column IS NOT NULL
UNION ALL SELECT 'date', 'inv_date', round(0.5 * 0.6 + 0.5 * (count(*) FILTER (WHERE l_quantity <> 49))::DOUBLE / count(*), 4), 'unmapped', 1 FROM lineitem""")
def semantic_mapping(spark, sf):
    wanted = ("date", "amount", "description", "account_code")
    profile = profiling.parse_confidence(v.export_text(spark, sf), _EXPORT)
    return profiling.semantic_mapping(profile, {k: profiling.SYNONYMS[k] for k in wanted}).drop("input_key")


@query("preflight_status", """
SELECT user_id AS input_key, CASE WHEN max(event_type = 'error') THEN 'FAIL' WHEN max(event_type = 'purchase') THEN 'PARTIAL' ELSE 'PASS' END AS status,
  count(*) FILTER (WHERE event_type IN ('error', 'purchase', 'view')) AS n_findings FROM events GROUP BY user_id""")
def preflight_status(spark, sf):
    """Errors block, purchases are notable, views are information."""
    events = v.table(spark, sf, "events").withColumnRenamed("user_id", "input_key")
    found = events.where("event_type in ('error', 'purchase', 'view')").select(
        "input_key", (F.col("event_type") == "error").alias("blocks_run"),
        F.when(F.col("event_type") == "view", "info").otherwise("medium").alias("severity"))
    return profiling.preflight_status(found, events)


_ACTION = """CASE event_type WHEN 'error' THEN 'Correct values of class ' || floor(value / 10)::BIGINT WHEN 'purchase' THEN 'Confirm class ' || floor(value / 25)::BIGINT
  WHEN 'click' THEN 'Look at the file' WHEN 'signup' THEN 'Confirm class 1' END"""


def _preflight_events(spark, sf):
    """Every event a finding of its user's file: errors block, views ask nothing."""
    kind, value = F.col("event_type"), F.col("value")
    label = lambda text, width: F.concat(F.lit(text), F.floor(value / width).cast("string"))
    action = (F.when(kind == "error", label("Correct values of class ", 10)).when(kind == "purchase", label("Confirm class ", 25))
              .when(kind == "click", "Look at the file").when(kind == "signup", "Confirm class 1"))
    return v.table(spark, sf, "events").select(F.col("user_id").alias("input_key"), F.col("event_id").alias("position"), (kind == "error").alias("blocks_run"),
                                               F.when(kind == "view", "info").otherwise("medium").alias("severity"), action.alias("action"))


@query("preflight_steps", f"""
WITH f AS (SELECT user_id, event_id, event_type = 'error' AS blocks, {_ACTION} AS step FROM events),
k AS (SELECT *, bool_or(blocks) OVER (PARTITION BY user_id) AS blocked FROM f),
g AS (SELECT user_id, step, min(event_id) AS pos FROM k WHERE blocks OR NOT blocked GROUP BY 1, 2)
SELECT user_id AS input_key, row_number() OVER (PARTITION BY user_id ORDER BY pos, step) AS step_no, step FROM g WHERE step <> ''""")
def preflight_steps(spark, sf):
    return profiling.preflight_steps(_preflight_events(spark, sf))


@query("supported_checks", """
SELECT user_id AS input_key, "check" FROM (SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error' AND value < 10)), (VALUES ('exact'), ('timing'), ('duplicates')) t("check")""")
def supported_checks(spark, sf):
    """Errors of the smallest class block."""
    found = _preflight_events(spark, sf).withColumn("blocks_run", F.col("action") == "Correct values of class 0")
    status = profiling.preflight_status(found.fillna(False, ["blocks_run"]), found)
    return profiling.supported_checks(status, ["exact", "timing", "duplicates"])


@query("preflight_findings", """
SELECT 'gross_amount' AS mapped_column, 'amount' AS semantic, 'low_amount_parse_confidence' AS code, 'high' AS severity, true AS blocks_run WHERE false
UNION ALL SELECT NULL, 'fund', c, 'high', true FROM (VALUES ('missing_required_column'), ('needs_human_configuration')) t(c)
UNION ALL SELECT 'inv_date', 'date', 'low_date_parse_confidence', 'high', true FROM lineitem HAVING count(*) FILTER (WHERE l_quantity <> 49)::DOUBLE / count(*) < 0.8""")
def preflight_findings(spark, sf):
    profile = profiling.parse_confidence(v.export_text(spark, sf), _EXPORT)
    wanted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit("input").alias("input_key"), F.lit(c).alias("semantic"), F.lit(r).alias("required"))
                                                       for c, r in (("date", True), ("amount", True), ("fund", True), ("section", False))])).alias("w")).select("w.*")
    mapping = profiling.semantic_mapping(profile)
    found = profiling.preflight_findings(mapping, profile, wanted)
    return found.join(mapping.select("semantic", "mapped_column"), "semantic", "left").select("mapped_column", "semantic", "code", "severity", "blocks_run")


# ------------------------------------------------------------ exported files

_TRUE = """ex AS (SELECT row_id, l_suppkey::VARCHAR AS vendor_number, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS vendor_name, l_orderkey::VARCHAR AS invoice_number,
  CASE WHEN l_quantity <> 49 THEN l_shipdate::DATE END AS invoice_date,
  (CASE WHEN l_quantity = 50 THEN NULL WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * l_extendedprice::DECIMAL(18,2))::DECIMAL(18,4) AS invoice_amount FROM li
  UNION ALL SELECT 't' || lpad(o_orderkey::VARCHAR, 12, '0'), '', '', '', NULL, o_totalprice::DECIMAL(18,2)::DECIMAL(18,4) FROM orders)"""
_NORMAL = ["row_id", "vendor_number", "vendor_name", "invoice_number", "invoice_date", "invoice_amount"]


def _normal(spark, sf):
    return exports.normalize_export(v.export_text(spark, sf), "ap_invoice_detail", row_id="row_id", as_of=dt.date(2000, 1, 1))


add("normalize_export", lambda spark, sf: _normal(spark, sf)[0].select(*_NORMAL), f"WITH {_TRUE} SELECT * FROM ex")
add("normalize_export_rejects", lambda spark, sf: _normal(spark, sf)[1],
    """SELECT row_id, 'invoice_date' AS "column", 'n/a' AS value FROM li WHERE l_quantity = 49""")
add("normalize_export_warnings", lambda spark, sf: _normal(spark, sf)[2],
    "SELECT 't' || lpad(o_orderkey::VARCHAR, 12, '0') AS row_id, 'footer_total_rows' AS code FROM orders")
add("canonicalize_columns", lambda spark, sf: exports.canonicalize_columns(v.export_text(spark, sf), "ap_invoice_detail").select(
    "row_id", "invoice_number", "invoice_amount", "po_number", "status"), """
SELECT row_id, invoice_number, CASE WHEN l_quantity = 50 THEN '' WHEN l_returnflag = 'A' THEN '$' || format('{:,.2f}', l_extendedprice)
  WHEN l_returnflag = 'N' THEN '(' || format('{:,.2f}', l_extendedprice) || ')' ELSE (l_extendedprice::DECIMAL(18,2))::VARCHAR || '-' END AS invoice_amount,
  l_partkey::VARCHAR AS po_number, 'Paid' AS status FROM (SELECT *, l_orderkey::VARCHAR AS invoice_number FROM li)
UNION ALL SELECT 't' || lpad(o_orderkey::VARCHAR, 12, '0'), '', (o_totalprice::DECIMAL(18,2))::VARCHAR, '', 'Total' FROM orders""")


@query("unposted_journals", """
SELECT row_id, strftime(l_shipdate, '%Y') AS fiscal_year, strftime(l_shipdate, '%m') AS period FROM li WHERE l_returnflag = 'N'""")
def unposted_journals(spark, sf):
    mark = F.when(F.col("l_returnflag") == "N", "*").otherwise("")
    rows = v.line_items(spark, sf).select("row_id", F.concat(mark, F.date_format("l_shipdate", "yy/MM")).alias("yr_pr"))
    return exports.unposted_journals(rows).select("row_id", "fiscal_year", "period")


def _headers(spark, sf):
    """Files with headers: one file per order, the layouts in turn, two columns of
    which appear per order line."""
    names = list(datasets.DATASETS)
    cols = F.array(*[F.array(*[F.lit(c) for c in datasets.DATASETS[n].columns]) for n in names])
    which = (F.pmod("o_orderkey", F.lit(len(names))) + 1).cast("int")
    both = F.explode(F.array(F.col("l_linenumber") * 2 - 1, F.col("l_linenumber") * 2))
    orders = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), which.alias("kind"))
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", both.alias("pos")).join(orders, "l_orderkey").withColumn("_c", F.element_at(cols, F.col("kind")))
    return rows.select(F.col("l_orderkey").alias("file_id"), F.upper(F.get("_c", F.col("pos") - 1)).alias("header")).where("header is not null")


def _spec_values() -> str:
    rows = [f"({k}, '{n}', {p}, '{c}')" for k, n in enumerate(list(datasets.DATASETS), 1) for p, c in enumerate(datasets.DATASETS[n].columns, 1)]
    return "fc(kind, name, pos, header) AS (VALUES " + ", ".join(rows) + ")"


def _hit_values() -> str:
    """(layout, header, canonical column, required) for every header in use."""
    heads = sorted({c for n in list(datasets.DATASETS) for c in datasets.DATASETS[n].columns})
    rows = []
    for d in datasets.DATASETS.values():
        for h in heads:
            name = h if h in d.columns else d.aliases.get(h) or d.aliases.get(datasets.spelled_out(h)) or datasets.spelled_out(h)
            if name in d.columns:
                rows.append(f"('{d.name}', '{h}', '{name}', {str(name in d.required).lower()})")
    sizes = ", ".join(f"('{d.name}', {len(d.required)}, {len(d.optional)})" for d in datasets.DATASETS.values())
    return f"hv(dt, header, col, req) AS (VALUES {', '.join(rows)}), sz(dt, nr, nopt) AS (VALUES {sizes})"


add("detect_dataset_type", lambda spark, sf: exports.detect_dataset_type(_headers(spark, sf)), f"""
WITH {_spec_values()}, {_hit_values()},
f AS (SELECT DISTINCT l_orderkey AS file_id, fc.header FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN fc ON kind = o_orderkey % {len(datasets.DATASETS)} + 1 AND pos IN (l_linenumber * 2 - 1, l_linenumber * 2)),
h AS (SELECT file_id, dt, count(DISTINCT col) FILTER (WHERE req) AS r, count(DISTINCT col) FILTER (WHERE NOT req) AS o FROM f JOIN hv USING (header) GROUP BY ALL),
sc AS (SELECT file_id, dt, round(0.8 * (coalesce(r, 0)::DOUBLE / nr) + 0.2 * coalesce(coalesce(o, 0)::DOUBLE / nullif(nopt, 0), 0), 4) AS score
  FROM (SELECT * FROM (SELECT DISTINCT file_id FROM f), sz) LEFT JOIN h USING (file_id, dt)),
rk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second_score FROM sc WINDOW w AS (PARTITION BY file_id ORDER BY score DESC, dt))
SELECT file_id, CASE WHEN score >= 0.7 AND round(score - second_score, 4) >= 0.05 THEN dt END AS dataset_type, score, second_score FROM rk WHERE rn = 1""")
add("accounts_reference", lambda spark, sf: exports.accounts_reference(v.line_items(spark, sf).select(
    F.col("l_partkey").cast("string").alias("Account Code"), F.concat("l_returnflag", "l_linestatus").alias("Account Name"), "row_id"), "row_id"), """
SELECT l_partkey::VARCHAR AS account_code, arg_max(l_returnflag || l_linestatus, row_id) AS account_name FROM li GROUP BY 1""")


def _csv(spark, sf, name="export"):
    """The orders written as CSV exports in the shared folder."""
    path = scratch_path(spark, name)
    rows = v.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("PO Number"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("PO Date"),
                                               F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("PO Status"),
                                               F.format_number(F.col("o_totalprice").cast(s.MONEY), 2).alias("Ordered Amount"))
    return files.write_results(rows, path)


_CSV = """SELECT o_orderkey::VARCHAR AS "PO Number", strftime(o_orderdate, '%m/%d/%Y') AS "PO Date", CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS "PO Status",
  format('{:,.2f}', o_totalprice) AS "Ordered Amount" FROM orders"""
add("read_export", lambda spark, sf: exports.read_export(spark, _csv(spark, sf)).drop("source_file", "source_row_index"), _CSV)
add("source_row_index", lambda spark, sf: exports.read_parquet_indexed(spark, f"{sf}/orders.parquet").select("source_row_index", "o_orderkey"),
    "SELECT row_number() OVER () - 1 AS source_row_index, o_orderkey FROM orders")
add("source_row_index_text", lambda spark, sf: exports.read_export(spark, _csv(spark, sf)).select("source_row_index", "PO Number"))


@query("read_export_breaks", r"""SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS text_md5,
  len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines FROM documents""")
def read_export_breaks(spark, sf):
    """The documents as delimited files whose cells hold line breaks and quotes, read back record by record."""
    path = scratch_path(spark, "breaks")
    rows = v.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    rows.write.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    text = F.col("text")
    return exports.read_export(spark, path).select("doc_id", "source", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"),
                                                   F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"))


add("write_results", lambda spark, sf: spark.read.json(files.write_results(
    v.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.struct("s_nationkey", "s_acctbal").alias("detail")), scratch_path(spark, "results"), "json"))
    .select("s_suppkey", "s_name", F.col("detail.s_nationkey").alias("nation"), F.col("detail.s_acctbal").alias("balance")),
    "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier")


@query("input_manifest")
def input_manifest(spark, sf):
    path = _csv(spark, sf)
    return files.input_manifest(spark, path, exports.read_export(spark, path), "purchase_orders").where(F.col("file_name").startswith("part-"))


@query("output_manifest")
def output_manifest(spark, sf):
    return files.output_manifest(spark, _csv(spark, sf, "output"))


def _titled(spark, sf):
    """One text file per order status with a title block above the header."""
    status = F.col("o_orderstatus")
    head = v.table(spark, sf, "orders").select(status).distinct().select(
        status, F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("n"), F.lit(t).alias("value")) for i, t in enumerate(
            ("City of Example", "PURCHASE ORDER REPORT", "PO Number,PO Date,Ordered Amount"))])).alias("_h")).select(status, "_h.n", "_h.value")
    body = v.table(spark, sf, "orders").select(status, (F.col("o_orderkey") + 10).alias("n"), F.concat_ws(
        ",", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.col("o_totalprice").cast(s.MONEY).cast("string")).alias("value"))
    path = scratch_path(spark, "titled")
    (head.unionByName(body).repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "n").drop("n")
     .write.partitionBy("o_orderstatus").text(path))
    return path


@query("skip_title_block", "SELECT DISTINCT o_orderstatus AS status, 2::BIGINT AS header_row FROM orders")
def skip_title_block(spark, sf):
    found = exports.skip_title_block(exports.top_lines(spark, _titled(spark, sf)))
    return found.select(F.regexp_extract("source_file", "o_orderstatus=(.)", 1).alias("status"), "header_row")


@query("read_titled_export", """SELECT o_orderkey::VARCHAR AS "PO Number", strftime(o_orderdate, '%m/%d/%Y') AS "PO Date", (o_totalprice::DECIMAL(18,2))::VARCHAR AS "Ordered Amount",
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS source_row_index FROM orders""")
def read_titled_export(spark, sf):
    return exports.read_titled_export(spark, _titled(spark, sf)).drop("source_file")


@query("header_row_by_overlap", """SELECT DISTINCT s_nationkey::VARCHAR AS nation, 1::BIGINT AS header_row, 0.8::DOUBLE AS score FROM supplier""")
def header_row_by_overlap(spark, sf):
    """One vendor list per nation, its header below a title with two cells."""
    rows = v.table(spark, sf, "supplier").select("s_nationkey", (F.col("s_suppkey") + 10).alias("n"), F.concat_ws(
        ",", F.col("s_suppkey").cast("string"), "s_name", F.lit("Active")).alias("value"))
    head = v.table(spark, sf, "supplier").select("s_nationkey").distinct().select("s_nationkey", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("Vendor report,as printed").alias("value")),
        F.struct(F.lit(1).cast("bigint").alias("n"), F.lit("Vend No,Vendor Name,Vendor Status").alias("value")))).alias("_h")).select("s_nationkey", "_h.*")
    path = scratch_path(spark, "vendors")
    head.unionByName(rows).repartition("s_nationkey").sortWithinPartitions("s_nationkey", "n").drop("n").write.partitionBy("s_nationkey").text(path)
    found = exports.header_row_by_overlap(exports.top_lines(spark, path))
    return found.select(F.regexp_extract("source_file", r"s_nationkey=(\d+)", 1).alias("nation"), "header_row", "score")


@query("text_context", "SELECT source AS name, (sum(length(text)) + count(*))::BIGINT AS n_chars FROM documents GROUP BY source")
def text_context(spark, sf):
    """The documents written as text files per source, read back whole."""
    path = scratch_path(spark, "context")
    v.table(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    return exports.text_context(spark, path).groupBy(F.regexp_extract("name", "source=([^/]+)", 1).alias("name")).agg(F.sum(F.length("text")).alias("n_chars"))
