"""Queries: payables, purchase orders, journals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tieout.operators import ap, journal, po
from tieout.plans import views as v
from tieout.plans.registry import add, query

# ------------------------------------------------------------ payables

_D1 = "d1 AS (SELECT vendor_number, invoice_number, count(*) AS n_rows, min(row_id) AS first_row FROM ap GROUP BY ALL HAVING count(*) > 1)"
_D1_ID = "'D1_' || substr(md5('D1' || vendor_number || '|' || invoice_number), 1, 8)"
add("duplicate_invoice", lambda spark, sf: ap.duplicate_invoice(v.invoices(spark, sf)), f"""
SELECT vendor_number, invoice_number, count(*) AS n_rows, min(row_id) AS first_row, min(invoice_amount) AS min_amount,
  max(invoice_amount) AS max_amount, sum(invoice_amount)::DECIMAL(28,2) AS total_amount, {_D1_ID} AS group_id
FROM ap GROUP BY vendor_number, invoice_number HAVING count(*) > 1""")
add("duplicate_invoice_rows", lambda spark, sf: ap.duplicate_invoice_rows(v.invoices(spark, sf)), f"""
WITH {_D1} SELECT {_D1_ID} AS group_id, row_id, first_row, vendor_number, invoice_number, invoice_amount FROM ap JOIN d1 USING (vendor_number, invoice_number)""")

_LIVE = """live AS (SELECT check_number, vendor_number, trim(unnest(string_split(invoice_numbers, ';'))) AS invoice_number FROM checks
  WHERE check_number NOT IN (SELECT check_number FROM checks WHERE status = 'Void'))"""
add("multi_check_invoice", lambda spark, sf: ap.multi_check_invoice(v.checks(spark, sf)), f"""
WITH {_LIVE} SELECT invoice_number, count(DISTINCT check_number) AS n_checks, min(check_number) AS first_check, max(check_number) AS last_check,
  'D1b_' || substr(md5('D1b' || invoice_number), 1, 8) AS group_id FROM live GROUP BY invoice_number HAVING count(DISTINCT check_number) > 1""")

add("same_vendor_near_duplicate", lambda spark, sf: ap.same_vendor_near_duplicate(v.invoices(spark, sf), "5.00", 30), """
SELECT a.row_id, any_value(a.vendor_number) AS vendor_number, any_value(a.invoice_number) AS invoice_number, any_value(a.invoice_amount) AS invoice_amount,
  any_value(a.invoice_date) AS invoice_date, count(*) FILTER (WHERE a.invoice_number <> b.invoice_number) AS n_partners,
  CASE WHEN min(b.invoice_number) <> a.invoice_number THEN min(b.invoice_number) ELSE max(b.invoice_number) END AS partner_invoice
FROM ap a JOIN ap b ON a.vendor_number = b.vendor_number AND abs(a.invoice_amount - b.invoice_amount) <= 5.00
  AND abs(date_diff('day', a.invoice_date, b.invoice_date)) <= 30
GROUP BY a.row_id, a.invoice_number HAVING min(b.invoice_number) <> max(b.invoice_number)""")
add("similar_vendor_same_amount", lambda spark, sf: ap.similar_vendor_same_amount(
    ap.fill_vendor_names(v.invoices(spark, sf), v.all_vendors(spark, sf)), amount_tol="0.01", days=30))
add("fill_vendor_names", lambda spark, sf: ap.fill_vendor_names(v.invoices(spark, sf), v.vendors(spark, sf)).select(
    "row_id", "vendor_number", "vendor_name"), """
SELECT ap.row_id, vendor_number, coalesce(nullif(trim(ap.vendor_name), ''), l.vendor_name, '') AS vendor_name FROM ap LEFT JOIN vendors l USING (vendor_number)""")
add("missing_po_over_threshold", lambda spark, sf: ap.missing_po_over_threshold(v.invoices(spark, sf)),
    "SELECT row_id, vendor_number, invoice_number, invoice_amount FROM ap WHERE po_number = '' AND invoice_amount >= 5000")
add("payment_before_invoice", lambda spark, sf: ap.payment_before_invoice(v.dated_invoices(spark, sf), v.checks(spark, sf)), """
SELECT row_id, vendor_number, invoice_number, invoice_date, check_number, c.check_date, date_diff('day', c.check_date, invoice_date) AS days_early
FROM ap_dated JOIN (SELECT check_number, arg_min(check_date, row_id) AS check_date FROM checks GROUP BY 1) c USING (check_number) WHERE c.check_date < invoice_date""")
add("payment_before_invoice_linked", lambda spark, sf: ap.payment_before_invoice(v.dated_invoices(spark, sf).drop("check_number"), v.checks(spark, sf)), f"""
WITH {_LIVE}, dd AS (SELECT * EXCLUDE (check_number) FROM ap_dated)
SELECT row_id, vendor_number, invoice_number, invoice_date, check_number, c.check_date, date_diff('day', c.check_date, invoice_date) AS days_early
FROM dd JOIN live USING (vendor_number, invoice_number) JOIN (SELECT check_number, arg_min(check_date, row_id) AS check_date FROM checks GROUP BY 1) c USING (check_number)
WHERE c.check_date < invoice_date""")
add("inactive_vendor", lambda spark, sf: ap.inactive_vendor(v.invoices(spark, sf), v.vendors(spark, sf)), """
SELECT ap.row_id, vendor_number, l.vendor_name, status AS vendor_status, invoice_number, invoice_amount FROM ap JOIN vendors l USING (vendor_number)
WHERE lower(status) = 'inactive'""")
add("unknown_vendor", lambda spark, sf: ap.unknown_vendor(v.invoices(spark, sf), v.vendors(spark, sf)), """
SELECT row_id, vendor_number, vendor_name, invoice_number, invoice_amount FROM ap WHERE vendor_number NOT IN (SELECT vendor_number FROM vendors)""")

_SPLIT = """daily AS (SELECT vendor_number, invoice_date, count(*) AS n, sum(invoice_amount) AS s FROM ap_events WHERE invoice_amount > 0 AND invoice_amount < 300 GROUP BY ALL),
wins AS (SELECT b.vendor_number, a.invoice_date AS st, b.invoice_date AS en FROM daily a JOIN daily b ON a.vendor_number = b.vendor_number
  AND a.invoice_date BETWEEN b.invoice_date - 3 AND b.invoice_date),
good AS (SELECT w.vendor_number, min(w.st) AS st, w.en FROM wins w JOIN daily d ON d.vendor_number = w.vendor_number AND d.invoice_date = w.st
  GROUP BY w.vendor_number, w.en HAVING sum(d.n) >= 2 AND sum(d.s) >= 300),
isl AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY vendor_number ORDER BY en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM good),
cl AS (SELECT vendor_number, grp, min(st) AS st, max(en) AS en FROM (SELECT *, sum(opens) OVER (PARTITION BY vendor_number ORDER BY en) AS grp FROM isl) GROUP BY ALL)"""
add("split_payments", lambda spark, sf: ap.split_payments(v.event_invoices(spark, sf), 300, 3), f"""
WITH {_SPLIT} SELECT c.vendor_number, sum(n)::BIGINT AS n_invoices, sum(s)::DECIMAL(28,2) AS total, min(invoice_date) AS first_date, max(invoice_date) AS last_date,
  'D8_' || substr(md5('D8' || c.vendor_number || '|' || min(invoice_date)::VARCHAR), 1, 8) AS group_id
FROM cl c JOIN daily d ON d.vendor_number = c.vendor_number AND invoice_date BETWEEN st AND en GROUP BY c.vendor_number, grp""")
add("split_payment_rows", lambda spark, sf: ap.split_payment_rows(v.event_invoices(spark, sf), 300, 3), f"""
WITH {_SPLIT} SELECT row_id, e.vendor_number, invoice_number, invoice_date, invoice_amount, (SELECT min(invoice_date) FROM daily d WHERE d.vendor_number = c.vendor_number
  AND d.invoice_date BETWEEN st AND en) AS first_date
FROM ap_events e JOIN cl c ON e.vendor_number = c.vendor_number AND invoice_date BETWEEN st AND en WHERE invoice_amount > 0 AND invoice_amount < 300""")

# ------------------------------------------------------------ purchase orders


def _h(spark, sf):
    return v.invoices(spark, sf), v.po_headers(spark, sf)


def _l(spark, sf):
    return v.invoices(spark, sf), v.po_lines(spark, sf)


_P1 = """p1 AS (SELECT po_number, t AS po_total, i AS total_invoiced, n AS n_invoices FROM (SELECT po_number, sum(line_amount) AS t FROM po_h GROUP BY 1)
  JOIN (SELECT po_number, sum(invoice_amount) AS i, count(*) AS n FROM ap WHERE po_number <> '' GROUP BY 1) USING (po_number) WHERE i > t)"""
add("invoice_exceeds_po", lambda spark, sf: po.invoice_exceeds_po(*_h(spark, sf)), f"""
WITH {_P1} SELECT po_number, po_total::DECIMAL(28,2) AS po_total, total_invoiced::DECIMAL(28,2) AS total_invoiced, n_invoices,
  (total_invoiced - po_total)::DECIMAL(28,2) AS overage FROM p1""")
_P2 = """p2 AS (SELECT ap.row_id, po_number, vendor_number, invoice_number, f.po_vendor FROM ap JOIN (SELECT po_number, min(vendor_number) AS po_vendor FROM po_l GROUP BY 1) f USING (po_number)
  WHERE vendor_number <> '' AND NOT EXISTS (SELECT 1 FROM po_l p WHERE p.po_number = ap.po_number AND p.vendor_number = ap.vendor_number))"""
add("po_wrong_vendor", lambda spark, sf: po.po_wrong_vendor(*_l(spark, sf)), f"WITH {_P2} SELECT * FROM p2")
add("po_wrong_vendor_names", lambda spark, sf: po.po_wrong_vendor(*_l(spark, sf), v.all_vendors(spark, sf)))
add("po_missing", lambda spark, sf: po.po_missing(*_h(spark, sf)), """
SELECT row_id, po_number, vendor_number, invoice_number, invoice_amount FROM ap WHERE po_number <> '' AND po_number NOT IN (SELECT po_number FROM po_h)""")
add("po_closed_usage", lambda spark, sf: po.po_closed_usage(*_h(spark, sf)), """
SELECT ap.row_id, po_number, invoice_number, invoice_date, last_activity_date FROM ap JOIN po_h USING (po_number) WHERE status = 'Closed' AND invoice_date > last_activity_date""")
_BEST = """best AS (SELECT * EXCLUDE (rn) FROM (SELECT ap.row_id, po_number, invoice_number, ap.qty, ap.unit_price, p.row_id AS po_row, p.line AS po_line, p.qty AS po_qty,
  p.unit_price AS po_unit_price, row_number() OVER (PARTITION BY ap.row_id ORDER BY (p.qty = ap.qty) DESC, p.row_id) AS rn FROM ap JOIN po_l p USING (po_number)) WHERE rn = 1)"""
add("best_po_line", lambda spark, sf: po.best_po_line(*_l(spark, sf)), f"WITH {_BEST} SELECT * FROM best")
_DEV = "(abs(unit_price - po_unit_price) / nullif(po_unit_price, 0) * 100)"
add("po_unit_price_mismatch", lambda spark, sf: po.po_unit_price_mismatch(*_l(spark, sf)), f"""
WITH {_BEST} SELECT row_id, po_number, invoice_number, po_row, po_line, unit_price, po_unit_price, {_DEV} AS deviation_pct FROM best WHERE {_DEV} > 1""")
add("po_quantity_mismatch", lambda spark, sf: po.po_quantity_mismatch(*_l(spark, sf)), f"""
WITH {_BEST} SELECT row_id, po_number, invoice_number, po_row, po_line, qty, po_qty, (qty - po_qty)::DECIMAL(18,2) AS overage FROM best WHERE qty > po_qty""")
add("received_not_invoiced", lambda spark, sf: po.received_not_invoiced(v.invoices(spark, sf).withColumn(
    "vendor_number", F.when(F.col("invoice_amount") < 60000, F.concat(F.lit("X"), "vendor_number")).otherwise(F.col("vendor_number"))), v.po_lines(spark, sf)), """
SELECT row_id, po_number, vendor_number, line, received_qty FROM po_l p WHERE received_qty > 0 AND invoiced_qty <= 0
  AND NOT EXISTS (SELECT 1 FROM ap WHERE ap.po_number = p.po_number AND ap.vendor_number = p.vendor_number AND invoice_amount >= 60000)""")
add("invoiced_not_received", lambda spark, sf: po.invoiced_not_received(*_l(spark, sf)), """
SELECT p.row_id, po_number, p.vendor_number, line, received_qty, invoiced_qty, coalesce(n, 0)::BIGINT AS n_invoices, first_invoice FROM po_l p
LEFT JOIN (SELECT po_number, count(*) AS n, min(row_id) AS first_invoice FROM ap GROUP BY 1) USING (po_number) WHERE invoiced_qty > received_qty""")
add("po_clean_matches", lambda spark, sf: po.po_clean_matches(*_l(spark, sf)), f"""
WITH {_BEST}, {_P2}, t AS (SELECT po_number, sum(line_amount) AS t FROM po_l GROUP BY 1), i AS (SELECT po_number, sum(invoice_amount) AS i FROM ap WHERE po_number <> '' GROUP BY 1),
f AS (SELECT po_number, arg_min(status, row_id) AS st, arg_min(last_activity_date, row_id) AS la FROM po_l GROUP BY 1)
SELECT ap.row_id, po_number, invoice_number, vendor_number, invoice_amount FROM ap JOIN f USING (po_number) JOIN t USING (po_number) JOIN i USING (po_number)
WHERE i <= t AND po_number NOT IN (SELECT po_number FROM po_l WHERE invoiced_qty > received_qty) AND row_id NOT IN (SELECT row_id FROM p2)
  AND NOT (st = 'Closed' AND invoice_date > la) AND row_id NOT IN (SELECT row_id FROM best WHERE {_DEV} > 1 OR qty > po_qty)""")

# ------------------------------------------------------------ journals

_START, _END = dt.date(1996, 7, 1), dt.date(2000, 6, 30)


def _je(spark, sf):
    return journal.parse_draft(v.journal_draft(spark, sf))


def _je_all(spark, sf):
    return journal.je_findings(_je(spark, sf), v.journal_chart(spark, sf), v.journal_history(spark, sf), _START, _END)


add("je_duplicate_lines", lambda spark, sf: journal.je_duplicate_lines(_je(spark, sf)), """
SELECT row_id, journal, line, first_row FROM (SELECT *, min(row_id) OVER (PARTITION BY journal, line) AS first_row FROM je) WHERE row_id <> first_row""")
add("je_date_required", lambda spark, sf: journal.je_date_required(_je(spark, sf)), "SELECT row_id, journal, line FROM je WHERE q = 50")
add("je_date_valid", lambda spark, sf: journal.je_date_valid(_je(spark, sf)), "SELECT row_id, journal, line, '2000-02-30' AS date FROM je WHERE q = 49")
add("je_date_in_period", lambda spark, sf: journal.je_date_in_period(_je(spark, sf), _START, _END), """
SELECT row_id, journal, line, eff_date FROM je WHERE eff_date < DATE '1996-07-01' OR eff_date > DATE '2000-06-30'""")
_EMPTY_SIDE = "coalesce(dr, 0) = 0 AND coalesce(cr, 0) = 0"
add("je_required_fields", lambda spark, sf: journal.je_required_fields(_je(spark, sf)), f"""
SELECT row_id, journal, line, 'fund' AS missing FROM je WHERE fund = '' UNION ALL SELECT row_id, journal, line, 'debit or credit' FROM je WHERE {_EMPTY_SIDE}""")
add("je_both_sides", lambda spark, sf: journal.je_both_sides(_je(spark, sf)), "SELECT row_id, journal, line, dr, cr FROM je WHERE dr <> 0 AND cr <> 0")
add("je_negative", lambda spark, sf: journal.je_negative(_je(spark, sf)), """
SELECT row_id, journal, line, 'debit' AS side, dr AS amount FROM je WHERE dr < 0 UNION ALL SELECT row_id, journal, line, 'credit', cr FROM je WHERE cr < 0""")
_SEG = "SELECT row_id, journal, line, '{c}' AS segment, {c} AS value FROM je WHERE {c} <> '' AND {c} NOT IN (SELECT {c} FROM coa)"
_COA = " UNION ALL ".join(_SEG.format(c=c) for c in ("fund", "org", "object"))
add("je_account_in_coa", lambda spark, sf: journal.je_account_in_coa(_je(spark, sf), v.journal_chart(spark, sf)), _COA)
_INACT = "SELECT row_id, journal, line, fund, org, object, status FROM je JOIN coa USING (fund, org, object) WHERE status NOT IN ('active', '')"
add("je_inactive_account", lambda spark, sf: journal.je_inactive_account(_je(spark, sf), v.journal_chart(spark, sf)), _INACT)
_UNSEEN = """SELECT row_id, journal, line, fund, org, object FROM je WHERE fund IN (SELECT fund FROM coa) AND org IN (SELECT org FROM coa) AND object IN (SELECT object FROM coa)
  AND NOT EXISTS (SELECT 1 FROM coa c WHERE c.fund = je.fund AND c.org = je.org AND c.object = je.object)
  AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.fund = je.fund AND h.org = je.org AND h.object = je.object)"""
add("je_combo_unseen", lambda spark, sf: journal.je_combo_unseen(_je(spark, sf), v.journal_chart(spark, sf), v.journal_history(spark, sf)), _UNSEEN)
add("je_short_description", lambda spark, sf: journal.je_short_description(_je(spark, sf)),
    "SELECT row_id, journal, line, line_description FROM je WHERE length(line_description) < 3")
_ROUND = "coalesce(dr, 0) + coalesce(cr, 0) >= 10000 AND (coalesce(dr, 0) + coalesce(cr, 0)) % 1 = 0"
add("je_round_dollar", lambda spark, sf: journal.je_round_dollar(_je(spark, sf)), f"""
SELECT row_id, journal, line, (coalesce(dr, 0) + coalesce(cr, 0))::DECIMAL(18,4) AS amount FROM je WHERE {_ROUND}""")
_BAL = "bal AS (SELECT journal, coalesce(sum(dr), 0)::DECIMAL(28,4) AS debits, coalesce(sum(cr), 0)::DECIMAL(28,4) AS credits FROM je GROUP BY journal)"
add("je_balance_per_journal", lambda spark, sf: journal.je_balance_per_journal(_je(spark, sf)), f"""
WITH {_BAL} SELECT journal, debits, credits, (debits - credits)::DECIMAL(28,4) AS difference FROM bal WHERE round_even(debits, 2) <> round_even(credits, 2)""")
add("je_balance_overall", lambda spark, sf: journal.je_balance_overall(_je(spark, sf)), f"""
WITH {_BAL} SELECT sum(debits)::DECIMAL(28,4) AS debits, sum(credits)::DECIMAL(28,4) AS credits, round_even(sum(debits), 2) = round_even(sum(credits), 2) AS balanced FROM bal""")
_N = lambda sql: f"(SELECT count(*) FROM ({sql}))"
_JE_BLOCK = " + ".join(_N(x) for x in (
    "SELECT * FROM (SELECT row_id, min(row_id) OVER (PARTITION BY journal, line) AS f FROM je) WHERE row_id <> f",
    "SELECT 1 FROM je WHERE q IN (49, 50)", "SELECT 1 FROM je WHERE eff_date < DATE '1996-07-01' OR eff_date > DATE '2000-06-30'",
    "SELECT 1 FROM je WHERE fund = ''", f"SELECT 1 FROM je WHERE {_EMPTY_SIDE}", "SELECT 1 FROM je WHERE dr <> 0 AND cr <> 0",
    "SELECT 1 FROM je WHERE dr < 0", "SELECT 1 FROM je WHERE cr < 0", _COA, _INACT,
    "SELECT 1 FROM bal WHERE round_even(debits, 2) <> round_even(credits, 2)",
    "SELECT 1 FROM (SELECT sum(debits) AS d, sum(credits) AS c FROM bal) WHERE round_even(d, 2) <> round_even(c, 2)"))
_JE_WARN = " + ".join(_N(x) for x in (_UNSEEN, "SELECT 1 FROM je WHERE length(line_description) < 3", f"SELECT 1 FROM je WHERE {_ROUND}"))
add("je_blocking_split", lambda spark, sf: journal.je_blocking_split(_je_all(spark, sf)), f"""
WITH {_BAL}, k AS (SELECT {_JE_BLOCK} AS b, {_JE_WARN} AS w) SELECT b AS blocking_count, w AS warning_count, b = 0 AS upload_ready FROM k""")


@query("journal_upload_rows", """
SELECT lpad(o_orderkey::VARCHAR, 12, '0') || '-' || line AS source_row, o_orderkey::VARCHAR AS "Journal", line AS "Line", o_orderdate::DATE::VARCHAR AS "Eff Date",
  o_orderstatus AS "Fund", o_orderpriority AS "Org", o_custkey::VARCHAR AS "Object", '' AS "Account Description",
  CASE WHEN line = '1' THEN (o_totalprice::DECIMAL(18,2))::VARCHAR ELSE '' END AS "Debit", CASE WHEN line = '2' THEN (o_totalprice::DECIMAL(18,2))::VARCHAR ELSE '' END AS "Credit",
  'Order value' AS "Line Description", '' AS "Reference" FROM orders, (VALUES ('1'), ('2')) l(line)""")
def journal_upload_rows(spark, sf):
    parsed = journal.parse_draft(v.clean_draft(spark, sf))
    found = journal.je_findings(parsed, v.clean_chart(spark, sf), None, dt.date(1990, 1, 1), dt.date(2010, 12, 31))
    return journal.journal_upload_rows(parsed, found)
