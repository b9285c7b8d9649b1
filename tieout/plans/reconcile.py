"""Queries: predicates, bank reconciliation, budget, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions import scalars as s
from tieout.operators import bank, budget, matching, ordered, profiling, report
from tieout.plans import views as v
from tieout.plans.registry import add, query

# ------------------------------------------------------------ predicates


def _order_and_line(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast(s.MONEY).alias("order_amount"),
                                                 F.col("o_orderdate").cast("date").alias("order_date"))
    lines = v.line_items(spark, sf).select("row_id", F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast(s.MONEY).alias("line_amount"),
                                           F.col("l_shipdate").cast("date").alias("ship_date"), "l_returnflag")
    return lines.join(orders, "o_orderkey")


_PAIR_SQL = """SELECT row_id, order_amount, line_amount FROM (SELECT row_id, o_totalprice::DECIMAL(18,2) AS order_amount,
  l_extendedprice::DECIMAL(18,2) AS line_amount, l_returnflag, o_orderdate::DATE AS order_date, l_shipdate::DATE AS ship_date
  FROM li JOIN orders ON o_orderkey = l_orderkey) WHERE """

add("amounts_match", lambda spark, sf: _order_and_line(spark, sf).where(s.amounts_match(F.col("order_amount"), F.col("line_amount"), 5000))
    .select("row_id", "order_amount", "line_amount"), _PAIR_SQL + "abs(order_amount - line_amount) <= 5000")


@query("signed_equal", _PAIR_SQL.replace("SELECT row_id, order_amount, line_amount FROM", "SELECT row_id, order_amount, CASE WHEN l_returnflag = 'R' THEN -line_amount ELSE line_amount END AS line_amount FROM", 1)
       + "abs(order_amount - line_amount) <= 2500")
def signed_equal(spark, sf):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("line_amount")).otherwise(F.col("line_amount")).cast(s.MONEY)
    rows = _order_and_line(spark, sf).withColumn("line_amount", signed)
    return rows.where(s.signed_equal(F.col("order_amount"), F.col("line_amount"), 2500)).select("row_id", "order_amount", "line_amount")


@query("dates_within", _PAIR_SQL.replace("SELECT row_id, order_amount, line_amount FROM", "SELECT row_id, order_date, ship_date FROM", 1)
       + "abs(date_diff('day', order_date, ship_date)) <= 7")
def dates_within(spark, sf):
    return _order_and_line(spark, sf).where(s.dates_within(F.col("order_date"), F.col("ship_date"), 7)).select("row_id", "order_date", "ship_date")


# ------------------------------------------------------------ bank

_EXACT = """exact AS (SELECT b.row_index AS left_index, l.row_index AS right_index, b.amount AS left_amount, l.amount AS right_amount,
  b.txn_date AS left_date, l.txn_date AS right_date, 'exact' AS match_kind
  FROM (SELECT *, row_number() OVER (PARTITION BY abs(amount), txn_date ORDER BY row_index) AS rn FROM bank) b
  JOIN (SELECT *, row_number() OVER (PARTITION BY abs(amount), txn_date ORDER BY row_index) AS rn FROM ledger) l
  ON abs(b.amount) = abs(l.amount) AND b.txn_date = l.txn_date AND b.rn = l.rn)"""


def _sides(spark, sf):
    return v.bank(spark, sf), v.ledger(spark, sf)


add("match_exact", lambda spark, sf: matching.match_records(*_sides(spark, sf)), f"WITH {_EXACT} SELECT * FROM exact")
add("match_timing", lambda spark, sf: matching.match_records(*_sides(spark, sf), days=3))
add("match_tolerant", lambda spark, sf: matching.match_records(*_sides(spark, sf), amount_tol="0.05", days=2))


@query("unmatched_bank", f"WITH {_EXACT} SELECT row_index, amount, txn_date FROM bank WHERE row_index NOT IN (SELECT left_index FROM exact)")
def unmatched_bank(spark, sf):
    b, l = _sides(spark, sf)
    return matching.unmatched(b, matching.match_records(b, l), "left")


@query("unmatched_ledger", f"WITH {_EXACT} SELECT row_index, amount, txn_date FROM ledger WHERE row_index NOT IN (SELECT right_index FROM exact)")
def unmatched_ledger(spark, sf):
    b, l = _sides(spark, sf)
    return matching.unmatched(l, matching.match_records(b, l), "right")


add("within_table_duplicates", lambda spark, sf: matching.within_table_duplicates(v.bank(spark, sf), "0.02", 1), """
SELECT a.row_index, any_value(a.amount) AS amount, any_value(a.txn_date) AS txn_date, count(*) AS n_partners, min(b.row_index) AS first_partner
FROM bank a JOIN bank b ON a.row_index <> b.row_index AND abs(abs(a.amount) - abs(b.amount)) <= 0.02
  AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 1 GROUP BY a.row_index""")

add("reconciliation_summary", lambda spark, sf: bank.reconciliation_summary(*_sides(spark, sf), matching.match_records(*_sides(spark, sf))), f"""
WITH {_EXACT}, n AS (SELECT count(*) AS m FROM exact), b AS (SELECT count(*) AS r, sum(amount) AS t FROM bank), l AS (SELECT count(*) AS r, sum(amount) AS t FROM ledger)
SELECT b.r AS bank_rows, l.r AS ledger_rows, m AS matched, 0::BIGINT AS timing, b.r - m AS unmatched_bank, l.r - m AS unmatched_ledger,
  b.t::DECIMAL(28,2) AS bank_total, l.t::DECIMAL(28,2) AS ledger_total, (b.t - l.t)::DECIMAL(28,2) AS difference FROM b, l, n""")

add("sign_convention_mismatch", lambda spark, sf: bank.sign_convention_mismatch(*_sides(spark, sf)), """
SELECT shared, opposite, shared >= 4 AND opposite >= round_even(0.6 * shared, 0) AS mismatch FROM (
  SELECT count(*) AS shared, count(*) FILTER (WHERE (b.a < 0) <> (l.a < 0)) AS opposite
  FROM (SELECT abs(amount) AS mag, arg_min(amount, row_index) AS a FROM bank WHERE amount <> 0 GROUP BY 1) b
  JOIN (SELECT abs(amount) AS mag, arg_min(amount, row_index) AS a FROM ledger WHERE amount <> 0 GROUP BY 1) l USING (mag))""")

_BATCH_SIDE = """SELECT '{name}' AS total_side, o.row_index, o.amount, k.batch_kind, k.n_components::BIGINT AS n_components, k.n_batches FROM {one} o JOIN (
    SELECT batch_total, 'date' AS batch_kind, n_components, count(*) AS n_batches FROM (
      SELECT txn_date, count(*) AS n_components, sum(amount) AS batch_total FROM {many} WHERE amount <> 0 GROUP BY txn_date HAVING count(*) >= 3) GROUP BY ALL
    UNION ALL SELECT batch_total, 'run', 3, count(*) FROM (
      SELECT count(*) OVER w AS c, sum(amount) OVER w AS batch_total FROM {many} WHERE amount <> 0
      WINDOW w AS (PARTITION BY txn_date ORDER BY row_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE c = 3 GROUP BY ALL) k
  ON k.batch_total = o.amount WHERE o.amount <> 0 AND o.amount NOT IN (SELECT amount FROM {many})"""


def _flipped(rows):
    """Ledger amounts turned to the bank's sign, as a reviewer does on a sign mismatch."""
    return rows.withColumn("amount", (-F.col("amount")).cast(s.MONEY))


add("batch_total_match", lambda spark, sf: bank.batch_total_match(v.bank(spark, sf), _flipped(v.ledger(spark, sf))),
    "WITH led2 AS (SELECT row_index, -amount AS amount, txn_date FROM ledger) " + _BATCH_SIDE.format(name="ledger", one="led2", many="bank")
    + " UNION ALL " + _BATCH_SIDE.format(name="bank", one="bank", many="led2"))


def _order_dates(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"), F.col("o_totalprice").cast(s.MONEY).alias("amount"),
                                               F.col("o_orderdate").cast("date").alias("txn_date"))


add("prior_period_items", lambda spark, sf: bank.prior_period_items(_order_dates(spark, sf)), """
WITH r AS (SELECT o_orderdate::DATE AS d, row_number() OVER (ORDER BY o_orderdate) - 1 AS p, count(*) OVER () AS n FROM orders),
q AS (SELECT max(d) FILTER (WHERE p = n // 4) AS lo, max(d) FILTER (WHERE p = (3 * n) // 4) AS hi FROM r)
SELECT o_orderkey AS row_index, o_totalprice::DECIMAL(18,2) AS amount, o_orderdate::DATE AS txn_date, lo AS span_start, hi AS span_end FROM orders, q
WHERE date_diff('day', o_orderdate::DATE, lo) > 45 OR date_diff('day', hi, o_orderdate::DATE) > 45""")

# ------------------------------------------------------------ budget

_LINES = "bl AS (SELECT fund, account, department, amount FROM budget), al AS (SELECT fund, account, department, amount FROM actuals)"
_JOINED = f"""{_LINES}, jn AS (SELECT fund, account, department, b.amount AS budget_amount, a.amount AS actual_amount,
  (a.amount - b.amount)::DECIMAL(18,2) AS dollar_variance FROM bl b JOIN al a USING (fund, account, department))"""
_PCT = "(dollar_variance::DOUBLE * 100 / nullif(budget_amount::DOUBLE, 0))"


def _budget(spark, sf):
    return v.budget(spark, sf), v.actuals(spark, sf)


add("budget_vs_actual", lambda spark, sf: budget.budget_vs_actual(*_budget(spark, sf)), f"""
WITH {_JOINED} SELECT *, {_PCT} AS pct_variance, abs(dollar_variance) >= 10000 OR coalesce(abs({_PCT}) >= 10, false) AS flagged,
  CASE WHEN abs(dollar_variance) >= 10000 THEN 'high' WHEN coalesce(abs({_PCT}) >= 10, false) THEN 'medium' ELSE 'info' END AS severity FROM jn""")
add("budget_only", lambda spark, sf: budget.one_sided(*_budget(spark, sf)),
    f"WITH {_LINES} SELECT * FROM bl ANTI JOIN al USING (fund, account, department)")
add("actual_only", lambda spark, sf: budget.one_sided(*reversed(_budget(spark, sf))),
    f"WITH {_LINES} SELECT * FROM al ANTI JOIN bl USING (fund, account, department)")
add("missing_accounts", lambda spark, sf: budget.missing_accounts(v.budget_chart(spark, sf), *_budget(spark, sf)), f"""
WITH {_LINES} SELECT fund, account, department FROM chart_b ANTI JOIN bl USING (fund, account, department) ANTI JOIN al USING (fund, account, department)""")
for _c in ("fund", "department"):
    add(f"variance_by_{_c}", lambda spark, sf, c=_c: budget.variance_by(*_budget(spark, sf), c), f"""
WITH {_JOINED} SELECT {_c}, sum(budget_amount)::DECIMAL(28,2) AS budget_amount, sum(actual_amount)::DECIMAL(28,2) AS actual_amount,
  sum(dollar_variance)::DECIMAL(28,2) AS dollar_variance FROM jn GROUP BY {_c}""")
add("key_overlap", lambda spark, sf: budget.key_overlap(*_budget(spark, sf)), f"""
WITH {_LINES}, f AS (SELECT b.amount AS x, a.amount AS y FROM bl b FULL JOIN al a USING (fund, account, department))
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (WHERE y IS NULL) AS left_only,
  count(*) FILTER (WHERE x IS NULL) AS right_only FROM f""")
add("report_total_rows_skipped", lambda spark, sf: budget.report_total_rows_skipped(v.budget(spark, sf), ["fund", "account", "department"]), """
SELECT 'bt|' || fund AS row_id, '' AS fund, 'TOTAL ' || fund AS account, '' AS department, sum(amount)::DECIMAL(18,2) AS amount FROM budget GROUP BY fund
UNION ALL SELECT 'bz|', '', '', '', sum(amount)::DECIMAL(18,2) FROM budget""")
add("budget_basis_mismatch", lambda spark, sf: budget.budget_basis_mismatch(*_budget(spark, sf)), f"""
WITH {_LINES}, b AS (SELECT count(*) AS br, sum(amount) AS bt FROM bl), a AS (SELECT count(*) AS ar, sum(amount) AS atot FROM al)
SELECT br AS budget_rows, ar AS actual_rows, bt::DECIMAL(28,2) AS budget_total, atot::DECIMAL(28,2) AS actual_total,
  CASE WHEN greatest(br, ar)::DOUBLE / least(br, ar) >= 3 THEN 'row_count' WHEN greatest(abs(bt), abs(atot))::DOUBLE / least(abs(bt), abs(atot))::DOUBLE >= 8 THEN 'magnitude' END AS reason
FROM a, b""")
add("subtotal_rollup_signal", lambda spark, sf: budget.subtotal_rollup_signal(
    v.line_items(spark, sf).select(F.col("l_orderkey").alias("journal"), F.struct("l_linenumber", "row_id").alias("ord"),
                                   F.col("l_linenumber").alias("chunk"), F.col("l_extendedprice").cast(s.MONEY).alias("amount")),
    ["journal"], "ord", F.col("chunk")), """
WITH v AS (SELECT l_orderkey AS journal, l_extendedprice::DECIMAL(18,2) AS c, row_number() OVER w AS i, sum(l_extendedprice::DECIMAL(18,2)) OVER w AS p,
    sum(l_extendedprice::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey) AS t, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM li WHERE l_extendedprice <> 0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, row_id ROWS UNBOUNDED PRECEDING))
SELECT journal, count(*) AS n_signals FROM v a WHERE n >= 3 AND ((t - c <> 0 AND abs(c - (t - c)) <= abs(c) * 0.005)
  OR EXISTS (SELECT 1 FROM v b WHERE b.journal = a.journal AND b.i >= 2 AND b.i < a.i AND abs(b.p - a.c) <= abs(a.c) * 0.005)
  OR EXISTS (SELECT 1 FROM v b WHERE b.journal = a.journal AND b.i >= 3 AND b.i > a.i AND abs(b.p - a.c - a.c) <= abs(a.c) * 0.005)) GROUP BY journal""")
add("last_wins", lambda spark, sf: ordered.keep_last(
    v.line_items(spark, sf).select("l_partkey", "l_suppkey", "row_id", F.col("l_extendedprice").cast(s.MONEY).alias("amount")),
    ["l_partkey", "l_suppkey"], F.col("row_id"), ["row_id", "amount"]), """
SELECT l_partkey, l_suppkey, max(row_id) AS row_id, arg_max(l_extendedprice::DECIMAL(18,2), row_id) AS amount FROM li GROUP BY ALL""")

# ------------------------------------------------------------ report

_RL = "rl AS (SELECT * FROM report WHERE line_type = 'line_item')"
add("subtotal_tie_out", lambda spark, sf: report.subtotal_tie_out(v.report(spark, sf)), f"""
WITH {_RL}, sm AS (SELECT section, sum(amount) AS line_item_sum FROM rl GROUP BY section)
SELECT row_id, section, amount::DECIMAL(28,2) AS stated, coalesce(line_item_sum, 0)::DECIMAL(28,2) AS line_item_sum,
  (amount - coalesce(line_item_sum, 0))::DECIMAL(28,2) AS difference FROM report LEFT JOIN sm USING (section)
WHERE line_type = 'subtotal' AND amount <> coalesce(line_item_sum, 0)""")
add("grand_total_tie_out", lambda spark, sf: report.grand_total_tie_out(v.report(spark, sf)), """
WITH su AS (SELECT sum(amount) AS t FROM report WHERE line_type = 'subtotal')
SELECT row_id, amount::DECIMAL(28,2) AS stated, t::DECIMAL(28,2) AS subtotal_sum, (amount - t)::DECIMAL(28,2) AS difference
FROM report, su WHERE line_type = 'grand_total' AND amount <> t""")
add("missing_sections", lambda spark, sf: report.missing_sections(v.report(spark, sf), v.required_sections(spark, sf)), """
SELECT section FROM (SELECT o_orderpriority AS section FROM orders UNION SELECT c_mktsegment FROM customer) WHERE section NOT IN (SELECT section FROM report)""")
add("report_duplicate_lines", lambda spark, sf: report.report_duplicate_lines(v.report_detail(spark, sf)), """
SELECT row_id, first_row, section, account_code FROM (SELECT row_id, l_returnflag || l_linestatus AS section, l_partkey::VARCHAR AS account_code,
  min(row_id) OVER (PARTITION BY l_returnflag, l_linestatus, l_partkey, l_linenumber, l_quantity) AS first_row FROM li) WHERE row_id <> first_row""")
add("negative_not_allowed", lambda spark, sf: report.negative_not_allowed(v.report(spark, sf), ["BALANCES"]), f"""
WITH {_RL} SELECT row_id, section, account_code, amount FROM rl WHERE section = 'BALANCES' AND amount < 0""")
add("invalid_account_code", lambda spark, sf: report.invalid_account_code(v.report(spark, sf), v.account_codes(spark, sf)), f"""
WITH {_RL} SELECT row_id, account_code, section FROM rl WHERE account_code NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal >= 0)""")
add("inconsistent_naming", lambda spark, sf: report.inconsistent_naming(v.report(spark, sf)), f"""
WITH {_RL} SELECT account_code, count(DISTINCT account_name) AS n_names, min(account_name) AS first_name, max(account_name) AS last_name
FROM rl GROUP BY account_code HAVING count(DISTINCT account_name) > 1""")
add("prior_version_change", lambda spark, sf: report.prior_version_change(v.report(spark, sf), v.prior_report(spark, sf)), f"""
WITH {_RL}, p AS (SELECT account_code, arg_max(amount, row_id) AS prior_amount FROM prior GROUP BY account_code)
SELECT row_id, section, account_code, prior_amount, amount, (amount - prior_amount)::DECIMAL(18,2) AS change,
  coalesce(abs((amount - prior_amount)::DOUBLE * 100 / nullif(prior_amount::DOUBLE, 0)), 0) AS change_pct
FROM rl JOIN p USING (account_code) WHERE abs(amount - prior_amount) >= 10000
  AND coalesce(abs((amount - prior_amount)::DOUBLE * 100 / nullif(prior_amount::DOUBLE, 0)), 0) >= 25""")


@query("report_structure", """SELECT false AS wide_layout, count(*) = 0 AS unknown_line_types, false AS nested_rollup FROM report
WHERE line_type IN ('line_item', 'subtotal', 'grand_total')""")
def report_structure(spark, sf):
    rows = v.report(spark, sf)
    return report.report_structure(rows, profiling.parse_confidence(rows))
