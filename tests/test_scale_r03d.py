"""Findings of round 3, fourth part: cells are worked out once, and only those a result needs."""

import datetime as dt

from tieout.operators import journal, search
from tieout.sources import exports


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f14_amounts_are_parsed_once(spark):
    rows = [(1, "J", "1", "10000", ""), (2, "J", "2", "", "(12,000.00)"), (3, "J", "3", "$12,000", None), (4, "J", "4", "9000", "1000.00"),
            (5, "J", "5", "10000.50", ""), (6, "J", "6", "n/a", "-"), (None, "J", "7", "20000", "")]
    draft = spark.createDataFrame(rows, "row_id int, journal string, line string, debit string, credit string")
    found = journal.je_round_dollar(journal.parse_draft(draft.withColumn("date", draft.line)))
    assert sorted((str(r.row_id), str(r.amount)) for r in found.collect()) == [
        ("1", "10000.0000"), ("3", "12000.0000"), ("4", "10000.0000"), ("None", "20000.0000")]
    assert _plan(found).count("try_cast") == 2  # one a side


def test_f11_only_columns_that_a_search_asks_for_are_normalised(spark):
    rows = search.all_modules({"ap_invoice_detail": spark.createDataFrame(
        [("r1", "Acme Co", "I-1", dt.date(2024, 1, 5), 10.0, "P1"), ("r2", "Other", "I-2", dt.date(2024, 1, 6), 20.0, None), ("r3", None, "", None, None, "p1")],
        "row_id string, vendor_name string, invoice_number string, invoice_date date, invoice_amount double, po_number string")})
    asked = spark.createDataFrame([("q1", "acme", None, None), ("q2", None, "P1", None), ("q3", None, None, "15"), ("q4", "acme", "p1", "11")],
                                  "query_id string, vendor string, po_number string, amount_min string")
    found = search.batch_search(asked, rows, None)
    assert sorted((r.query_id, r.row_id) for r in found.collect()) == [("q1", "r1"), ("q2", "r1"), ("q2", "r3"), ("q3", "r2")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "n_po_number" in plan and "n_vendor_name" in plan and "n_fund" not in plan and "n_invoice_number" not in plan
    assert search.batch_search(asked.limit(0), rows, None).count() == 0


def test_f12_only_cells_that_look_like_a_serial_are_cast(spark):
    cells = ["36526", "36526.00", " 36526 ", "2000-01-02", "n/a", "", None, "99999", "123456", "3652"]
    df = spark.createDataFrame([(i, "1022 Valley", "A1", c, "5.00") for i, c in enumerate(cells)],
                               "row_id int, Vendor string, `Inv No` string, `Inv Date` string, `Gross Amount` string")
    typed, _, warnings = exports.normalize_export(df, "ap_invoice_detail", row_id="row_id", as_of=dt.date(2000, 6, 1))
    assert sorted((r.row_id, r.code) for r in warnings.collect()) == [(i, "excel_serial_dates:invoice_date") for i in range(3)]
    assert {r.row_id: r.invoice_date for r in typed.collect() if r.invoice_date} == {**dict.fromkeys(range(3), dt.date(2000, 1, 1)), 3: dt.date(2000, 1, 2)}
    assert r"^(\d{5})" not in _plan(warnings)  # taken out of the text by a pattern in every cell before


def test_f10_flags_of_a_row_need_no_lambda(spark):
    rows = [(1, "J", "1", "F", "O", "1", "2025-07-05", "5.00", "", "Shipment"), (2, "J", "2", "", "O", "1", "2025-02-30", "-5.00", "1.00", "ab")]
    draft = spark.createDataFrame(rows, "row_id int, journal string, line string, fund string, org string, object string, date string, debit string, credit string, line_description string")
    chart = spark.createDataFrame([(1, "F", "O", "1", "Active")], "row_id int, fund string, org string, object string, status string")
    found = journal.je_findings(journal.parse_draft(draft), chart)
    assert sorted(r.rule_used for r in found.where("row_id is not null").collect()) == [
        "eff_date_valid", "no_both_debit_and_credit", "no_negative_amount", "required_fields_present", "short_description"]
    assert found.where("row_id = '1'").count() == 0 and "lambda" not in _plan(found)
