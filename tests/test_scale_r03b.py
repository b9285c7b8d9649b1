"""Large inputs, second part: what a step holds and copies, and that results stay whole."""

import datetime as dt

from tieout.operators import ap, profiling
from tieout.sources import exports


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_of_a_file_fold_to_one_row_before_layouts_are_compared(spark):
    rows = [("a", h) for h in ("Vend No", "vendor_name", "Status", "STATUS", "dba", "no such column", "")]
    rows += [("b", h) for h in ("Inv No", "Invoice Date", "Gross Amount", "vendor_number", "Purchase Order")] + [("c", None), (None, "Account Code")]
    headers = spark.createDataFrame(rows, "file_id string, header string")
    got = {(r.file_id, r.dataset_type): (r.required_matched, r.optional_matched, r.score) for r in exports.header_scores(headers, ["file_id"]).collect()}
    assert len(got) == 4 * 8
    assert got["a", "vendor_list"] == (3, 1, 0.825) and got["b", "ap_invoice_detail"] == (4, 1, 0.8167)
    assert got["c", "je_upload"] == (0, 0, 0.0) and got[None, "chart_of_accounts"] == (1, 0, 0.1333)
    best = exports.detect_dataset_type(headers)
    assert {(r.file_id, r.dataset_type) for r in best.collect()} == {("a", "vendor_list"), ("b", "ap_invoice_detail"), ("c", None), (None, None)}
    assert _plan(best).count("Aggregate") == 1 and "Window" not in _plan(best) and "Generate" not in _plan(best)


def test_check_lines_are_taken_apart_once_they_met_their_check(spark):
    day = dt.date
    checks = spark.createDataFrame([
        (1, "c1", day(2024, 1, 5), "v", "Cleared", "i1; i2"), (2, "c1", day(2024, 1, 1), "v", "Cleared", "i3"), (None, "c1", day(2023, 1, 1), "v", "Cleared", ""),
        (3, "c2", day(2024, 1, 1), "v", "void", "i1"), (4, "c2", day(2024, 1, 1), "v", "Cleared", "i2"), (5, "c3", None, "v", None, "i1"),
        (6, "c4", day(2024, 1, 2), "w", "Cleared", "i1"), (7, None, day(2024, 1, 2), "v", "Cleared", "i1")],
        "row_id int, check_number string, check_date date, vendor_number string, status string, invoice_numbers string")
    inv = spark.createDataFrame([(i, "v", f"i{i}", day(2024, 1, 6)) for i in (1, 2, 3)], "row_id int, vendor_number string, invoice_number string, invoice_date date")
    early = ap.payment_before_invoice(inv, checks)
    assert sorted((r.row_id, r.check_number, r.days_early) for r in early.collect()) == [(1, "", 4), (1, "c1", 1), (2, "c1", 1), (3, "c1", 1)]
    plan = _plan(early)
    assert plan.count("Join") == 2 and plan.count("LogicalRDD") == 3
    got = ap.multi_check_invoice(checks)
    want = [("i1", 4, "", "c4")]
    assert sorted((r.invoice_number, r.n_checks, r.first_check, r.last_check) for r in got.collect()) == want


def test_tasks_of_a_large_check_register_grow_with_its_lines(spark, monkeypatch):
    monkeypatch.setattr(ap, "CHECKS_PER_TASK", 10)
    checks = spark.range(200).selectExpr("id AS row_id", "concat('c', id) AS check_number", "if(id % 10 = 0, 'Void', '') AS status", "concat('i', id % 50) AS invoice_numbers")
    got = ap.multi_check_invoice(checks)
    assert "RepartitionByExpression [check_number" in _plan(got)
    assert sorted((r.invoice_number, r.n_checks) for r in got.collect()) == sorted((f"i{i}", 4) for i in range(50) if i % 10)


def test_footer_cells_are_worked_out_once(spark):
    rows = [(1, "SubTotal", "1"), (2, "summer", "1"), (3, " ", "$1,234.50"), (4, None, None), (5, "End  of report", ""), (6, "x", "5"), (7, "", "(3)"),
            (8, "total\u0001", None), (9, "Totally", "records printed"), (10, "GRAND TOTAL", None), (11, "reports", "sum")]
    df = spark.createDataFrame(rows, "row_id int, a string, b string").selectExpr("row_id", "concat(a, '') AS a", "concat(b, '') AS b")
    got = profiling.footer_total_rows(df, ["a", "b"])
    assert sorted(r.row_id for r in got.collect()) == [1, 3, 5, 7, 8, 9, 10, 11]
    # each cell stands in the filter once
    line = next(x for x in _plan(got).splitlines() if "Filter" in x)
    assert line.count("concat(a") + line.count("a#") <= 2
