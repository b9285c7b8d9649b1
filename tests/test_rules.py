"""Small planted tables: each rule fires where it should and nowhere else."""

import datetime as dt
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tieout.operators import ap, budget, findings, journal, po, profiling, report, runs, search

D = Decimal
DAY = dt.date(2026, 1, 10)


def ids(df, col="row_id"):
    return sorted(r[col] for r in df.collect())


def test_payables(spark):
    cols = "row_id bigint, vendor_number string, vendor_name string, invoice_number string, invoice_date date, invoice_amount decimal(18,2), po_number string, check_number string"
    rows = [(1, "V1", "Acme", "A1", DAY, D(100), "P1", "C1"), (2, "V1", "", "A1", DAY, D(100), "P1", "C2"), (3, " V1", "Acme", "a1", DAY, D(100), "P1", ""),
            (4, "V2", None, "B1", DAY, D(6000), " ", ""), (5, "V9", "Ghost", "C1", DAY, D(50), "P2", "C3"), (6, "", "", "D1", DAY, None, "", "")]
    inv = spark.createDataFrame(rows, cols)
    ven = spark.createDataFrame([(1, "V1", "Acme", "Active"), (2, "V2", "Beta", "Active"), (3, "V2", "Beta2", "INACTIVE")],
                                "row_id bigint, vendor_number string, vendor_name string, status string")
    chk = spark.createDataFrame([(1, "C1", DAY - dt.timedelta(2), "V1", "Cleared", "A1;B1"), (2, "C2", DAY, "V1", "Cleared", "A1"),
                                 (3, "C3", None, "V9", "Cleared", "C1"), (4, "C4", DAY, "V9", "Printed", "A1"), (5, "C4", DAY, "V9", "Void", "A1")],
                                "row_id bigint, check_number string, check_date date, vendor_number string, status string, invoice_numbers string")
    d1 = ap.duplicate_invoice(inv).collect()
    assert [(r.vendor_number, r.invoice_number, r.n_rows, r.first_row) for r in d1] == [("V1", "A1", 2, 1)]
    assert [(r.invoice_number, r.n_checks) for r in ap.multi_check_invoice(chk).collect()] == [("A1", 2)]
    d2 = {r.row_id: (r.n_partners, r.partner_invoice) for r in ap.same_vendor_near_duplicate(inv).collect()}
    assert d2 == {1: (1, "a1"), 2: (1, "a1"), 3: (2, "A1")}
    assert ids(ap.missing_po_over_threshold(inv)) == [4]
    assert [(r.row_id, r.days_early) for r in ap.payment_before_invoice(inv, chk).collect()] == [(1, 2)]
    linked = ap.payment_before_invoice(inv.drop("check_number"), chk).collect()
    assert sorted((r.row_id, r.check_number) for r in linked) == [(1, "C1"), (2, "C1")]
    assert ids(ap.inactive_vendor(inv, ven)) == [4] and ids(ap.unknown_vendor(inv, ven)) == [5]
    assert {r.row_id: r.vendor_name for r in ap.fill_vendor_names(inv, ven).collect()} == {1: "Acme", 2: "Acme", 3: "Acme", 4: "Beta2", 5: "Ghost", 6: ""}


def test_purchase_orders(spark):
    inv = spark.createDataFrame([(1, "P1", "V1", "I1", DAY, D(120), D(5), 2.0), (2, "P1", "V2", "I2", DAY, D(10), D(3), 1.0),
                                 (3, "P9", "V1", "I3", DAY, D(10), D(1), 1.0), (4, "P2", "V1", "I4", DAY, D(10), D(2), 1.0), (5, "", "V1", "I5", DAY, D(9000), None, None)],
                                "row_id bigint, po_number string, vendor_number string, invoice_number string, invoice_date date, invoice_amount decimal(18,2), qty decimal(18,2), unit_price double")
    lines = spark.createDataFrame([(1, "P1", "V1", "1", "Open", D(4), 1.0, D(100), D(4), D(0), DAY), (2, "P1", "V3", "2", "Open", D(3), 1.005, D(20), None, D(3), DAY),
                                   (3, "P2", "V1", "1", "Closed", D(2), 0.0, D(10), D(2), D(0), DAY - dt.timedelta(5)), (4, "P3", "V1", "1", "Open", D(2), 1.0, D(10), D(2), D(0), DAY),
                                   (5, "P2", "V1", "2", "Open", D(9), 1.0, D(10), D(1), D(2), DAY)],
                                  "row_id bigint, po_number string, vendor_number string, line string, status string, qty decimal(18,2), unit_price double, "
                                  "line_amount decimal(18,2), received_qty decimal(18,2), invoiced_qty decimal(18,2), last_activity_date date")
    assert [(r.po_number, r.overage) for r in po.invoice_exceeds_po(inv, lines).collect()] == [("P1", D(10))]
    assert po.invoice_exceeds_po(inv, lines, over_pct=10).count() == 0
    assert [(r.row_id, r.po_vendor) for r in po.po_wrong_vendor(inv, lines).collect()] == [(2, "V1")]
    assert ids(po.po_missing(inv, lines)) == [3]
    assert ids(po.po_closed_usage(inv, lines)) == [4] and ids(po.po_closed_usage(inv, lines, 5)) == []
    assert {(r.row_id, r.po_line) for r in po.best_po_line(inv, lines).collect()} == {(1, "1"), (2, "2"), (4, "1")}
    assert ids(po.po_unit_price_mismatch(inv, lines)) == [1]
    assert ids(po.po_quantity_mismatch(inv, lines)) == [1]
    assert ids(po.received_not_invoiced(inv, lines)) == [4]
    assert [(r.row_id, r.n_invoices) for r in po.invoiced_not_received(inv, lines).collect()] == [(5, 1)]
    assert ids(po.po_clean_matches(inv, lines)) == []


def test_journals(spark):
    draft = spark.createDataFrame([
        (1, "J1", "1", "01/15/2026", "1", "10", "500", "100.00", "", "Paper"), (2, "J1", "1", "2026-01-15", "1", "10", "500", "", "100.00", "Paper"),
        (3, "J2", "1", "", "1", "", "", "5", "5", "ab"), (4, "J2", "2", "2026-02-30", "7", "10", "501", "(5)", "", "Neg"),
        (5, "J3", "1", "2020-01-01", "1", "20", "500", "20,000", "", "Round"), (6, "J3", "2", "2026-01-01", "1", "10", "500", "0", "", "Zero"),
        (7, "J4", "1", "2026-01-01", "1", "10", "501", "0.004", "", "Tiny")],
        "row_id int, journal string, line string, date string, fund string, org string, object string, debit string, credit string, line_description string")
    chart = spark.createDataFrame([(1, "1", "10", "500", "Active"), (2, "1", "10", "501", "Closed"), (3, "2", "20", "502", "")],
                                  "row_id int, fund string, org string, object string, status string")
    p = journal.parse_draft(draft)
    assert [(r.row_id, r.first_row) for r in journal.je_duplicate_lines(p).collect()] == [(2, 1)]
    assert ids(journal.je_date_required(p)) == [3] and ids(journal.je_date_valid(p)) == [4] and ids(journal.je_date_in_period(p)) == [5]
    assert sorted((r.row_id, r.missing) for r in journal.je_required_fields(p).collect()) == [(3, "org, object"), (6, "debit or credit")]
    assert ids(journal.je_both_sides(p)) == [3]
    assert [(r.row_id, r.side) for r in journal.je_negative(p).collect()] == [(4, "debit")]
    assert sorted((r.row_id, r.segment) for r in journal.je_account_in_coa(p, chart).collect()) == [(4, "fund")]
    assert ids(journal.je_inactive_account(p, chart)) == [7] and ids(journal.je_combo_unseen(p, chart)) == [5]
    history = spark.createDataFrame([("1", "20", "500")], "fund string, org string, object string")
    assert ids(journal.je_combo_unseen(p, chart, history)) == []
    assert ids(journal.je_short_description(p)) == [3] and ids(journal.je_round_dollar(p)) == [5]
    assert [r.journal for r in journal.je_balance_per_journal(p).orderBy("journal").collect()] == ["J2", "J3"]
    found = journal.je_findings(p, chart)
    rows = {(r.rule_used, r["count"]) for r in found.groupBy("rule_used").count().collect()}
    assert ("required_fields_present", 2) in rows and ("debits_equal_credits_per_journal", 2) in rows and ("debits_equal_credits_overall", 1) in rows
    assert journal.journal_upload_rows(p, found).count() == 0
    good = journal.parse_draft(draft.where("row_id in (1)").unionByName(draft.where("row_id = 2").withColumn("line", F.lit("2"))))
    up = journal.journal_upload_rows(good, journal.je_findings(good, chart)).orderBy("source_row").collect()
    assert [(r["Eff Date"], r["Debit"], r["Credit"]) for r in up] == [("2026-01-15", "100.00", ""), ("2026-01-15", "", "100.00")]


def test_budget(spark):
    b = spark.createDataFrame([(1, "1", "10", D(100)), (2, "1", "10", D(200)), (3, "1", "20", D(0)), (4, "2", "30", D(100000)), (5, "", "", D(7)), (6, "TOTAL 1", "", D(9))],
                              "row_id int, fund string, account string, amount decimal(18,2)")
    a = spark.createDataFrame([(1, "1", "10", D(221)), (2, "1", "20", D(9999)), (3, "3", "40", D(5))], "row_id int, fund string, account string, amount decimal(18,2)")
    got = {r.account: (r.dollar_variance, r.flagged, r.severity) for r in budget.budget_vs_actual(b, a).collect()}
    assert got == {"10": (D(21), True, "medium"), "20": (D(9999), False, "info")}
    assert [r.account for r in budget.one_sided(b, a).collect()] == ["30"] and [r.account for r in budget.one_sided(a, b).collect()] == ["40"]
    assert ids(budget.report_total_rows_skipped(b, ["fund", "account"])) == [5, 6]
    chart = spark.createDataFrame([("1", "10"), ("8", "80")], "fund string, account string")
    assert [r.account for r in budget.missing_accounts(chart, b, a).collect()] == ["80"]
    assert tuple(budget.key_overlap(b, a).head()) == (2, 1, 1)
    assert budget.budget_basis_mismatch(b, a).head().reason == "magnitude"


def test_report(spark):
    cols = "row_id int, section string, account_code string, account_name string, line_type string, amount decimal(18,2)"
    rep = spark.createDataFrame([(1, "Rev", "1", "Tax", "line_item", D(100)), (2, "Rev", "1", "Tax", "Line_Item", D(100)), (3, "Rev", "2", "Fee", "line_item", D(-5)),
                                 (4, "Rev", "", "", "subtotal", D(195)), (5, "Rev", "", "", "subtotal", D(200)), (6, "Exp", "2", "Fees", "line_item", D(50000)),
                                 (7, "Exp", "", "", "subtotal", D(50000)), (8, "Empty", "", "", "subtotal", D(1)), (9, "T", "", "", "grand_total", D(50196))], cols)
    assert [(r.row_id, r.difference) for r in report.subtotal_tie_out(rep).orderBy("row_id").collect()] == [(5, D(5)), (8, D(1))]
    assert [(r.row_id, r.subtotal_sum) for r in report.grand_total_tie_out(rep).collect()] == [(9, D(50396))]
    assert [(r.row_id, r.first_row) for r in report.report_duplicate_lines(rep).collect()] == [(2, 1)]
    assert ids(report.negative_not_allowed(rep, ["Rev"])) == [3]
    assert [(r.account_code, r.n_names) for r in report.inconsistent_naming(rep).collect()] == [("2", 2)]
    need = spark.createDataFrame([("Rev",), ("Debt",)], "section string")
    assert [r.section for r in report.missing_sections(rep, need).collect()] == ["Debt"]
    prior = spark.createDataFrame([(1, "x", "2", "", "line_item", D(9)), (2, "x", "2", "", "line_item", D(30000)), (3, "x", "1", "", "line_item", D(0))], cols)
    assert ids(report.prior_version_change(rep, prior)) == [3, 6]
    wide = spark.createDataFrame([(1, "2", "3", "4"), (2, "5", "6", "7")], "row_id int, jan string, feb string, mar string")
    assert report.report_structure(wide, profiling.parse_confidence(wide)).head().wide_layout
    nested = rep.withColumn("level", F.col("row_id") % 4).withColumn("line_type", F.lit("odd"))
    got = report.report_structure(nested, profiling.parse_confidence(nested)).head()
    assert (got.wide_layout, got.unknown_line_types, got.nested_rollup) == (False, True, True)


def test_profiling(spark):
    rows = [(1, "Post Date", "Amount", "Memo"), (2, "2026-01-01", "10", "x"), (3, "2026-01-01", "10", "x"), (4, "", "", "Grand total"), (5, "", "99.50", ""), (6, "", "", "lone")]
    df = spark.createDataFrame(rows, "row_id int, `Post Date` string, Amount string, Memo string")
    assert ids(profiling.repeated_header_rows(df)) == [1] and ids(profiling.footer_total_rows(df)) == [4, 5]
    assert [(r.row_id, r.first_row) for r in profiling.duplicate_rows(df).collect()] == [(3, 2)]
    prof = profiling.parse_confidence(df)
    m = {r.semantic: (r.mapped_column, r.source) for r in profiling.semantic_mapping(prof).collect()}
    assert m["amount"][0] == "amount" and m["date"][0] == "post_date" and m["description"] == ("memo", "auto")
    human = spark.createDataFrame([("input", "date", "Memo")], "input_key string, semantic string, column string")
    got = {r.semantic: (r.mapped_column, r.confidence, r.source) for r in profiling.semantic_mapping(prof, approved=human).collect()}
    assert got["date"] == ("memo", 1.0, "human")
    near = spark.createDataFrame([("input", 0, "check_date", 5, 1.0, 0.0), ("input", 1, "post_date", 5, 1.0, 0.0)],
                                 "input_key string, position int, column string, non_blank bigint, date_confidence double, amount_confidence double")
    tie = profiling.semantic_mapping(near)
    assert tie.where("semantic = 'date'").head().confidence == 0.5
    need = spark.createDataFrame([("input", "date", True), ("input", "fund", True), ("input", "section", False)], "input_key string, semantic string, required boolean")
    found = profiling.preflight_findings(tie, near, need)
    assert {(r.semantic, r.code, r.blocks_run) for r in found.collect()} == {
        ("date", "ambiguous_column_mapping", True), ("fund", "missing_required_column", True), ("fund", "needs_human_configuration", True)}
    assert [(r.status, r.n_findings) for r in profiling.preflight_status(found, need).collect()] == [("FAIL", 3)]


def test_findings_layer(spark):
    rows = spark.createDataFrame([(1, "V1", D("12.50")), (2, "V1", D("7.00"))], "row_id int, vendor_number string, invoice_amount decimal(18,2)")
    found = findings.to_findings(rows, "unknown_vendor_payment", ["row_id"], ["invoice_amount"], F.col("vendor_number"))
    first = found.orderBy("description").head()
    assert (first.severity, first.finding_type, first.requires_human_review, first.computed_values) == ("high", "missing_reference", True, {"invoice_amount": "12.50"})
    assert findings.result_digest(found.repartition(3)).head() == findings.result_digest(found.coalesce(1)).head()
    assert findings.result_digest(found.limit(1)).head() != findings.result_digest(found).head()
    stamp = spark.createDataFrame([("2026-01-01T10:00:00Z",)], "t string"), spark.createDataFrame([("2027-01-01T11:00:00Z",)], "t string")
    assert findings.result_digest(stamp[0]).head() == findings.result_digest(stamp[1]).head()


def test_runs(spark):
    ev = spark.createDataFrame([(1, 1, 1, "created"), (1, 2, 2, "mark_reviewed"), (2, 1, 3, "approve_draft"), (2, 2, 4, "reject_ai_explanation"), (2, 3, 5, "mark_reviewed"), (3, 1, 6, "add_note")],
                               "run_id int, ts int, seq int, action string")
    assert {r.run_id: r.review_status for r in runs.run_status(ev).collect()} == {1: "in_review", 2: "rejected", 3: "pending"}
    assert {r.run_id: r.draft_status for r in runs.draft_status(ev).collect()} == {1: "draft", 2: "final (human-approved)", 3: "draft"}
    items = spark.createDataFrame([(1, dt.date(2026, 1, 31), "monthly", None, True), (2, dt.date(2026, 1, 30), "custom", None, True), (3, dt.date(2025, 11, 30), "quarterly", None, True),
                                   (4, dt.date(2026, 1, 1), "custom", 3, False)], "item_id int, next_due date, cadence string, interval_days int, active boolean")
    assert [(r.item_id, r.following_due) for r in runs.due_items(items, dt.date(2026, 1, 31)).collect()] == [
        (3, dt.date(2026, 2, 28)), (2, dt.date(2026, 2, 13)), (1, dt.date(2026, 2, 28))]
    df = spark.createDataFrame([(1, [1, 2], {"a": "x"})], "k int, xs array<int>, m map<string,string>")
    new = spark.createDataFrame([(1, [1, 3, 4], {"b": "x"})], "k int, xs array<int>, m map<string,string>")
    got = {(r.path, r.change, r.old_value, r.new_value) for r in runs.diff_records(runs.flatten(df, ["k"]), runs.flatten(new, ["k"]), ["k"]).collect()}
    assert got == {("xs[1]", "changed", "2", "3"), ("xs[2]", "added", None, "4"), ("m.a", "removed", "x", None), ("m.b", "added", None, "x")}


def test_preflight_steps(spark):
    found = spark.createDataFrame([("a", 3, False, "low", "tidy"), ("a", 1, True, "high", " map the date "), ("a", 2, True, "high", "map the fund"), ("a", 0, True, "high", "map the fund"),
                                   ("b", 5, False, "low", "tidy"), ("b", 4, False, "info", "tidy"), ("b", 6, False, "low", None), ("b", 7, False, "low", " "), ("b", 1, False, "low", "look")],
                                  "input_key string, position int, blocks_run boolean, severity string, action string")
    steps = {(r.input_key, r.step_no): r.step for r in profiling.preflight_steps(found).collect()}
    assert steps == {("a", 1): "map the fund", ("a", 2): "map the date", ("b", 1): "look", ("b", 2): "tidy"}
    status = profiling.preflight_status(found, spark.createDataFrame([("a",), ("b",), ("c",)], "input_key string"))
    assert sorted(map(tuple, profiling.supported_checks(status, ["exact", "timing"]).collect())) == [("b", "exact"), ("b", "timing"), ("c", "exact"), ("c", "timing")]
    assert profiling.preflight_steps(found.limit(0)).count() == 0
    actions = {r.code: r.action for r in spark.createDataFrame([(c, "fund") for c in profiling.ACTIONS], "code string, semantic string")
               .select("code", profiling.suggested_action("code", "semantic").alias("action")).collect()}
    assert all("fund" in a for a in actions.values()) and len(set(actions.values())) == len(profiling.ACTIONS)


def _changes(a, b, path=""):
    """Differences of two parsed texts, in plain Python."""
    if isinstance(a, dict) and isinstance(b, dict):
        for k in {**a, **b}:
            at = f"{path}.{k}" if path else k
            yield from _changes(a[k], b[k], at) if k in a and k in b else [(at, "removed", a[k], None) if k in a else (at, "added", None, b[k])]
    elif isinstance(a, list) and isinstance(b, list):
        for i in range(max(len(a), len(b))):
            at = f"{path}[{i}]"
            yield from _changes(a[i], b[i], at) if i < min(len(a), len(b)) else [(at, "removed", a[i], None) if i < len(a) else (at, "added", None, b[i])]
    elif a != b:
        yield path, "changed", a, b


def test_json_changes(spark):
    rng = random.Random(3)

    def tree(depth):
        kind = rng.choice("sonld" if depth else "son")
        return {"s": lambda: rng.choice(["x", 'a"[{', "é", ""]), "o": lambda: rng.choice([1, 2, 3]), "n": lambda: None, "l": lambda: [tree(depth - 1) for _ in range(rng.randrange(4))],
                "d": lambda: {k: tree(depth - 1) for k in rng.sample(["p", "q.r", "s", "[t"], rng.randrange(4))}}[kind]()

    sides = [({"top": tree(4), "more": tree(3)}, {"top": tree(4), "more": tree(3)}) for _ in range(150)] + [({"a": [1]}, {"a": [1]}), ({}, {"a": {"b": []}}), ({"a": None}, {}), ({"a": []}, {"a": {}})]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(sides)] + [(900, None, '{"z": 1}'), (901, None, None), (902, "no json", "{}")], "i int, a string, b string")
    deep = spark.createDataFrame([(r'{"a\\": "x\"[[[["}',), (r'[{"a": ["\\\\", {}]}]',), ("3",)], "t string").select(runs._nesting(F.col("t"))).collect()
    assert [r[0] for r in deep] == [1, 4, 0]
    got = runs.json_changes(df, ["i"], "a", "b").collect()
    show = lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True)
    here = sorted((r.i, r.path, r.change, show(r.old_value) or "", show(r.new_value) or "") for r in got)
    dump = lambda x, there: json.dumps(x, sort_keys=True) if there else ""
    want = [(i, p, c, dump(o, c != "added"), dump(n, c != "removed")) for i, (a, b) in enumerate(sides) for p, c, o, n in _changes(a, b)]
    assert here == sorted(want + [(900, "z", "added", "", "1"), (902, "", "changed", '["no json"]', "{}")])


def test_batch_search_agrees_with_single_searches(spark):
    rows = [("ap_invoice_detail", str(i), ["Cascade Paving", "Acme Supply", None][i % 3], f"INV-{i % 7}", None, None, str(i % 4), None, str(i % 5),
             DAY + dt.timedelta(i * 3) if i % 11 else None, D(i * 10 - 200), f"row {i % 6} pothole") for i in range(60)]
    tx = spark.createDataFrame(rows, "module string, row_id string, vendor_name string, invoice_number string, po_number string, check_number string, fund string, "
                               "department string, object_code string, txn_date date, amount decimal(18,2), text string")
    crit = spark.createDataFrame([("a", "cascad paving", None, None, None, None, None), ("b", None, "inv 3", None, None, "100", None), ("c", None, None, "2026-02-01", "2026-03-05", None, None),
                                  ("d", None, None, None, None, "150", None), ("e", "acme", None, "2026-02-01", None, None, ["row 1", "ROW 4"]), ("f", None, None, None, "2026-01-20", None, None)],
                                 "query_id string, vendor string, invoice_number string, date_from string, date_to string, amount_min string, keywords array<string>")
    got = {(r.query_id, r.row_id) for r in search.batch_search(crit, tx).collect()}
    want = set()
    for c in crit.collect():
        r = tx
        if c.vendor:
            r = search.search_vendor(r, c.vendor)
        if c.invoice_number:
            r = search.search_equal(r, "invoice_number", c.invoice_number)
        r = search.search_date_range(r, c.date_from, c.date_to)
        if c.amount_min:
            r = search.search_amount_range(r, D(c.amount_min))
        if c.keywords:
            r = search.search_keywords(r, c.keywords)
        want |= {(c.query_id, x.row_id) for x in r.collect()}
    assert got == want and {q for q, _ in want} == set("abcdef")
