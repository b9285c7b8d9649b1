"""Large inputs, findings of round 4: what a step copies, and that results stay whole."""

import datetime as dt
import random
import re
from contextlib import contextmanager
from decimal import Decimal
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tieout.functions import similarity as sim
from tieout.operators import ap, bands, budget, findings, po, texts

DAY = dt.date(2024, 1, 1)


@contextmanager
def settings(spark, **conf):
    names = {"adaptive": "spark.sql.adaptive.enabled", "broadcast": "spark.sql.autoBroadcastJoinThreshold"}
    before = {names[k]: spark.conf.get(names[k]) for k in conf}
    for k, v in conf.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _vendor_rows(spark, n):
    rng = random.Random(5)
    names = ["Cascade Paving LLC", "Cascade Pavings", "Acme Supply Co", "Acme Suply", "Acme Supply", None, "Inc"]
    rows = [(i, str(v := rng.randrange(len(names))), names[v], f"I{i}", DAY + dt.timedelta(rng.randrange(260)) if rng.random() < 0.95 else None,
             Decimal(rng.randrange(-40, 60)) / 100 if rng.random() < 0.95 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id bigint, vendor_number string, vendor_name string, invoice_number string, invoice_date date, invoice_amount decimal(18,2)")


@pytest.mark.parametrize("crowded", [0, 12, 512])
def test_similar_vendors_across_borders_of_buckets(spark, crowded):
    rows, df = _vendor_rows(spark, 500)
    bare = {"0": "cascade paving", "1": "cascade pavings", "2": "acme supply", "3": "acme suply", "4": "acme supply"}
    alike = {(a, b): r for a in bare for b in bare if (r := SequenceMatcher(None, bare[a], bare[b]).ratio()) >= 0.88}
    full = [(v, a, d) for _, v, _, _, d, a in rows if a is not None and d is not None]
    want = sorted((x, y, round(alike[x[0], y[0]], 4)) for x in full for y in full
                  if x[0] < y[0] and (x[0], y[0]) in alike and abs(x[1] - y[1]) <= Decimal("0.01") and abs((x[2] - y[2]).days) <= 7)
    got = ap.similar_vendor_same_amount(df, crowded=crowded).collect()
    assert sorted(((r.vendor_a, r.amount_a, r.date_a), (r.vendor_b, r.amount_b, r.date_b), r.similarity) for r in got for _ in range(r.rows_a * r.rows_b)) == want
    assert len({(r.vendor_a, r.vendor_b, r.amount_a, r.amount_b, r.date_a, r.date_b) for r in got}) == len(got) > 30


def test_rows_that_meet_each_other_are_dealt_out_once_and_pairs_never(spark):
    found = ap.similar_vendor_same_amount(_vendor_rows(spark, 50)[1])
    with settings(spark, broadcast="-1"):
        found.collect()
        plan = _planned(found).split("Initial Plan")[0]
    assert plan.count("SortMergeJoin") == 2
    # a reused deal names the one that it reuses
    assert plan.count("ReusedExchange") == 3 and plan.count("Exchange hashpartitioning(") == 4


def test_a_shared_bucket_holds_both_rows_of_a_near_pair(spark):
    rng = random.Random(9)
    rows = [(i, Decimal(rng.randrange(-3000, 3000)) / 100, rng.random() * 40, DAY + dt.timedelta(rng.randrange(900))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x decimal(18,2), y double, d date")
    dealt, keys = bands.shared_buckets(df, {"x": Decimal("0.05"), "y": 0.5, "d": 7})
    got = {}
    for r in dealt.collect():
        got.setdefault(r.i, []).append((tuple(r[k] for k in keys), r["_own"]))
    assert all(sum(own for _, own in places) == 1 and len(dict(places)) == len(places) for places in got.values())
    assert sum(map(len, got.values())) < 1.8 * len(rows)
    home = {i: next(k for k, own in places if own) for i, places in got.items()}
    for i, x, y, d in rows:
        for j, v, w, e in rows:
            if abs(x - v) <= Decimal("0.05") and abs(y - w) <= 0.5 and abs((d - e).days) <= 7:
                assert home[i] in dict(got[j])


@pytest.mark.parametrize("ratio", [0.5, 0.88, 1.0])
def test_ratios_of_pairs_that_repeat(spark, ratio, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    pairs = [(i, a, b) for i, (a, b) in enumerate([(a, b) for a in words for b in words] * 2)] + [(-1, None, "a")]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    monkeypatch.setattr(sim, "SCORES_KEPT", 7)
    got = {r.i: r.ratio for r in sim.with_ratio(df, "a", "b", ratio).collect()}
    assert got == {i: r for i, a, b in pairs if a and (r := SequenceMatcher(None, a, b).ratio()) >= ratio}
    assert got.keys() <= {r.i for r in df.where(sim.few_edits(F.col("a"), F.col("b"), ratio)).collect()}


def test_claims_are_taken_apart_once_and_dealt_out_once(spark):
    said = ["Rows 007, rows 3 and 4 of $1,250.50, 3/4/24, 30 February 2024, INV-007", "two million, forty-five; 1.5 million or 12 percent on May 9"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string").withColumn("text", F.concat("text", F.lit("")))
    claims = texts.extract_claims(docs)
    assert sorted((r.doc_id, r.kind, r.value, r.figure, r.mark, r.places) for r in claims.collect() if r.doc_id == 0) == [
        (0, "date", "2024-03-04", None, "", 0), (0, "ident", "INV-007", None, "", 0), (0, "ident", "INVALID-DATE-2024-02-30", None, "", 0), (0, "number", "$1,250.50", "1250.50", "$", 2),
        (0, "number", "7", "007", "", 0), (0, "row", "3", None, "", 0), (0, "row", "4", None, "", 0)]
    assert sorted((r.kind, r.value, r.figure, r.mark) for r in claims.collect() if r.doc_id == 1) == [
        ("ident", "SPELLED-OUT:TWO MILLION", None, ""), ("monthday", "05-09", None, ""), ("number", "1.5 million", "1500000.", ""), ("number", "12 percent", "12", "%"),
        ("number", "forty-five", "45", "")]
    assert texts.unsupported_claims(claims, claims).collect() == []
    with settings(spark, adaptive="false", broadcast="-1"):
        plan = _planned(texts.unsupported_claims(claims, texts.extract_claims(docs.where("doc_id < 1"))))
    # claims, what supports them, and the claims again; the month names are no pattern of their own
    assert plan.count("Exchange hashpartitioning(") == 3
    assert not re.search(r"RLIKE\([^()]*(\([^()]*\))?[^()]*jan.feb", plan)
    # steps with long expressions stand outside generated loops (no * before them)
    assert any("INVALID-DATE" in x and "*(" not in x for x in plan.splitlines())


def _orders(spark):
    rng = random.Random(7)
    some = lambda *x: rng.choice([*x, None]) if rng.random() < 0.3 else rng.choice(x)
    day = lambda: DAY + dt.timedelta(rng.randrange(40))
    lines = [(some(rng.randrange(300)), some("P%d" % rng.randrange(60), " "), some(*"vw"), some("1", "2"), some("Closed ", "Open", "Open"), some(5, 5, 5, 6),
              some(1.0, 2.0, 0.0), Decimal(rng.randrange(3000, 9000)), some(3, 4, 5), some(2, 3), some(day())) for _ in range(90)]
    inv = [(some(rng.randrange(260)), some("P%d" % rng.randrange(70), ""), some("v", "v", "v", "w", ""), f"I{i}", some(day()), some(Decimal(rng.randrange(100, 300)), Decimal(6000)), some(5, 5, 5, 6),
            some(1.0, 1.0, 2.0)) for i in range(400)]
    return (spark.createDataFrame(inv, "row_id int, po_number string, vendor_number string, invoice_number string, invoice_date date, invoice_amount decimal(18,2), qty int, unit_price double"),
            spark.createDataFrame(lines, "row_id int, po_number string, vendor_number string, line string, status string, qty int, unit_price double, line_amount decimal(18,2), "
                                         "received_qty int, invoiced_qty int, last_activity_date date"))


def test_clean_matches_are_what_the_single_rules_leave(spark):
    inv, lines = _orders(spark)
    ids = lambda df: {r[0] for r in df.select("row_id").collect()}
    by_po = {r.po_number for r in po.invoice_exceeds_po(inv, lines).collect()} | {r.po_number for r in lines.where("invoiced_qty > received_qty").collect()}
    flagged = ids(po.po_unit_price_mismatch(inv, lines)) | ids(po.po_quantity_mismatch(inv, lines)) | ids(po.po_wrong_vendor(inv, lines)) | ids(po.po_missing(inv, lines))
    flagged |= ids(po.po_closed_usage(inv, lines)) | ids(ap.missing_po_over_threshold(inv)) | {r.row_id for r in inv.collect() if (r.po_number or "") and r.po_number in by_po}
    known = {r.po_number for r in lines.collect()} - {None, " "}
    want = [(r.row_id, r.invoice_number) for r in inv.collect() if r.po_number in known and (r.row_id is None or r.row_id not in flagged)]
    got = po.po_clean_matches(inv, lines)
    assert sorted(((r.row_id, r.invoice_number) for r in got.collect()), key=str) == sorted(want, key=str) and len(want) > 10
    assert ids(po.flagged_invoices(inv, lines)) == flagged


def test_invoices_and_order_lines_are_dealt_out_once(spark):
    with settings(spark, adaptive="false", broadcast="-1"):
        plan = _planned(po.po_clean_matches(*_orders(spark)))
    assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan


def _ledger(spark):
    rng = random.Random(4)
    rows = [(some, i, Decimal(rng.choice([1, 2, 3, 5, 10, -10, 20, 0, 1000]))) for some in (*range(40), None) for i in range(rng.randrange(1, 12))]
    return rows, spark.createDataFrame(rows, "g int, i int, amount decimal(18,2)")


@pytest.mark.parametrize("together", [0, 5, 128])
def test_subtotals_of_small_and_spread_groups(spark, together):
    rows, df = _ledger(spark)
    want = {}
    for g in range(40):
        vals = [a for k, _, a in rows if k == g and a]
        run = [sum(vals[: k + 1]) for k in range(len(vals))]
        close = lambda x, c: abs(x - c) <= abs(c) * Decimal("0.005")
        hits = sum(len(vals) >= 3 and ((run[-1] != c and close(run[-1] - c, c)) or any(run[m] and close(run[m], c) for m in range(1, k))
                   or any(run[m] and abs(run[m] - 2 * c) <= abs(c) * Decimal("0.005") for m in range(max(k + 1, 2), len(vals)))) for k, c in enumerate(vals))
        if hits:
            want[g] = hits
    got = budget.subtotal_rollup_signal(df, ["g"], "i", F.floor(F.col("i") / 3), together).collect()
    assert {r.g: r.n_signals for r in got} == want and len(want) > 10


def test_rows_of_small_groups_are_dealt_out_once(spark):
    found = budget.subtotal_rollup_signal(_ledger(spark)[1], ["g"], "i", F.floor(F.col("i") / 3))
    with settings(spark, broadcast="-1"):
        found.collect()
        plan = _planned(found).split("Initial Plan")[0]
    # a reused deal names the one that it reuses
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning(") == 2 and plan.count("Join") == 1


def test_a_finding_travels_once_to_its_cells(spark):
    found = spark.createDataFrame([("f1", {"a": "1,000.00", "b": "1000.00"}), ("f1", {"a": "1,000.00"}), ("f2", {"a": None}), ("f3", {"a": "1/2/24"}), (None, {"a": "x"})],
                                  "finding_id string, computed_values map<string,string>")
    cells = spark.createDataFrame([(f, "ap", r, "c", v) for f, r, v in [("f1", "1", "$1000"), ("f1", "2", "1"), ("f2", "3", ""), ("f3", "4", "2024-01-02"), ("f4", "5", "x"), (None, "6", "x")]],
                                  "finding_id string, table_name string, row_id string, column_name string, cell string")
    files = spark.createDataFrame([("ap", "ap.csv", "h")], "table_name string, file_name string, sha256 string")
    got = findings.source_evidence(found, cells, files)
    assert {r.row_id: r.highlighted for r in got.collect()} == {"1": True, "2": False, "3": False, "4": True, "5": False, "6": False}
    with settings(spark, adaptive="false", broadcast="-1"):
        plan = _planned(findings.source_evidence(found, cells, files))
    # findings by id, cells by id; a third deal told equal values apart before
    assert sum("Exchange hashpartitioning(finding_id" in x and "column_name" not in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines()) == 2
