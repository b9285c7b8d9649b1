"""Seeded random tables against the sequential rule written out in plain Python."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.operators import ap, bank, budget, matching
from tieout.operators.bands import Band, band_join
from tieout.operators.ordered import running

DAY = dt.date(2024, 1, 1)
SCHEMA = "row_index bigint, amount decimal(18,2), txn_date date"


def table(rng, n, amounts, days):
    out = []
    for i in range(n):
        amount = None if rng.random() < 0.05 else Decimal(rng.choice(amounts)).scaleb(-2) * rng.choice([1, -1])
        out.append((i, amount, None if rng.random() < 0.05 else DAY + dt.timedelta(rng.randrange(days))))
    return out


def brute_match(left, right, tol, days):
    used, out, taken = set(), [], set()
    for same_day in (True, False):
        for l in left:
            if l[0] in taken or l[1] is None or l[2] is None:
                continue
            for r in right:
                if r[0] in used or r[1] is None or r[2] is None or abs(abs(l[1]) - abs(r[1])) > tol:
                    continue
                gap = abs((l[2] - r[2]).days)
                if gap <= (0 if same_day else days):
                    used.add(r[0])
                    taken.add(l[0])
                    out.append((l[0], r[0], "exact" if gap == 0 else "timing"))
                    break
    return sorted(out)


@pytest.mark.parametrize("seed, tol, days, n, amounts, span", [
    (1, "0", 0, 40, [100, 200], 3), (2, "0", 3, 40, [100, 200, 300], 8), (3, "0.01", 0, 40, [100, 101, 102, 103], 3),
    (4, "0.02", 2, 40, [100, 101, 102, 103, 105], 6), (5, "0", 2, 60, [100], 9)])
def test_match_records(spark, seed, tol, days, n, amounts, span):
    rng = random.Random(seed)
    left, right = table(rng, n, amounts, span), table(rng, n, amounts, span)
    frames = [spark.createDataFrame(t, SCHEMA) for t in (left, right)]
    got = matching.match_records(*frames, amount_tol=tol, days=days)
    assert sorted((r.left_index, r.right_index, r.match_kind) for r in got.collect()) == brute_match(left, right, Decimal(tol), days)


@pytest.mark.parametrize("group_rows", [0, 30])
@pytest.mark.parametrize("seed, tol, days, n, amounts, span", [(5, "0", 2, 60, [100], 9), (6, "0.02", 2, 50, [100, 101, 103, 200, 201, 500], 6), (7, "0", 3, 50, [100, 200, 300, 400], 8)])
def test_match_records_in_rounds_and_small_tasks(spark, monkeypatch, group_rows, seed, tol, days, n, amounts, span):
    """No group settled whole, and groups of both kinds."""
    monkeypatch.setattr(matching, "GROUP_ROWS", group_rows)
    test_match_records(spark, seed, tol, days, n, amounts, span)


def test_match_records_with_long_chains_of_amounts(spark, monkeypatch):
    monkeypatch.setattr(matching, "GROUP_ROWS", 40)
    monkeypatch.setattr(matching, "CHAIN_CHUNK", 1)  # chains run over many chunks
    test_match_records(spark, 8, "0.40", 1, 60, list(range(100, 900, 30)) + [5000, 5001], 3)


@pytest.mark.parametrize("whole", [True, False])
def test_alternating_file_needs_few_rounds(spark, monkeypatch, whole):
    """One magnitude, 400 rows of two dates in turn, all of which want the date between them."""
    rounds = []
    plain = matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: rounds.append(1) or plain(*a))
    if not whole:
        monkeypatch.setattr(matching, "GROUP_ROWS", 100)
    left = [(i, Decimal("5.00"), DAY + dt.timedelta(2 * (i % 2))) for i in range(400)]
    right = [(i, Decimal("-5.00"), DAY + dt.timedelta(1)) for i in range(300)]
    got = matching.match_records(*[spark.createDataFrame(t, SCHEMA) for t in (left, right)], days=1).collect()
    assert sorted((r.left_index, r.right_index) for r in got) == [(i, i) for i in range(300)]
    assert len(rounds) <= (0 if whole else 2)


def test_take_in_order_against_the_rule():
    rng = random.Random(5)
    for _ in range(60):
        l, r = ([(i, rng.randrange(8), rng.randrange(5)) for i in range(rng.randrange(25))] for _ in "lr")
        tol, days, used, want = rng.randrange(3), rng.randrange(3), set(), []
        for i, c, d in l:
            for j, c2, d2 in r:
                if j not in used and abs(c - c2) <= tol and abs(d - d2) <= days:
                    used.add(j)
                    want.append((i, j))
                    break
        sides = [[x[k] for x in t] for t in (l, r) for k in (1, 2)]
        assert matching.take_in_order(*sides, tol, days) == want


@pytest.mark.parametrize("tol, days", [("0", 0), ("0.01", 1), ("0.03", 0), ("0", 2)])
def test_within_table_duplicates(spark, tol, days):
    rows = table(random.Random(7), 60, [100, 101, 102, 300], 6)
    want = {}
    for a in rows:
        near = [b[0] for b in rows if a[0] != b[0] and None not in (a[1], a[2], b[1], b[2])
                and abs(abs(a[1]) - abs(b[1])) <= Decimal(tol) and abs((a[2] - b[2]).days) <= days]
        if near:
            want[a[0]] = (len(near), min(near))
    got = matching.within_table_duplicates(spark.createDataFrame(rows, SCHEMA), tol, days).collect()
    assert {r.row_index: (r.n_partners, r.first_partner) for r in got} == want


def test_band_join_is_exact(spark):
    rng = random.Random(3)
    a = [(rng.randrange(3), Decimal(rng.randrange(400)).scaleb(-2), DAY + dt.timedelta(rng.randrange(20))) for _ in range(50)]
    b = [(rng.randrange(3), Decimal(rng.randrange(400)).scaleb(-2), DAY + dt.timedelta(rng.randrange(20))) for _ in range(50)]
    left = spark.createDataFrame(a, "ka int, va decimal(18,2), da date")
    right = spark.createDataFrame(b, "kb int, vb decimal(18,2), db date")
    got = band_join(left, right, [("ka", "kb")], [Band("va", "vb", Decimal("0.50")), Band("da", "db", 4)]).collect()
    want = [(*x, *y) for x in a for y in b if x[0] == y[0] and abs(x[1] - y[1]) <= Decimal("0.50") and abs((x[2] - y[2]).days) <= 4]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_running_across_chunks(spark):
    rows = [(i % 2, i, i * 3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, i int, v bigint")
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"total": F.col("v")}, rank="rn").collect()
    for r in got:
        same = [x for x in rows if x[0] == r.k and x[1] <= r.i]
        assert (r.total, r.rn) == (sum(x[2] for x in same), len(same))


@pytest.mark.parametrize("seed", range(3))
def test_split_payments(spark, seed):
    rng = random.Random(seed)
    rows = [(i, str(rng.randrange(3)), f"I{i}", DAY + dt.timedelta(rng.randrange(40)), Decimal(rng.choice(["-5", "0", "10", "25", "50", "60"]))) for i in range(60)]
    want = []
    for vendor in {r[1] for r in rows}:
        small = sorted((r for r in rows if r[1] == vendor and 0 < r[4] < 60), key=lambda r: r[3])
        clusters = []
        for hi in range(len(small)):
            lo = next(i for i in range(len(small)) if (small[hi][3] - small[i][3]).days <= 3)
            if hi > lo and sum(r[4] for r in small[lo:hi + 1]) >= 60:
                if clusters and lo <= clusters[-1][1]:
                    clusters[-1][1] = hi
                else:
                    clusters.append([lo, hi])
        want += [(vendor, hi - lo + 1, sum(r[4] for r in small[lo:hi + 1])) for lo, hi in clusters]
    df = spark.createDataFrame(rows, "row_id bigint, vendor_number string, invoice_number string, invoice_date date, invoice_amount decimal(18,2)")
    got = ap.split_payments(df, 60, 3).collect()
    assert sorted((r.vendor_number, r.n_invoices, r.total) for r in got) == sorted(want)
    members = ap.split_payment_rows(df, 60, 3).groupBy("vendor_number", "first_date").count().collect()
    assert sorted((r.vendor_number, r["count"]) for r in members) == sorted((w[0], w[1]) for w in want)


@pytest.mark.parametrize("seed", range(4))
def test_rollup_signal(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i, Decimal(rng.choice([0, 5, 10, 15, 30, 100, -10, 45]))) for g in range(12) for i in range(rng.randrange(2, 9))]
    want = {}
    for g in range(12):
        vals = [r[2] for r in rows if r[0] == g and r[2] != 0]
        hits = 0
        for i, c in enumerate(vals):
            others = [v for j, v in enumerate(vals) if j != i]
            close = lambda x: abs(x - c) <= abs(c) * Decimal("0.005")
            run = [sum(others[:k]) for k in range(2, len(others) + 1)]
            total = sum(others)
            hits += len(vals) >= 3 and (any(map(close, run)) or (total != 0 and close(total)))
        if hits:
            want[g] = hits
    df = spark.createDataFrame(rows, "g int, i int, amount decimal(18,2)")
    got = budget.subtotal_rollup_signal(df, ["g"], "i", F.floor(F.col("i") / 3)).collect()
    assert {r.g: r.n_signals for r in got} == want


@pytest.mark.parametrize("ratio", [0.7, 0.88, 0.9])
@pytest.mark.parametrize("crowded", [0, 512])
def test_similar_vendors(spark, crowded, ratio):
    from difflib import SequenceMatcher

    names = ["Cascade Paving LLC", "Cascade Pavings Inc", "Cascad Paving", "Acme Supply Co", "Acme Suply", "Delta", "Xy", "Xy Co"]
    rng = random.Random(11)
    rows = [(i, str(rng.randrange(len(names))), f"I{i}", DAY + dt.timedelta(rng.randrange(12)), Decimal(rng.choice(["10.00", "10.01", "20.00"]))) for i in range(60)]
    rows = [(i, v, names[int(v)], inv, d, a) for i, v, inv, d, a in rows]
    df = spark.createDataFrame(rows, "row_id bigint, vendor_number string, vendor_name string, invoice_number string, invoice_date date, invoice_amount decimal(18,2)")
    bare = {str(i): n for i, n in enumerate(["cascade paving", "cascade pavings", "cascad paving", "acme supply", "acme suply", "delta", "xy", "xy"])}
    want = sum(1 for x in rows for y in rows if x[1] < y[1] and abs(x[5] - y[5]) <= Decimal("0.01") and abs((x[4] - y[4]).days) <= 7
               and SequenceMatcher(None, bare[x[1]], bare[y[1]]).ratio() >= ratio)
    got = ap.similar_vendor_same_amount(df, ratio, crowded=crowded).collect()
    assert sum(r.rows_a * r.rows_b for r in got) == want > 0
    assert len({(r.vendor_a, r.vendor_b, r.amount_a, r.amount_b, r.date_a, r.date_b) for r in got}) == len(got)


def test_prior_period_and_batches(spark):
    days = [DAY + dt.timedelta(i) for i in range(20)] + [DAY - dt.timedelta(90)]
    df = spark.createDataFrame([(i, Decimal(i + 1), d) for i, d in enumerate(days)], SCHEMA)
    assert [r.row_index for r in bank.prior_period_items(df).collect()] == [20]
    many = spark.createDataFrame([(i, Decimal(a), DAY) for i, a in enumerate([10, 20, 30, 5])], SCHEMA)
    one = spark.createDataFrame([(0, Decimal(60), DAY), (1, Decimal(65), DAY), (2, Decimal(30), DAY)], SCHEMA)
    got = {(r.total_side, r.row_index, r.batch_kind) for r in bank.batch_total_match(many, one).collect()}
    assert got == {("ledger", 0, "run"), ("ledger", 1, "date")}
