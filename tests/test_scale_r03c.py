"""Findings of round 3, third part: the work does not grow faster than the tables."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np

from tests.test_matching import DAY, SCHEMA, brute_match
from tieout.operators import matching


def test_f4_dense_amounts_are_settled_in_tiles(spark, monkeypatch):
    """One chain of amounts over many tiles: no rounds over cells, few passes over tiles."""
    rng = random.Random(4)
    left, right = ([(i, Decimal(rng.randrange(100, 300)) / 100 * sign, DAY + dt.timedelta(rng.randrange(20))) for i in range(300)] for sign in (1, -1))
    passes = []
    settle = matching._settle
    monkeypatch.setattr(matching, "_settle", lambda *a: passes.append(1) or settle(*a))
    monkeypatch.setattr(matching, "_in_rounds", lambda *a: 1 / 0)
    monkeypatch.setattr(matching, "GROUP_ROWS", 50)
    got = matching.match_records(*[spark.createDataFrame(t, SCHEMA) for t in (left, right)], amount_tol="0.02", days=2).collect()
    assert sorted((r.left_index, r.right_index, r.match_kind) for r in got) == brute_match(left, right, Decimal("0.02"), 2)
    assert 2 < len(passes) < 20


def test_f4_a_row_taken_elsewhere_is_left_alone():
    """Of two right rows the first is taken by left row 5 of another tile."""
    l, r = [(3, 0), (9, 0)], [(5, 0), None]
    zero = np.zeros(2, np.int64)
    assert matching.take_in_order(zero, zero, zero, zero, 0, 0, l, r) == [(0, 0), (1, 1)]
    assert matching.take_in_order(zero, zero, zero, zero, 0, 0, [(6, 0), (9, 0)], r) == [(0, 1)]


def test_f4_rows_that_share_a_row_index(spark, monkeypatch):
    """Copies are rows of their own: as many pairs as whole groups give, in tiles of any size."""
    rng = random.Random(5)
    left, right = ([(i // 2, Decimal(100 + i // 2 % 7) / 100 * sign, DAY + dt.timedelta(i // 2 % 5)) for i in rng.sample(range(120), 120)] for sign in (1, -1))
    frames = [spark.createDataFrame(t, SCHEMA) for t in (left, right)]
    found = []
    for rows in (100_000, 15):
        monkeypatch.setattr(matching, "GROUP_ROWS", rows)
        found.append(sorted(tuple(r) for r in matching.match_records(*frames, amount_tol="0.01", days=1).collect()))
    assert found[0] == found[1] and len(found[0]) == 120
