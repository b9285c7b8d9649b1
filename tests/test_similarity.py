"""Name candidates against every pair, and how many there are."""

import random
from difflib import SequenceMatcher

import pytest

from tieout.functions import similarity as sim

PLACES = "cascade harbor summit valley river granite pioneer sunrise maple cedar northern coastal metro golden silver liberty".split()
TRADES = "paving supply telecom electric plumbing software consulting landscaping printing freight foods medical".split()


def names(rng, n):
    out = {"a", "xy", "ab", "ba", "aa", "é中", "中", "Q" * 7, "q1 q1"}
    while len(out) < n:
        name = f"{rng.choice(PLACES)} {rng.choice(TRADES)}" + rng.choice(["", " group", f" {rng.randrange(30)}"])
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice(["", "e", "z", name[at] * 2]) + name[at + 1 :]
        out.add(name)
    return sorted(out)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize("ratio", [0.5, 0.7, 0.88, 0.9, 1.0])
def test_no_pair_of_the_ratio_is_lost(spark, ratio):
    rng = random.Random(int(ratio * 100))
    left, right = names(rng, 130), names(rng, 130)
    got = {(r.a, r.b) for r in sim.ratio_candidates(frame(spark, left), frame(spark, right), ratio).collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= ratio}
    assert want <= got
    letters = lambda a, b: sum(min(a.count(c), b.count(c)) for c in set(a))
    assert all(2 * letters(a, b) >= ratio * (len(a) + len(b)) - 1e-6 for a, b in got)


def test_few_pairs_meet(spark):
    """Pairs that share any two letters in a row, as against pairs that meet now."""
    some = names(random.Random(1), 300)
    pairs = [{x[i : i + 2] for i in range(len(x) - 1)} for x in some]
    before = sum(bool(p & q) for p in pairs for q in pairs)
    now = sim.ratio_candidates(frame(spark, some), frame(spark, some), 0.88).count()
    assert before > 60_000 and now < before / 25


def test_parts(spark):
    rng = random.Random(3)
    left, right = names(rng, 120), names(rng, 60) + ["cascade", "paving s", "e", "中", "summit foods and more", ""]
    got = {(r.a, r.b) for r in sim.containing_pairs(frame(spark, left), frame(spark, right)).collect()}
    assert got == {(a, b) for a in left for b in right if a and b and (a in b or b in a)}
