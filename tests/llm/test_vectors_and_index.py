"""Whitening, hard negatives and the digest index against brute force on small
tables with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import digests, negatives, spectrum, whitening

VECTORS = "vec_id bigint, embedding array<double>, label int, n bigint, x string, score string, code string, b string, g string, anchor string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "s", "c", "b", "g", "a", "w") for r in rows], VECTORS)


def some_vectors(seed: int = 3, n: int = 400, dims: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = 1 + 0.3 * rng.normal(size=(4, dims))
    rows = [(i, (centres[i % 4] + rng.normal(size=dims) * 0.6).round(2).tolist(), int(i % 4)) for i in range(n)]
    rows += [(1000, None, 1), (1001, [0.1] * (dims - 1) + [None], 1), (1002, [float("nan")] * dims, 1), (1003, [float("inf")] + [0.0] * (dims - 1), 0)]
    rows += [(1004, [], 1), (1100, rows[0][1], 0), (1200, rows[4][1], 0), (1300, [0.0] * dims, 2), (1400, [-x for x in rows[0][1]], 0)]
    return rows


# -- 11


def exact_fit(rows):
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * a - t) / n for a, t in zip(r, s)] for r in x])
    return x, n, s, centred


def check_whitening(spark, rows, k=8):
    x, n, s, centred = exact_fit(rows)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = whitening.whiten(vectors(spark, rows).repartition(3), k).collect()
    ids = [i for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    assert sorted(str(r.vec_id) for r in got) == sorted(map(str, ids))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    want = {}
    for i, row, c in zip(ids, x, centred):
        want.setdefault(i, []).append((sum((n * a - t) ** 2 for a, t in zip(row, s)), c @ u / np.sqrt(e)))
    values = np.array([r.whitened for r in got])
    theirs = np.array([want[r.vec_id][0][1] for r in got])
    assert values.shape == theirs.shape
    sign = np.sign((values * theirs).sum(axis=0))
    assert np.allclose(values * sign, theirs, atol=1e-8)
    for r in got:
        assert int(r.deviation) == want[r.vec_id][0][0]
        assert np.allclose(r.explained, e / np.trace(cov), rtol=1e-10)


def test_whitening_against_dense_solver(spark):
    rows = some_vectors()
    check_whitening(spark, [*rows, rows[7], (None, rows[9][1], None)])
    check_whitening(spark, some_vectors(dims=12), k=8)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    [only] = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 1)])).collect()
    assert (only.n, int(only.deviation), only.whitened, only.explained, only.identity_error) == (1, 0, [], [], 0.0)
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 7.0, float(i)], 1) for i in range(5)])).collect()
    assert all(len(r.whitened) == 1 for r in flat)  # one direction varies
    mixed = whitening.whiten(vectors(spark, [(i, [float(i), float(i * i % 5)], 1) for i in range(5)] + [(9, [1.0], 1)])).collect()
    assert sorted(r.vec_id for r in mixed) == [0, 1, 2, 3, 4]


def test_moments_are_exact_beyond_doubles(spark):
    big = [(i, [2.0**40 * (i % 3), float(i)], 1) for i in range(6)]
    x, n, s, _ = exact_fit(big)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, big)).collect()}
    assert got == {i: sum((n * a - t) ** 2 for a, t in zip(r, s)) for i, r in enumerate(x)}


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0, 0, 0, 0], [3] * 9, [1, 1 + 1e-13, 1 + 1e-9, 0.5, 0, 0], [4], [2, -3, 1, -1], list(range(40, 0, -1)), [1e9, 1, 1e-9]])
def test_spectrum_slicing(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    value, vector = spectrum.leading(a, 8)
    top = np.sort(values)[::-1][:8]
    assert np.allclose(value, top, atol=1e-13 * max(map(abs, values)) * len(values))
    assert np.allclose(vector.T @ vector, np.eye(len(top)), atol=1e-12)
    assert np.abs(a @ vector - vector * value).max() < 1e-12 * max(map(abs, values)) * len(values)
    for shift in np.linspace(min(values) - 1.03, max(values) + 1.01, 23):
        assert spectrum.above(a, shift) == sum(v > shift for v in values)


# -- 12


def brute_negatives(rows, anchors, positives=5, k=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        code = [int(np.floor(256 * c)) for c in v]
        best[i] = min(best.get(i, (label, code)), (label, code))
    out = set()
    for a in filter(anchors, best):
        label, code = best[a]
        score = {i: sum(p * q for p, q in zip(code, c)) for i, (_, c) in best.items() if i != a and len(c) == len(code)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            close = [i for i in order if best[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(close)}
    return out


@pytest.mark.parametrize("rows_per_block, anchors_per_block", [(8192, 4096), (37, 11)])
def test_negatives_against_all_pairs(spark, monkeypatch, rows_per_block, anchors_per_block):
    monkeypatch.setattr(negatives, "ROWS", rows_per_block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_per_block)
    rows = some_vectors() + [(None, [1.0] * 6, 1), (1500, [0.3] * 6, None), (1600, [0.5] * 4, 1), (1601, [0.4] * 4, 1), (1602, [0.4] * 4, 2), (-40, [0.2] * 6, 3)]
    rows += [rows[20], (20, rows[21][1], 3)] + [(2000 + i, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], i % 3) for i in range(60)]  # repeats, a shared id, many ties
    got = negatives.hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0).collect()
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 200
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_negatives_without_rows(spark):
    assert negatives.hard_negatives(vectors(spark, []).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(20, [1.0], 1), (3, [1.0], 2)]), F.col("vec_id") % 20 == 0).count() == 0


def test_keys_sort_as_packed():
    rng = random.Random(4)
    parts = [(rng.choice([-5, 0, 7, 2**62]), rng.choice([-(2**62), -1, 0, 1, 2**62]), rng.choice([0, 1]), rng.choice([-9, 3, 10**15])) for _ in range(300)]
    a, s, k, i = (np.array(c, np.int64) for c in zip(*parts))
    keys = negatives.pack_keys(a, s, k, i)
    assert [negatives.unpack_key(x) for x in keys] == parts
    assert [negatives.unpack_key(x) for x in sorted(keys)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2**40]]), np.array([[2**40]]))
    assert negatives.products(np.array([[2**30, 1]]), np.array([[2**30, 1]])).tolist() == [[2**60 + 1]]


# -- 13


DOCS = "doc_id bigint, text string, d bigint, digest string, rows string, row string, batch string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "d", "r", "r", "b", "k") for d, t in rows], DOCS)


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    rows: list[tuple[int | None, str | None]] = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "c", "é x", "é x", None, "", " \n", "long " * 20000])) for i in range(1, 120)]
    return [*rows, (None, "c"), (None, "only here"), (500, "hot"), *[(i, "h\x0b\x0cot") for i in range(200, 400)], rows[3], rows[3]]


def brute_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(d)
    return groups


def key(d):
    return -(2**63) if d is None else d


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_digests_against_groups(spark, batches):
    rows = texts()
    groups = brute_groups(rows)
    got = digests.exact_duplicates(frame(spark, rows).repartition(3), batches=batches).collect()
    want = []
    for text, ids in groups.items():
        keep = min(ids, key=key)
        want += [(d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    order = lambda r: (key(r[0]), r[4])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got], key=order) == sorted(want, key=order)


def test_index_lives_on_and_takes_only_new_texts(spark, tmp_path):
    rows = texts()
    index = digests.DigestIndex.open(spark, f"file://{tmp_path}/index", buckets=3)
    first = digests.only_new(frame(spark, rows[:60]), index).collect()
    assert sorted(map(len, map(tuple, first))) == [8] * len(brute_groups(rows[:60]))
    for part in ("known", "more"):  # what an earlier session left
        spark.sql(f"DROP TABLE {index._name(part)}")
    again = digests.DigestIndex.open(spark, f"file://{tmp_path}/index")
    assert again.buckets == 3 and again.next_batch() == 1
    with pytest.raises(ValueError):
        digests.DigestIndex.open(spark, f"file://{tmp_path}/index", buckets=4)
    later = digests.only_new(frame(spark, rows[60:]), again).collect()
    new = set(brute_groups(rows[60:])) - set(brute_groups(rows[:60]))
    assert sorted(re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in later) == sorted(new)
    size = lambda: {bytes(r.digest): r.rows for r in again.groups().collect()}
    counts = size()
    assert sum(counts.values()) == len(rows)
    again.add(digests.fingerprints(frame(spark, rows[60:])), 1)  # the same batch again
    assert size() == counts
    plan = again.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_digests_of_nothing(spark):
    assert digests.exact_duplicates(frame(spark, []).limit(0)).count() == 0
    [r] = digests.exact_duplicates(frame(spark, [(None, None)])).collect()
    assert (r.doc_id, r.keep_id, r.group_size, r.kept) == (None, None, 1, True)
