"""Whitening and hard negatives against plain numpy and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.llm.bit_codes import Best, Queries, coded, rotation
from wattsift.llm.hard_negatives import hard_negatives
from wattsift.llm.spectrum import count_above, leading
from wattsift.llm.whitening import RESULTS, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, clash string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def invented(n, size, seed, labels=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size)).astype(np.float32) / np.float32(math.sqrt(size))
    v[n // 2 : n // 2 + n // 5] = v[0]  # copies
    return [(k, v[k].tolist(), int(rng.integers(labels)), "x") for k in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_counts_and_eigenpairs(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 50))
    a = rng.normal(size=(d, d))
    a = a @ a.T - seed % 3 * np.eye(d)
    if seed % 2:  # eigenvalues that agree
        q, _ = np.linalg.qr(a)
        a = q @ np.diag(np.round(rng.random(d) * 3) / 3) @ q.T
    a = (a + a.T) / 2
    a /= np.abs(a).max()
    values = np.linalg.eigvalsh(a)[::-1]
    for shift in (-0.3, 0.1234, 0.77, float(values[0]) * 0.999):
        assert count_above(a, shift) == (values > shift).sum()
    pairs = leading(a.astype(np.longdouble), 4)
    assert np.allclose([e for e, _ in pairs], values[:4], atol=1e-13)
    v = np.array([u for _, u in pairs])
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-12
    assert all(np.abs(a @ u - e * u).max() < 1e-13 for e, u in pairs)


def test_eigenvectors_of_close_eigenvalues_are_exact():
    d = 20
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(d, d)))
    values = np.array([1, 1 - 1e-5, *np.linspace(0.5, 0.1, d - 2)])
    q = q.astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d) - 0.5 * q.T @ q)
    a = q @ np.diag(values.astype(np.longdouble)) @ q.T
    for k, (_, u) in enumerate(leading((a + a.T) / 2, 3)):
        assert min(np.abs(u - q[:, k]).max(), np.abs(u + q[:, k]).max()) < 1e-13


def test_whitening_against_numpy(spark):
    rows = invented(300, 9, 1)
    got = whiten(frame(spark, rows)).orderBy("vec_id", "component").collect()
    x = np.array([[math.floor(256 * c) for c in np.array(r[1], np.float32).astype(float)] for r in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = (fit - sums / n).T @ (fit - sums / n) / n
    e, u = np.linalg.eigh(v)
    for k in range(4):
        mine = [r for r in got if r.component == k + 1]
        w = (x - sums / n) @ u[:, -1 - k] / math.sqrt(e[-1 - k])
        g = np.array([r.whitened for r in mine])
        assert min(np.abs(w - g).max(), np.abs(w + g).max()) < 1e-9
        assert [r.deviation for r in mine] == [int(((n * row - sums) ** 2).sum()) for row in x]
        assert all(abs(r.explained - e[-1 - k] / e.sum()) < 1e-12 and r.n == n for r in mine)
    assert got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), float(k % 3)], None, "x") for k in range(6)]
    bad = [(7, None, 1, "x"), (8, [1.0, None], 1, "x"), (9, [nan, 0.0], 1, "x"), (10, [inf, 0.0], 1, "x"), (None, [0.5, 0.5], 1, None)]
    df = frame(spark, good + good[:2] + bad).withColumn("Component", F.col("clash")).withColumn("n", F.lit("y"))
    got = whiten(df)
    assert set(RESULTS) <= set(got.columns) and len({c.lower() for c in got.columns}) == len(got.columns)
    rows = got.collect()
    assert len(rows) == 9 * 2  # two entries, two components; repeated rows and a NULL id are answered
    assert {r.n for r in rows} == {7}
    empty = whiten(frame(spark, bad[:4]))
    assert set(RESULTS) <= set(empty.columns) and empty.count() == 0
    assert whiten(frame(spark, [])).count() == 0
    one = whiten(frame(spark, [(1, [0.5, 0.1], 1, "x"), (2, [0.5, 0.1], 1, "x")])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whiten(frame(spark, [(k, [float(k), 0.0, 0.0], 1, "x") for k in range(4)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat)
    with pytest.raises(ValueError):
        whiten(frame(spark, [(1, [0.5], 1, "x"), (2, [0.5, 0.1], 1, "x")]))


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e30, 2.0], 1, "x"), (2, [-1e30, 5.0], 1, "x"), (3, [4e9, 1e9], 1, "x")]
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 6 and all(math.isfinite(r.whitened) for r in got if r.component == 1)
    assert {r.vec_id: r.deviation for r in got}[1] is None  # beyond a long


@pytest.mark.parametrize("size", (1, 3, 64, 70, 130))
def test_intervals_hold_the_score(size):
    rng = np.random.default_rng(size)
    x, q = rng.integers(-300, 300, (200, size)), rng.integers(-300, 300, (40, size))
    x[0], q[0], x[1] = 0, 0, 5
    turn = rotation(size, 1)
    low, high = Queries(q, turn).intervals(*coded(x, turn))
    scores = q @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    wide = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    assert np.median((high - low)[wide > 0] / wide[wide > 0]) < 0.6  # of at most 2


def test_best_keeps_the_best():
    best = Best(2, 3, np.array([0, 5]))
    best.add(np.array([0, 0, 1, 0]), np.array([4, 9, 4, 4]), np.array([7, 8, 1, 2]))
    best.add(np.array([0, 1, 0]), np.array([4, 6, -1]), np.array([1, 3, 4]))
    lists, scores, ids = best.rows()
    assert list(zip(lists.tolist(), scores.tolist(), ids.tolist())) == [(0, 9, 8), (0, 4, 1), (0, 4, 2), (1, 6, 3)]


def brute(rows, every, positives=5, negatives=3):
    x = {r[0]: [math.floor(256 * float(np.float32(c))) for c in r[1]] for r in rows}
    label = {r[0]: r[2] for r in rows}
    out = []
    for a in sorted(x):
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x[a], x[i])) for i in x if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            inside = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("size, labels, block", ((3, 3, 4 << 20), (64, 2, 2000), (70, 40, 4000)))
def test_hard_negatives_against_brute_force(spark, size, labels, block):
    rows = invented(260, size, size, labels)
    got = hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 4 == 0, block_bytes=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_hard_negatives_edges(spark):
    nan = float("nan")
    rows = invented(60, 4, 9, 2)
    bad = [(100, None, 1, "x"), (200, [nan, 0.0, 0.0, 0.0], 1, "x"), (300, [1.0, None, 0.0, 0.0], 0, "x"), (None, [1.0] * 4, 0, "x"), (400, [1.0] * 4, None, "x")]
    df = frame(spark, rows + rows[:9] + bad).withColumn("rank", F.lit("z")).withColumn("id", F.lit(3))
    got = hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)
    assert hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives(frame(spark, bad), F.lit(True)).count() == 0
    assert hard_negatives(frame(spark, rows), F.lit(False)).count() == 0
    alone = [(k, v, k, c) for k, v, _, c in rows]  # no row has another of its label
    assert hard_negatives(frame(spark, alone), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives(frame(spark, [(1, [0.5], 1, "x"), (2, [0.5, 0.1], 1, "x")]), F.lit(True))
