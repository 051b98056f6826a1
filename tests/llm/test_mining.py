"""Hard negatives against comparing every anchor with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import mining as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=4, positives=5, negatives=10, scale=256):
    """rows(vec_id, embedding, label), one a vec_id."""
    dim = max((len(e) for _, e, _ in rows), default=0)
    ints = {i: [math.floor(scale * float(x)) for x in e] + [0] * (dim - len(e)) for i, e, _ in rows}
    label = {i: x for i, _, x in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b], strict=True))
    out = set()
    for a in ints:
        if a % every:
            continue
        scores = sorted(((-dot(a, b), b) for b in ints if b != a))
        for ps, p in [s for s in scores if label[s[1]] == label[a]][:positives]:
            hard = [(s, b) for s, b in scores if label[b] != label[a] and 30 * -ps <= 100 * -s <= 90 * -ps]
            out |= {(a, p, k, b, -ps, -s) for k, (s, b) in enumerate(hard[:negatives], 1)}
    return out


def got(frame, every=4, **sizes):
    rows = M.hard_negatives(frame, F.col("vec_id") % every == 0, **sizes).collect()
    out = {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows}
    assert len(out) == len(rows)
    return out


def make(n, dim, seed, labels=4, close=0.6):
    r = np.random.default_rng(seed)
    centre = r.normal(size=dim)
    e = (close * centre + r.normal(size=(n, dim))).astype(np.float32)
    e[::7] = e[0]  # one vector stands on many rows
    return [(int(i), e[i].tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 16, 40])
def test_all_pairs(spark, dim):
    rows = make(400, dim, dim)
    want = brute(rows)
    assert want
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("vec", "asks", "g", "part", "salt", "floor", "pos", "r", "n", "q", "score")})
    assert got(frame) == want
    assert got(frame.repartition(5), block=37, anchor_block=13, sample=29) == want


def test_hot_label(spark):
    rows = [(i, e, 0 if i % 10 else 1) for i, e, _ in make(500, 8, 3)]
    assert got(spark.createDataFrame(rows, SCHEMA), block=40, anchor_block=11, sample=16) == brute(rows)


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = make(60, 5, 9)
    bad = [(61, None, 1), (62, [1.0, None, 0.0, 0.0, 0.0], 1), (64, [nan] * 5, 1), (68, [inf, 0.0, 0.0, 0.0, 0.0], 2), (72, [9.0] * 5, None), (None, [9.0] * 5, 1)]
    short = [(76, [2.0, 1.0], 1), (77, [], 2), (80, [], 1)]
    frame = spark.createDataFrame(rows + bad + short + rows[:9], SCHEMA)
    assert got(frame) == brute(rows + short)
    assert M.hard_negatives(frame.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert M.hard_negatives(frame, F.lit(False)).count() == 0
    assert M.hard_negatives(frame, F.lit(None).cast("boolean")).count() == 0
    assert got(spark.createDataFrame([(0, [1.0], 1), (4, [1.0], 1)], SCHEMA)) == set()
    # of two rows of one vec_id the one with the least label counts
    twice = spark.createDataFrame(rows + [(4, [50.0] * 5, 9)], SCHEMA)
    assert got(twice) == brute(rows)


def test_large_components(spark):
    """Products beyond 2**53 are exact."""
    rows = [(i, np.array([x * 1e6 for x in e], np.float32).tolist(), k) for i, e, k in make(60, 4, 2)]
    want = brute(rows)
    assert 2**53 < max(abs(s) for *_, s in want) < 2**63
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_bounds_keep_and_drop():
    """Nothing within the range is lost, and along strong directions most pairs go before the last step."""
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(3000, 32)) * np.exp(-np.arange(32) / 3)) @ np.eye(32)
    basis = M.rotation(x[:500])
    assert np.allclose(basis.T @ basis, np.eye(32))
    a, v = M.Rotated(x[:50], basis), M.Rotated(x, basis)
    s = x[:50] @ x.T
    least, most = np.percentile(s, 97, axis=1), np.percentile(s, 99, axis=1)
    i, j, score = M.scored(a, v, np.ones(s.shape, bool), least, most, True)
    want = (s >= least[:, None]) & (s <= most[:, None])
    near = (s >= least[:, None] - 1) & (s <= most[:, None] + 1)
    mask = np.zeros(s.shape, bool)
    mask[i, j] = True
    assert (mask | ~want).all() and (near | ~mask).all() and (score == s[i, j]).all()
    part = a.turned[:, :8] @ v.turned[:, :8].T
    reach = a.left[8][:, None] * v.left[8][None]
    assert ((part + reach >= least[:, None]) & (part - reach <= most[:, None])).mean() < 0.3
