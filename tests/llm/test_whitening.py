"""Whitening against numpy's eigenvectors and Python's whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, `a.b` string"


def plain_fit(vectors):
    """(distinct grid vectors, eigenvalues descending, eigenvectors) by numpy."""
    x = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    m = np.array(x, float)
    centred = m - m.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return x, e[::-1], v[:, ::-1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(k, [rng.gauss(0, 1 / (1 + j)) for j in range(20)], k % 3, "clash", "odd") for k in range(700)]
    out += [(1000 + k, out[0][1], 0, "clash", "odd") for k in range(300)]  # a hot vector
    out += [(5, out[5][1], 0, "clash", "odd"), (None, out[6][1], 0, "clash", "odd")]
    bad = [None, [], [None] * 20, [1.0] * 19 + [float("nan")], [1.0] * 19 + [float("inf")], [1.0] * 19, [0.5] * 21, [0.1] * 19 + [None]]
    return out + [(2000 + k, v, 0, "clash", "odd") for k, v in enumerate(bad)]


def test_against_numpy(spark, rows, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 64)
    monkeypatch.setattr(W, "FAN_IN", 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    model = W.fit(df)
    fine = [r for r in rows if r[0] is None or r[0] < 2000]
    x, e, v = plain_fit([r[1] for r in fine])
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert model.n == n and model.sums.tolist() == sums and model.components.shape == (20, 16)
    assert np.allclose(model.variances, e[:16], rtol=1e-9) and math.isclose(model.trace, e.sum(), rel_tol=1e-12)
    assert np.allclose(np.abs((model.components * v[:, :16]).sum(0)), 1, atol=1e-7) and model.identity_error < 1e-10
    out = W.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "label", "n", "a.b", "whitened", "deviation"]
    got = out.collect()
    assert sorted((r.vec_id or -1 for r in got)) == sorted(r[0] or -1 for r in fine) and {(r.n, r["a.b"]) for r in got} == {("clash", "odd")}
    for r in got[::37]:
        g = [math.floor(64 * c) + 1_000_000 for c in r.embedding]
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(g, sums, strict=True))
        assert np.allclose(r.whitened, (np.array(g) - np.array(sums) / n) @ model.components / np.sqrt(model.variances), atol=1e-8)
    long = W.components(out.drop("n"), model)
    each = long.collect()
    assert len(each) == 16 * len(got) and {r.component for r in each} == set(range(1, 17)) and {r.n for r in each} == {n}
    assert all(math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9) for r in each[:200])


def test_rank_and_small_inputs(spark):
    make = lambda vs: spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "vec_id long, embedding array<double>")
    flat = make([[float(k % 5), 2.0 * (k % 5), 7.0] for k in range(40)])
    model = W.fit(flat)
    assert model.n == 5 and np.count_nonzero(model.variances) == 1 and model.identity_error < 1e-12
    assert all(r.whitened[0] is not None and r.whitened[1] is None and r.whitened[2] is None for r in W.whiten(flat, model).collect())
    one = make([[1.0, 2.0]] * 3)
    model = W.fit(one)
    assert model.n == 1 and {tuple(r.whitened) for r in W.whiten(one, model).collect()} == {(None, None)} and model.identity_error is None
    assert [r.explained for r in W.components(W.whiten(one, model), model).collect()] == [None] * 6
    for none in (make([[1.0]]).where("vec_id < 0"), make([None, [], [float("nan")]])):
        model = W.fit(none)
        assert W.components(W.whiten(none, model), model).count() == 0
    huge = make([[1e308, -1e308], [0.0, 1.0], [3e15, 2.0]])
    got = W.whiten(huge, W.fit(huge)).collect()
    assert len(got) == 3 and all(r.deviation is None or r.deviation >= 0 for r in got)


def test_longs_are_exact_beyond_floats():
    model = W.Whitening(3, np.array([3 * (1 << 60) + 1, 5], dtype=object), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1 << 60, 1], [(1 << 60) - 1, 2]], np.int64)
    assert model.deviations(x) == [1 + 4, 16 + 1]
    assert W.grid(np.array([-0.001, 0.0, 1 / 64, 1e300])).tolist() == [999_999, 1_000_000, 1_000_001, (1 << 60) + 1_000_000]


@pytest.mark.parametrize("width", [1, 2, 3, 8, 33])
def test_rotations_keep_small_values(width):
    rng = np.random.default_rng(width)
    a = rng.normal(size=(width, width)) * np.logspace(0, -9, width)
    lengths, turns = W.rotated(np.linalg.qr(a, mode="r"))
    assert np.allclose(lengths, np.linalg.svd(a, compute_uv=False), rtol=1e-6) and np.allclose(turns.T @ turns, np.eye(width), atol=1e-13)
    assert np.allclose(np.abs(a @ turns).max(0) > 0, lengths > 0)


def test_ties_and_zero_columns():
    lengths, turns = W.rotated(np.zeros((3, 3)))
    assert lengths.tolist() == [0, 0, 0] and np.allclose(turns, np.eye(3))
    lengths, _ = W.rotated(np.vstack([np.eye(4)] * 2))
    assert np.allclose(lengths, math.sqrt(2))


def test_all_rows_pass_once(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.whiten(df.withColumn("deviation", F.lit("old")), W.fit(df))
    assert out.columns[-2:] == ["whitened", "deviation"] and out.columns.count("deviation") == 1
