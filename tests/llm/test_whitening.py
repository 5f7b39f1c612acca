"""Whitening against a dense eigenvalue solver."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hazeline.llm import queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, `a.b` string"


def usable(c):
    return c is not None and all(e is not None and math.isfinite(e) for e in c)


def check(got, rows, count=8):
    """``got`` holds what a dense solver finds for ``rows`` (vec_id, vector); vec_id is unique."""
    kept = [(i, c) for i, c in rows if usable(c)]
    x = np.array([[math.floor(1024 * float(np.float32(e))) + 100_000 for e in c] for _, c in kept], object)
    n, d = x.shape
    total = x.sum(axis=0)
    centred = np.array(x, float) - np.array([t / n for t in total])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors.T[::-1][:count]
    k = int((values > 1e-12 * values[0]).sum()) if len(values) else 0
    assert len(got) == n * k
    by_row = {i: r for r, (i, _) in enumerate(kept)}
    table = np.full((n, k), np.nan)
    for r in got:
        at, c = by_row[r["vec_id"]], r["component"] - 1
        table[at, c] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * e - t) ** 2 for e, t in zip(x[at], total, strict=True))
        assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
    for c in range(k):
        gap = min([abs(values[c] - v) for j, v in enumerate(np.linalg.eigvalsh(cov)[::-1]) if j != c], default=1.0)
        if gap > 1e-6 * values[0]:  # else its direction is anyone's choice
            want = centred @ vectors[c] / math.sqrt(values[c])
            sign = np.sign(want @ table[:, c])
            assert np.abs(sign * want - table[:, c]).max() < 1e-7


def run(spark, rows):
    data = [(i, None if c is None else [None if e is None else float(e) for e in c], 1, "a", "b") for i, c in rows]
    return whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()


def test_whole_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, DATA).collect(), rows)


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    rows += [(100, None), (101, [None] * 5), (102, [1.0, float("nan"), 1, 1, 1]), (103, [float("inf")] * 5), (104, rows[0][1])]
    check(run(spark, rows), rows)
    odd = [*rows, (105, []), (106, [1.0] * 7), (107, [1e30] * 5)]  # other lengths, and no long
    got, want = (np.array(sorted(map(tuple, run(spark, r)))) for r in (odd, rows))
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_too_few_deviations(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [] and run(spark, [(1, []), (2, [])]) == []
    assert run(spark, [(i, [1.0, 2.0]) for i in range(4)]) == []  # all equal
    check(run(spark, [(1, [1.0, 2.0, 0.5]), (2, [4.0, 3.0, 1.5])]), [(1, [1.0, 2.0, 0.5]), (2, [4.0, 3.0, 1.5])])


def test_equal_values(spark):
    # Twelve dimensions, values 4, 4, 1 and nine of a hundredth: directions of equal values are free, their number isn't.
    sizes = [4.0, 4.0, 1.0] + [0.1] * 9
    rows = [(2 * i + j, [s if i == k else 0.0 for k in range(12)]) for i, v in enumerate(sizes) for j, s in enumerate((v, -v))]
    check(run(spark, rows), rows)


def test_a_second_sequence_finds_what_the_first_cannot(spark):
    # A wide matrix whose first sequence ends early.
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((4, 40))
    rows = [(i, (rnd.standard_normal(4) @ base).tolist()) for i in range(50)]
    rows = [(i, [round(e * 8) / 8 for e in c]) for i, c in rows]
    check(run(spark, rows), rows)


def test_deviations_beyond_a_long():
    x = np.array([[100_000, 90_000_000_000], [100_000, 100_000]], np.int64)
    n, total = 1000, [100_000_000, 100_000_000]
    assert whitening.deviations(x, n, total).to_pylist() == [None, 0]
    x, n, total = np.array([[4 * 10**6]], np.int64), 759250, [0]
    assert whitening.deviations(x, n, total).to_pylist() == [(n * 4 * 10**6) ** 2 if (n * 4 * 10**6) ** 2 < 1 << 63 else None]
