"""Whitening against plain numpy."""

import math
import random

import numpy as np
import pytest

from postlake.llm import whitening


@pytest.mark.parametrize("kind", ["random", "identity", "blocks", "rank", "diagonal", "close", "one"])
def test_leading_components(kind):
    rng = np.random.default_rng(5)
    b = rng.standard_normal((40, 40))
    q = np.linalg.qr(b)[0]
    a = {
        "random": b @ b.T, "identity": np.eye(40) * 3, "blocks": np.kron(np.eye(10), np.ones((4, 4))), "rank": b[:, :3] @ b[:, :3].T,
        "diagonal": np.diag(np.arange(40.0)), "close": q @ np.diag(1 + 1e-9 * np.arange(40)) @ q.T, "one": np.array([[4.0]]),
    }[kind]
    values, vectors = whitening.leading_components(a, 16)
    true = np.linalg.eigvalsh(a)[::-1][:16]
    true = true[true > 1e-12 * true[0]]
    assert len(values) == len(true) and np.allclose(values, true, rtol=1e-12, atol=1e-13 * true[0])
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-11 * true[0])


def test_sturm_counts_count_eigenvalues():
    rng = np.random.default_rng(6)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-5, 5, 101)
    assert (whitening.sturm_counts(d, e, at) == np.searchsorted(values, at)).all()


def brute(data):
    whole = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in data
             if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}), dtype=np.int64)
    n, total = len(fit), fit.sum(axis=0)
    z = (n * fit - total) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        off = [n * a - int(b) for a, b in zip(x, total)]
        out[i] = (n, sum(o * o for o in off), np.array(off) / n @ vectors / np.sqrt(values), values / values.sum())
    return out


def test_whiten_equals_numpy(spark):
    rng = random.Random(7)
    data = [(k, [float(np.float32(rng.gauss(0, 1 + j / 8))) for j in range(20)]) for k in range(300)]
    data += [(1000 + k, list(data[k % 5][1])) for k in range(200)]  # repeated vectors count once
    data += [(2000, None), (2001, [None] + [0.5] * 19), (2002, [math.nan] + [0.5] * 19), (2003, [math.inf] * 20), (2004, [])]
    df = spark.createDataFrame([(*x, "c", 1) for x in data], "vec_id long, embedding array<float>, x string, id int").repartition(5)
    got = whitening.whiten(df).collect()
    want = brute(data)
    assert len(got) == 16 * len(want) and {r["vec_id"] for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"]]
        j = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] / explained[j] - 1) < 1e-10 and r["identity_error"] < 1e-9
        if abs(white[j]) > 1e-3:
            signs.setdefault(j, set()).add(r["whitened"] * white[j] > 0)
        assert abs(abs(r["whitened"]) - abs(white[j])) < 1e-8
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 16


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], kind)).count() == 0
    # two directions with variance of three; another length is left out; a null id keeps its rows
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [0.0, 2.0, 0.0]), (4, [1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [(i, c) for i in ("1", "2", "None") for c in (1, 2)]
    assert {r["n"] for r in got} == {3} and max(r["identity_error"] for r in got) < 1e-9


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [3.0e13]), (2, [-3.0e13]), (3, [0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in got} == {1: True, 2: True, 3: False}
