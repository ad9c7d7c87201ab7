import math
from fractions import Fraction

import numpy as np
import pytest

from raresift.llm import whitening
from raresift.llm.queries import QUERIES


def exact(vectors):
    """Covariance of the scaled vectors in fractions, by its definition."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return x, mean, [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def check(rows, ids, vectors, most=32):
    x, mean, cov = exact(vectors)
    n, d = len(x), len(mean)
    v = np.array([[float(c) for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((values > 1e-10 * values[0]).sum()))
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and all(sorted(c) == list(range(1, k + 1)) for c in by_id.values())
    z = np.array([[by_id[i][c].whitened for c in range(1, k + 1)] for i in ids])
    centred = np.array([[float(c - m) for c, m in zip(r, mean)] for r in x])
    # whitened = centred @ w, w = unit eigenvectors over roots
    w = np.linalg.lstsq(centred, z, rcond=None)[0] if n > d else None
    for i, row in zip(ids, x):
        r = by_id[i][1]
        assert r.n == n and int(r.deviation) == sum((n * c - n * m) ** 2 for c, m in zip(row, mean))
    for c in range(1, k + 1):
        assert by_id[ids[0]][c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
    if w is not None:
        units = w * np.sqrt(values[:k])
        assert np.abs(v @ units - units * values[:k]).max() < 1e-6 * values[0]
        assert np.abs(np.linalg.norm(units, axis=0) - 1).max() < 1e-6
    error = np.abs(z.T @ z / n - np.outer(z.mean(axis=0), z.mean(axis=0)) - np.eye(k)).max()
    assert error < 1e-6 and by_id[ids[0]][1].identity_error == pytest.approx(error, abs=1e-9)


def test_polarisation_is_the_covariance(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    found = whitening.fit(whitening.usable(df, "vec_id", "embedding"))
    x, mean, cov = exact(vectors)
    n = len(x)
    assert found.n == n and found.sums == [sum(r[i] for r in x) for i in range(6)]
    assert [[Fraction(m, n * n) for m in row] for row in found.moments] == cov
    check(whitening.whiten(df).collect(), list(range(300)), vectors)
    check(whitening.whiten(df, most=2).collect(), list(range(300)), vectors, 2)


def test_numbers_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(40, 3)) * 1e9).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), list(range(40)), vectors)
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(spark.createDataFrame([(1, [1e15])], "vec_id long, embedding array<double>"))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [3.0, -1.0], 0), (3, [0.5, 0.25], 0), (4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [1.0, -inf], 0), (8, [], 0),
            (3, [0.5, 0.25], 0), (None, [0.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    out = whitening.whiten(df).collect()
    assert len(out) == 10 and {r.n for r in out} == {5} and {r.vec_id for r in out} == {1, 2, 3, None}
    assert whitening.whiten(df.filter("embedding is null")).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id = 3").select("vec_id", "embedding")).collect() == []  # no variance
    flat = spark.createDataFrame([(i, [float(i), 5.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}  # dimensions 1 and 3 go together, 2 never moves
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op13_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
