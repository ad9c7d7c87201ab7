"""The neighbour join at its limits: bad values, byte limits, and every path on data far beyond its constants."""

import numpy as np
import pyarrow as pa
import pytest

from raresift.operators import neighbors, resample

FEATURES = ["a", "b", "c"]


def table(spark, n, seed=0, bad=0.0, parts=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    rows = [(f"{seed}-{i:05d}", *map(float, x[i]), int(i % 5 == 0)) for i in range(n)]
    if bad != 0.0:
        rows[5] = (rows[5][0], bad, *rows[5][2:])
    return spark.createDataFrame(rows, "row_id string, a double, b double, c double, Class int").repartition(parts)


def brute(q, d, k, exclude_self=False, p=2):
    x, y = ([(r.row_id, np.array([r.a, r.b, r.c])) for r in df.collect()] for df in (q, d))
    out = {}
    for i, v in x:
        pairs = []
        for j, w in y:
            if not (exclude_self and i == j):
                dist = 0.0
                for u, t in zip(v, w):
                    dist += (u - t) ** 2 if p == 2 else abs(u - t)
                pairs.append((dist, j))
        out[i] = [j for _, j in sorted(pairs)[:k]]
    return out


def found(df, name="neighbours"):
    return {r.row_id: [e.id for e in r[name]] for r in df.select("row_id", name).collect()}


PATHS = {"broadcast": {}, "few queries": {"broadcast_rows": 60}, "blocks": {"broadcast_rows": 0, "block_rows": 32}}


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("value", [float("nan"), None, float("inf")])
@pytest.mark.parametrize("side", ["data", "queries"])
def test_bad_values_are_refused(spark, path, value, side):
    q = table(spark, 50, 1, value if side == "queries" else 0.0)
    d = table(spark, 200, 2, value if side == "data" else 0.0)
    with pytest.raises(Exception, match=r"feature a of row .-00005 is not a finite number"):
        neighbors.with_neighbours(q, d, 3, FEATURES, **PATHS[path]).collect()
    with pytest.raises(Exception, match="is not a finite number"):
        neighbors.with_class_neighbours(q, d, 3, FEATURES, **PATHS[path]).collect()


def test_bad_values_are_refused_by_resamplers(spark):
    bad = table(spark, 100, 3, float("nan"))
    for step in (resample.smote, resample.tomek):
        with pytest.raises(Exception, match="is not a finite number"):
            step(bad, FEATURES).collect()


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_two_levels_of_cells(spark, monkeypatch, p, exclude_self):
    """More rows than MAX_CELLS blocks: still exact, and blocks stay local."""
    monkeypatch.setattr(neighbors, "MAX_CELLS", 4)
    d = table(spark, 900, 4)
    q = d.where("row_id < '4-00150'") if exclude_self else table(spark, 150, 5)
    seen = []
    real = neighbors.materialize

    def watch(df, name="t"):
        out = real(df, name)
        if name == "knn-sent":
            seen.append(out)
        return out

    monkeypatch.setattr(neighbors, "materialize", watch)
    got = found(neighbors.with_neighbours(q, d, 4, FEATURES, exclude_self=exclude_self, p=p, broadcast_rows=0, block_rows=16, query_rows=20))
    assert got == brute(q, d, 4, exclude_self, p)
    blocks = 900 / 16
    per_query = seen[0].count() / 150
    assert per_query < 0.6 * blocks  # far from all pairs
    assert seen[0].select("_cell").distinct().count() <= 4 < seen[0].select("_cell", "_block").distinct().count()


def test_reach_has_a_budget(spark, monkeypatch):
    d, q = table(spark, 400, 6), table(spark, 50, 7)
    with pytest.raises(RuntimeError, match="exclude too little"):
        neighbors.with_neighbours(q, d, 4, FEATURES, broadcast_rows=0, block_rows=8, max_reach=1)
    monkeypatch.setattr(neighbors, "MAX_CELLS", 4)
    with pytest.raises(RuntimeError, match="exclude too little"):
        neighbors.with_neighbours(q, d, 4, FEATURES, broadcast_rows=0, block_rows=8, max_reach=1)


def test_few_queries_use_growing_samples(spark, monkeypatch):
    """Bounds from samples: exact, and the last pass hands on far fewer rows than every task's k best."""
    monkeypatch.setattr(neighbors, "FEW_SAMPLE", 64)
    monkeypatch.setattr(neighbors, "FEW_STEP", 4)
    d, q = table(spark, 4000, 8, parts=8), table(spark, 30, 9)
    handed = []
    real = neighbors._best_of_few

    def watch(*args):
        out = real(*args)
        handed.append((args[-1] is not None, out.count()))
        return out

    monkeypatch.setattr(neighbors, "_best_of_few", watch)
    got = found(neighbors.with_neighbours(q, d, 3, FEATURES, broadcast_rows=100))
    assert got == brute(q, d, 3) and len(handed) == 4 and [b for b, _ in handed] == [False, True, True, True]
    assert all(n <= 30 * 3 * 8 for _, n in handed) and handed[-1][1] < 30 * 3 * 8 * 0.8


def test_broadcast_is_limited_by_bytes(spark, monkeypatch):
    d, q = table(spark, 300, 10), table(spark, 300, 11)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 2000)
    assert neighbors._small_side(d, 10_000) is None and neighbors._small_side(d.limit(10), 10_000).num_rows == 10
    wide = d.limit(10).selectExpr("*", "repeat('x', 5000) as w")
    assert neighbors._small_side(wide, 10_000) is None
    monkeypatch.setattr(neighbors, "_answer_small", None)
    assert found(neighbors.with_neighbours(q, d, 2, FEATURES, block_rows=64)) == brute(q, d, 2)


def test_bound_is_the_far_corner():
    rng = np.random.default_rng(1)
    d = rng.normal(size=(3, 500))
    tree = neighbors._Cells(d, 4)
    cell = tree.locate(d)
    lo, hi = np.full((3, 16), np.inf), np.full((3, 16), -np.inf)
    for c in range(16):
        if (cell == c).any():
            lo[:, c], hi[:, c] = d[:, cell == c].min(axis=1), d[:, cell == c].max(axis=1)
    tree.measure(lo, hi, np.bincount(cell, minlength=16), 64)
    q = rng.normal(size=(3, 40))
    for p in (1, 2):
        exact = np.sort(np.array([[(np.abs(q[:, i] - d[:, j]) ** p).sum() for j in range(500)] for i in range(40)]), axis=1)[:, 4]
        assert (tree.bound(q, 5, p) >= exact).all() and np.isfinite(tree.bound(q, 5, p)).all()


def test_classes_share_one_pass(spark):
    """Two small classes: one dealing-out of the query table at most."""
    d, q = table(spark, 200, 12), table(spark, 100, 13)
    plan = neighbors.with_class_neighbours(q, d, 3, FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert isinstance(neighbors._small_side(d, 1000), pa.Table)
