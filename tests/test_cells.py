"""The search beyond a broadcast: queries stay in their own cell unless their bound leaves it."""

import numpy as np
import pytest

from raresift.operators import neighbors


@pytest.mark.parametrize("p, exclude_self", [(2, False), (1, True), (2, True)])
def test_only_queries_near_another_cell_are_sent_on(spark, monkeypatch, p, exclude_self):
    """Every query was sent to the blocks of all cells in reach, its own too, and then joined with its lists."""
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(neighbors, "PACK_ROWS", 700)
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 16)
    monkeypatch.setattr(neighbors, "LEAF_QUERIES", 150)
    real, sent = neighbors._packed, []

    def watch(df, place, ends=()):
        sent.append(df)
        return real(df, place, ends)

    monkeypatch.setattr(neighbors, "_packed", watch)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(2000, 2)), 2)
    x[:90] = x[0]  # more copies of a point than are kept
    rows = [(f"r{i:04d}", *map(float, v), i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, n int").repartition(3)
    q, d = (df, df) if exclude_self else (df.where("n < 1200"), df.where("n >= 800"))
    found = neighbors.with_neighbours(q, d, 3, ["a", "b"], payload=["n"], exclude_self=exclude_self, p=p, name="near",
                                      broadcast_rows=0, block_rows=250, query_rows=64)
    assert found.columns == ["row_id", "a", "b", "n", "near"]
    got = {r.row_id: (r.n, [(e.dist, e.id, e.n) for e in r.near]) for r in found.collect()}
    own = [r for r in rows if exclude_self or r[3] >= 800]
    points = np.array([r[1:3] for r in own])
    asked = [r for r in rows if exclude_self or r[3] < 1200]
    assert set(got) == {r[0] for r in asked}
    for r in asked:
        diff = np.abs(points - np.array(r[1:3]))
        dist = np.zeros(len(points))
        for c in range(2):
            dist += diff[:, c] if p == 1 else diff[:, c] * diff[:, c]
        best = sorted((v, o[0], o[3]) for v, o in zip(dist.tolist(), own) if not (exclude_self and o[0] == r[0]))[:3]
        assert got[r[0]] == (r[3], best)
    assert len(sent) == 3 and 0 < sent[2].count() < 0.5 * len(asked)  # data, queries, and those sent on


def test_a_side_too_large_is_not_dealt_out(spark, monkeypatch):
    """To find a side too large for a broadcast, every task handed on as many whole rows as a broadcast holds."""
    monkeypatch.setattr(neighbors, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 48 * 1000)
    df = spark.range(5000).selectExpr("cast(id as string) as row_id", "cast(id as double) as a")
    read, real = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: read.append(1) or real(self))
    assert neighbors._small_side(df, 1 << 20) is None and not read
    assert neighbors._small_side(df.limit(100), 1 << 20).num_rows == 100
