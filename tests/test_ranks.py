"""Splits and cumulative sums beyond one range per task."""

import hashlib

import pytest

from raresift.functions import ranks
from raresift.operators import splits


def table(spark, n=400):
    return spark.createDataFrame([(f"r{i}", int(i % 7 == 0), i % 3) for i in range(n)], "row_id string, Class int, x int")


def brute_folds(n, k, seed):
    out = {}
    for c in (0, 1):
        rows = sorted((hashlib.md5(f"{seed}|r{i}".encode()).hexdigest(), f"r{i}") for i in range(n) if int(i % 7 == 0) == c)
        for rank, (_, row) in enumerate(rows):
            out[row] = rank * k // len(rows)
    return out


@pytest.mark.parametrize("rows,digits", [(1 << 20, 3), (4, 1), (1, 1), (2, 2)])
def test_ranges_are_split_until_they_are_small(spark, monkeypatch, rows, digits):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    monkeypatch.setattr(ranks, "PREFIX_DIGITS", digits)
    got = {r.row_id: (r.fold_0, r.fold_1) for r in splits.repeated_folds(table(spark), 5, 2, 42).collect()}
    want = (brute_folds(400, 5, 42), brute_folds(400, 5, 43))
    assert got == {i: (want[0][i], want[1][i]) for i in want[0]}


def test_sorted_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 8)
    monkeypatch.setattr(ranks, "PREFIX_DIGITS", 1)
    seen = []
    real = ranks._ranges

    def watch(*args):
        seen.append(real(*args))
        return seen[-1]

    monkeypatch.setattr(ranks, "_ranges", watch)
    splits.stratified_folds(table(spark), 5, 42).collect()
    assert len(seen) > 1 and max(r["_c"] for r in seen[-1].collect()) <= 8


def test_repeats_read_the_table_three_times(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    scans = []
    for repeats in (2, 10):
        df = splits.repeated_folds(spark.read.parquet(str(tmp_path / "t")), 5, repeats, 42)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        scans.append(plan.count("Relation [row_id"))
    assert scans == [2, 2]  # and one for the counts


def test_null_class_is_refused(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 0), ("d", 0)], "row_id string, Class int")
    for split in (lambda: splits.stratified_folds(df, 2, 1), lambda: splits.holdout(df, 0.5, 1)):
        with pytest.raises(Exception, match="the class of row b is null"):
            split().collect()


@pytest.mark.parametrize("rows", [1 << 20, 10])
def test_cumulative_sums(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    data = [("a", float(i * i % 997), i % 4) for i in range(300)] + [("b", 1.0, 5), ("c", -1.0, 1), ("c", 2.0, 2)]
    data = {(g, v): c for g, v, c in data}
    df = spark.createDataFrame([(g, v, c) for (g, v), c in data.items()], "g string, v double, c long")
    written = []
    real = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda d, n="t": written.append(real(d, n)) or written[-1])
    got = {(r.g, r.v): (r.below_c, r.total_c) for r in ranks.ordered_cumsum(df, ["g"], "v", ["c"]).collect()}
    assert got == {(g, v): (sum(c for (h, w), c in data.items() if h == g and w < v), sum(c for (h, _), c in data.items() if h == g)) for g, v in data}
    if rows == 10:
        assert max(r["count"] for r in written[-1].groupBy("_b").count().collect()) <= 20
    assert ranks.ordered_cumsum(df.limit(0), ["g"], "v", ["c"]).collect() == []
