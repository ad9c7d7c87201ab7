"""Hand-made cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift.functions.ranks import replicate
from raresift.operators import dynamic, features, metrics, models, neighbors, profile, resample, search, splits, voting
from raresift.sources import tables


def scored(spark, pairs, model="m"):
    return spark.createDataFrame([(model, float(p), int(y), int(p > 0.5)) for p, y in pairs], "model string, p1 double, y int, pred int")


def test_ranking_metrics(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    r = metrics.metrics(df, ["model"]).first()
    assert r["roc_auc"] == 0.75 and round(r["average_precision"], 4) == 0.8333


def test_ties_and_single_class(spark):
    tied = metrics.metrics(scored(spark, [(0.5, 0), (0.5, 1), (0.2, 0), (0.9, 1)]), ["model"]).first()
    assert tied["roc_auc"] == 0.875
    single = metrics.metrics(scored(spark, [(0.2, 0), (0.7, 0)]), ["model"]).first()
    assert single["roc_auc"] is None and single["recall"] == 0.0
    certain = metrics.kappa(metrics.confusion(scored(spark, [(0.1, 0), (0.2, 0)]), ["model"])).first()
    assert certain["kappa"] is None


def test_fpr_compat(spark):
    conf = metrics.confusion(scored(spark, [(0.9, 0), (0.1, 0), (0.2, 0), (0.8, 1)]), ["model"])
    assert round(metrics.rates(conf).first()["fpr"], 6) == 0.333333
    assert round(metrics.rates(conf, fpr_compat=True).first()["fpr"], 6) == round(1 / (1 + 2 / 3), 6)


def test_voting_weights_without_score(spark):
    df = scored(spark, [(0.1, 1), (0.2, 0)]).withColumns({"clf": F.col("model"), "clf_idx": F.lit(0)})
    both = df.unionByName(df.withColumns({"clf": F.lit("n"), "clf_idx": F.lit(1)}))
    assert [r["weight"] for r in metrics.voting_weights(both).collect()] == [0.5, 0.5]
    assert [r["weight"] for r in metrics.voting_weights(both, "no_such_metric").collect()] == [0.5, 0.5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, Class int")
    r = profile.removal_report(df, df, "x").first()
    assert (r["n_removed"], r["pct"]) == (0, 0.0)
    assert profile.class_distribution(df).count() == 0


def test_sparse_rows_keep_exactly_half(spark):
    df = spark.createDataFrame([(1.0, None, None, 1.0), (None, None, float("nan"), 1.0), (1.0, 1.0, 1.0, 1.0)],
                               "a double, b double, c double, d double")
    assert profile.drop_sparse_rows(df).count() == 2


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 1), (2.0, 1), (2.0, 1), (3.0, 0)], "a double, Class int")
    assert profile.duplicate_rows(df).count() == 5
    assert profile.duplicate_patterns(df).count() == 1
    assert profile.duplicate_count(df).first()["n_duplicates"] == 3


def test_replicate_large_count(spark):
    out = replicate(spark.createDataFrame([("a", 10000), ("b", 0), ("c", 3)], "k string, n long"), F.col("n"), chunk=256)
    rows = {r["k"]: (r["n"], r["m"]) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()}
    assert rows == {"a": (10000, 9999), "c": (3, 2)}


def test_log_amount_range(spark):
    ok = features.log_amount(spark.createDataFrame([(0.0,), (-0.5,), (None,)], "Amount double")).collect()
    assert [r["Log_Amount"] for r in ok[:1]] == [0.0] and ok[2]["Log_Amount"] is None
    with pytest.raises(Exception, match="above -1"):
        features.log_amount(spark.createDataFrame([(-1.0,)], "Amount double")).collect()


def table(spark, n=400, dims=3, seed=0, rare=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)) * 3)
    x[: n // 3] = x[0]
    y = (rng.random(n) < rare).astype(int)
    rows = [(f"r{i:04d}", *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, " + ", ".join(f"V{j} double" for j in range(dims)) + ", Class int"), rows


def brute(queries, data, k, dims, own, p):
    out = {}
    for q in queries:
        cand = []
        for d in data:
            if own and d[0] == q[0]:
                continue
            diff = [q[1 + i] - d[1 + i] for i in range(dims)]
            cand.append((sum(v * v if p == 2 else abs(v) for v in diff), d[0]))
        out[q[0]] = [i for _, i in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("own,p,limits", [
    (True, 2, {}), (True, 2, {"broadcast_rows": 0, "block_rows": 16, "query_rows": 8}),
    (False, 1, {"broadcast_rows": 0, "block_rows": 16, "query_rows": 8}), (True, 1, {"broadcast_rows": 100})])
def test_neighbours_equal_brute_force(spark, own, p, limits):
    """A third of the rows are copies of one point; every path gives the same neighbours."""
    df, rows = table(spark)
    few = limits.get("broadcast_rows") == 100
    queries = rows[:60] if few else rows
    q = df.where(F.col("row_id") < "r0060") if few else df
    got = neighbors.with_neighbours(q, df, 5, ["V0", "V1", "V2"], exclude_self=own, p=p, name="n", **limits)
    found = {r["row_id"]: [e["id"] for e in r["n"]] for r in got.collect()}
    assert found == brute(queries, rows, 5, 3, own, p)


def test_neighbours_do_not_depend_on_partitioning(spark):
    df, _ = table(spark)
    both = [neighbors.knn_join(df.repartition(n), df.repartition(n + 1), 4, ["V0", "V1", "V2"], exclude_self=True).orderBy("q", "rank").collect()
            for n in (1, 17)]
    assert both[0] == both[1]


def test_fewer_rows_than_neighbours(spark):
    df, _ = table(spark, n=6)
    for limits in ({}, {"broadcast_rows": 0, "block_rows": 2}):
        sizes = neighbors.with_neighbours(df, df, 9, ["V0"], exclude_self=True, name="n", **limits).select(F.size("n").alias("s")).collect()
        assert {r["s"] for r in sizes} == {5}


def test_enn_and_tomek_equal_brute_force(spark):
    df, rows = table(spark, seed=3)
    names = ["V0", "V1", "V2"]
    label = {r[0]: r[-1] for r in rows}
    near = brute(rows, rows, 3, 3, True, 2)
    kept = {r[0] for r in rows if label[r[0]] == 1 or all(label[i] == 0 for i in near[r[0]])}
    limits = {"broadcast_rows": 0, "block_rows": 32}
    assert {r["row_id"] for r in resample.enn(df, names, **limits).collect()} == kept
    one = {q: ids[0] for q, ids in near.items()}
    links = {(a, b) for a, b in one.items() if label[a] == 1 and label[b] == 0 and one[b] == a}
    assert {(r[0], r[1]) for r in resample.tomek_links(df, names, **limits).collect()} == links


def test_folds_are_exact_and_stable(spark):
    df, rows = table(spark, n=503)
    out = [splits.stratified_folds(df.repartition(n), 10, 1).select("row_id", "Class", "fold").orderBy("row_id").collect() for n in (1, 17)]
    assert out[0] == out[1]
    sizes = {}
    for r in out[0]:
        sizes.setdefault(r["Class"], [0] * 10)[r["fold"]] += 1
    assert all(max(s) - min(s) <= 1 for s in sizes.values())


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([(str(i), 1) for i in range(3)], "row_id string, Class int")
    assert sorted(r["fold"] for r in splits.stratified_folds(df, 5, 1).collect()) == [0, 1, 2]


def test_rungs_are_nested(spark):
    df, _ = table(spark)
    ids = [{r["row_id"] for r in splits.resource_rung(df, s, 9).collect()} for s in (0.2, 0.6, 1.0)]
    assert ids[0] < ids[1] < ids[2] and len(ids[2]) == 400


def test_under_sampling(spark):
    df, rows = table(spark)
    rare = sum(r[-1] for r in rows)
    out = resample.under_sample(df, ["V0"], 0.5)
    assert out.where("Class = 0").count() == 2 * rare and out.where("Class = 1").count() == rare
    with pytest.raises(ValueError, match="needs"):
        resample.under_sample(df, ["V0"], 0.01)


def test_smote_points_lie_between_rows(spark):
    df, rows = table(spark)
    names = ["V0", "V1", "V2"]
    out = resample.smote(df, names).collect()
    assert sum(r["Class"] for r in out) * 2 == len(out)
    lo, hi = ([f(r[1 + i] for r in rows if r[-1] == 1) for i in range(3)] for f in (min, max))
    for r in out:
        if r["origin"] == "synthetic":
            assert all(lo[i] <= r[n] <= hi[i] for i, n in enumerate(names))
    assert out and len({r["row_id"] for r in out}) == len(out)


def test_unknown_names(spark):
    for call in (lambda: resample.resampler("x"), lambda: models.make_base_model("x"), lambda: search.space_of("x"),
                 lambda: voting.static_vote("x", None), lambda: dynamic.with_weights(None, ["x"]),
                 lambda: voting.select_pool(None, ["a"], ["b"])):
        with pytest.raises(ValueError):
            call()


def region(spark, hits, query=None, y=None):
    """A query with neighbours on which each classifier is right or wrong as given (rows: classifiers)."""
    k, size = len(hits[0]), len(hits)
    y = y or [i % 2 for i in range(k)]
    near = [{"dist": float(i + 1), "id": str(i), "y": y[i], "p": [0.9 if (hits[j][i] == 1) == (y[i] == 1) else 0.2 for j in range(size)]}
            for i in range(k)]
    element = "array<struct<dist: double, id: string, y: int, p: array<double>>>"
    query = query or [0.9, 0.1, 0.8, 0.3][:size]
    return spark.createDataFrame([("q", 1, query, near, near, near)],
                                 f"row_id string, Class int, p array<double>, even {element}, plain {element}, profile {element}")


HITS = [[1, 1, 1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 1], [1, 1, 1, 0, 0, 0, 1, 0]]


def weights(spark, name, hits=HITS, **kw):
    return dynamic.with_weights(region(spark, hits, **kw), [name]).first()[f"weights_{name}"]


def test_selectors_on_known_patterns(spark):
    assert weights(spark, "OLA") == [1.0, 0.0, 0.0, 0.0]
    assert weights(spark, "KNORAE") == [1.0, 0.0, 0.0, 0.0]
    assert weights(spark, "KNORAU") == [8.0, 0.0, 2.0, 4.0]
    assert weights(spark, "DESP") == [1.0, 0.0, 0.0, 0.0]
    assert weights(spark, "KNORAE", HITS[1:]) == [0.0, 0.0, 1.0]


def test_nobody_qualifies(spark):
    wrong = [[0] * 8, [0] * 8]
    for name in dynamic.SELECTORS:
        w = weights(spark, name, wrong)
        assert sum(w) > 0
        if name in ("KNORAE", "KNORAU", "DESP", "RRC", "DESKL"):
            assert w == [1.0, 1.0]


def test_region_of_one_class_is_not_pruned(spark):
    assert weights(spark, "KNORAU", [[0] * 8, [1] + [0] * 7], y=[0] * 8) == [0.0, 1.0]


def test_agreement_is_answered_with_the_mean(spark):
    df = spark.createDataFrame([("a", [0.9, 0.7]), ("b", [0.9, 0.1])], "row_id string, p array<double>")
    easy, hard = dynamic.split_agreement(df)
    assert [(r["row_id"], round(r["p1"], 6), r["pred"]) for r in easy.collect()] == [("a", 0.8, 1)]
    assert [r["row_id"] for r in hard.collect()] == ["b"]


def test_selection_sizes():
    assert [dynamic.sizes_of(n) for n in (4, 5, 8)] == [(2, 2), (2, 2), (4, 3)]


def test_beta_table():
    t = dynamic.beta_table()
    assert t[0] == 0 and t[500] == 0.5 and t[1000] == 1 and all(a <= b for a, b in zip(t, t[1:]))
    rng = np.random.default_rng(0)
    assert abs((rng.beta(0.5, 1.5, 400000) > rng.beta(1.5, 0.5, 400000)).mean() - t[250]) < 0.003


def test_rung_plan():
    assert search.rung_plan(30, 3, 0.2) == [(30, 0.2), (10, 0.6000000000000001)]
    drawn = search.draw(search.SPACES["XGBClassifier"], 50, 1)
    assert all(3 <= d["max_depth"] < 10 and 0.6 <= d["subsample"] <= 1.0 and 0.01 <= d["learning_rate"] <= 0.3 for d in drawn)
    assert drawn == search.draw(search.SPACES["XGBClassifier"], 50, 1)


def test_csv_tokens_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,0.5\n?,NA,2\n3,y,nan\n")
    df = tables.load_csv(spark, str(tmp_path / "a.csv"), na_values="?")
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "double"}
    assert df.where("a is null or b is null").count() == 1 and df.where("c is null").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.require_columns(df, ["z"])


def test_csv_float_format(spark, tmp_path):
    df = spark.createDataFrame([(1.23456, "a"), (None, "b")], "x double, k string")
    tables.save_csv(df, str(tmp_path / "o"), float_format="%.2f")
    rows = spark.read.option("header", True).csv(str(tmp_path / "o")).orderBy("k").collect()
    assert [r["x"] for r in rows] == ["1.23", None]


def test_cluster_centroids_keep_count(spark):
    df, rows = table(spark)
    out = resample.cluster_centroids(df, ["V0", "V1", "V2"], iterations=3).groupBy("origin").count().collect()
    rare = sum(r[-1] for r in rows)
    assert {r["origin"]: r["count"] for r in out} == {"original": rare, "centroid": rare}


def test_csv_cells_come_back(spark, tmp_path):
    rows = [(1, 'x "y" z'), (2, "two\nlines"), (3, "a,b"), (4, 'end"'), (5, "back\\"), (6, " pad "), (7, '"\n"'), (8, "plain")]
    df = spark.createDataFrame(rows, "k int, t string")
    tables.save_csv(df, str(tmp_path / "o"))
    assert sorted(map(tuple, tables.load_csv(spark, str(tmp_path / "o")).collect())) == rows
    (tmp_path / "a.csv").write_text('k,t\n1,"x ""y"" z"\n2,"l1\nl2"\n')
    assert [tuple(r) for r in tables.load_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1, 'x "y" z'), (2, "l1\nl2")]
    assert tables._breaks_inside(spark, str(tmp_path / "a.csv"), "utf-8")
    (tmp_path / "b.csv").write_text('k,t\n1,"x ""y"", z"\n')
    assert not tables._breaks_inside(spark, str(tmp_path / "b.csv"), "utf-8")


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_scores_that_are_no_numbers_are_refused(spark, bad):
    df = spark.createDataFrame([("m", 1, 0, 0.2), ("m", 0, 0, 0.1), ("n", 1, 0, bad)], "model string, y int, pred int, p1 double")
    for measure in (metrics.roc_auc, metrics.average_precision, metrics.metrics):
        with pytest.raises(Exception, match="model = n"):
            measure(df, ["model"]).collect()
