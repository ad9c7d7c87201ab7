"""Restart and clean-up of experiments, k-means at rest, one region search for all selectors."""

import os

import numpy as np
import pytest

from raresift.operators import dynamic, models, neighbors
from raresift.plans import experiment
from raresift.sources import storage


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    rows = [(f"r{i:03d}", *map(float, x[i]), int(x[i, 0] > 0.8)) for i in range(300)]
    return spark.createDataFrame(rows, "row_id string, V1 double, V2 double, Class int")


CFG = dict(scale=[], splits=2, repeats=1, candidates=1, models=["DecisionTreeClassifier", "LogisticRegression"],
           pools={"two": ["DecisionTreeClassifier", "LogisticRegression"]}, dynamic=["KNORAU"], static=[],
           fixed_params={"LogisticRegression": {}})


def test_second_start_goes_on_and_leaves_no_tables(spark, planted, tmp_path, monkeypatch):
    monkeypatch.setattr(experiment, "halving_search", lambda df, name, features, *a, **k: experiment.Search(
        experiment.fit_model(df, name, {}, features), {}, [0.5], [0.5], 0.1))
    monkeypatch.setattr(storage, "work_dir", lambda spark: str(tmp_path / "work"))
    done = []
    real = experiment.run_once
    monkeypatch.setattr(experiment, "run_once", lambda df, f, run, cfg: done.append(run) or real(df, f, run, cfg))
    path = str(tmp_path / "results")
    first = experiment.run_experiment(planted, ["V1", "V2"], experiment.Settings(**CFG, runs=[0]), path, "r").count()
    again = experiment.run_experiment(planted, ["V1", "V2"], experiment.Settings(**CFG), path, "r")
    assert done == [0, 1] and again.count() == 2 * first
    assert again.where("split = 'test' and pool_name = 'BASE_MODEL'").select("score_time").distinct().count() == 4
    left = [f for f in os.listdir(tmp_path / "work") if not f.startswith(".")] if (tmp_path / "work").exists() else []
    assert left == []


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "work_dir", lambda spark: str(tmp_path))
    with storage.scratch(spark):
        storage.materialize(spark.range(3))
        with storage.scratch(spark):
            storage.materialize(spark.range(3))
        assert len([f for f in os.listdir(tmp_path)]) == 1
    assert os.listdir(tmp_path) == []
    assert storage.materialize(spark.range(3)).count() == 3


def brute_kmeans(x, c):
    while True:
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() < 1e-12:
            return new
        c = new


def test_kmeans_rests(spark, planted):
    rows = planted.orderBy("row_id").collect()
    x = np.array([[r.V1, r.V2] for r in rows])
    seeds = planted.where("row_id < 'r005'")
    got = np.array([[r.V1, r.V2] for r in neighbors.lloyd(planted, seeds, ["V1", "V2"]).orderBy("row_id").collect()])
    assert np.allclose(got, brute_kmeans(x, x[:5]), atol=1e-8)
    with pytest.warns(UserWarning, match="still moved"):
        neighbors.lloyd(planted, seeds, ["V1", "V2"], iterations=3)


def test_profile_search_is_not_stacked_on_the_region_search(spark, planted):
    from pyspark.sql import functions as F

    q = planted.withColumn("p", F.array(F.rand(1), F.rand(2)))
    q = storage.materialize(q)
    out = dynamic.dynamic_select(q, q, ["KNORAU", "KNOP", "Exponential"], 2, ["V1", "V2"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one search in feature space, one in decision space
    assert out.count() == 900


def test_stump_is_read_from_the_printed_tree(spark):
    from pyspark.ml.linalg import Vectors

    for flip in (False, True):
        rows = [(f"r{i}", Vectors.dense([0.0, i / 7]), int((i >= 10) != flip)) for i in range(20)]
        m = models.make_base_model("DecisionTreeClassifier", {"max_depth": 1})
        df = spark.createDataFrame(rows, ["row_id", "features", "Class"])
        tree = m.forest(1, False, "_w", 1).setMaxDepth(1).fit(m.weighted(df)).trees[0]
        feature, cut, left, right = models._stump(tree)
        assert feature == 1 and 9 / 7 < cut < 10 / 7 and (left, right) == ((1, 0) if flip else (0, 1))
    rows = [(f"r{i}", Vectors.dense([0.0]), i % 2) for i in range(10)]
    m = models.make_base_model("DecisionTreeClassifier", {"max_depth": 1})
    tree = m.forest(1, False, "_w", 1).setMaxDepth(1).fit(m.weighted(spark.createDataFrame(rows, ["row_id", "features", "Class"]))).trees[0]
    assert models._stump(tree)[1] == float("inf")
