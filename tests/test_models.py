"""Learning smoke tests: every base model on a planted rule, saved and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raresift import config
from raresift.operators import metrics, search, voting
from raresift.plans import experiment
from raresift.sources import model_store
from raresift.sources.storage import materialize

NAMES = ["V1", "V2", "V3", "Log_Amount"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] > 1.8).astype(int)
    rows = [(f"r{i}", *map(float, x[i]), int(y[i])) for i in range(600)]
    return materialize(spark.createDataFrame(rows, "row_id string, V1 double, V2 double, V3 double, Log_Amount double, Class int"))


PARAMS = {"MLPClassifier": {"max_iter": 60, "hidden_layer_sizes": (8,)}, "KNeighborsClassifier": {"n_neighbors": 5, "weights": "distance"},
          "AdaBoostClassifier": {"n_estimators": 6}, "RUSBoostClassifier": {"n_estimators": 4}}


@pytest.mark.parametrize("name", [*config.BASE_MODELS, "LogisticRegression"])
def test_learns_saves_and_reads_back(spark, planted, name, tmp_path):
    fitted = search.fit_model(planted, name, PARAMS.get(name, {"n_estimators": 6, "gamma": 0.3, "C": 10.0}), NAMES)
    auc = lambda m: metrics.roc_auc(m.score(planted).select(F.lit("m").alias("m"), F.col("Class").alias("y"), "p1"), ["m"]).first()["roc_auc"]
    first = auc(fitted)
    assert first > 0.8
    model_store.save_model(spark, fitted, str(tmp_path / "m"))
    assert abs(auc(model_store.load_model(spark, str(tmp_path / "m"))) - first) < 1e-9


def test_feature_names_keep_their_place(planted):
    steps = search.fit_feature_steps(planted, NAMES, k=2)
    index, names = steps.selected_features()
    assert [NAMES[i] for i in index] == names and set(names) <= {"V1", "V2"}


def test_experiment_rows(spark, planted, tmp_path):
    cfg = experiment.Settings(splits=2, repeats=1, candidates=2, models=["DecisionTreeClassifier", "LogitBoostClassifier"],
                              pools={"one": ["DecisionTreeClassifier", "LogitBoostClassifier"]}, runs=[1], dynamic=["OLA", "DESClustering"],
                              fixed_params={"LogitBoostClassifier": {"n_estimators": 3, "max_depth": 3}})
    out = experiment.run_experiment(planted, NAMES, cfg, str(tmp_path / "res"), "r").collect()
    assert len(out) == 2 + 2 + 2 + 2
    assert {r["split"] for r in out} == {"resubstitution", "test"}
    assert all(r["cv_tuning_std_val_score"] == 0.0 for r in out if r["split"] == "resubstitution")
    with pytest.raises(ValueError, match="not trained"):
        experiment.Settings(models=["SVC"], pools={"x": ["MLPClassifier"]}).check()


def test_registered_jobs_are_whole(monkeypatch):
    """Registered models, searches and experiments use the defaults, no smaller settings."""
    import inspect

    from raresift import config, queries
    from raresift.plans import experiment as plans

    calls = {}

    def caught(name, function):
        def call(*args, **kwargs):
            bound = inspect.signature(function).bind(*args, **kwargs)
            bound.apply_defaults()
            calls[name] = bound.arguments
            raise StopIteration

        return call

    for module, name in ((plans, "run_experiment"), (plans, "benchmark_resamplers"), (queries.search, "halving_search"), (queries.search, "fit_model")):
        monkeypatch.setattr(module, name, caught(name, getattr(module, name)))
    monkeypatch.setattr(queries, "materialize", lambda df, *a: df)
    for name in ("txn_features", "vec_features"):
        monkeypatch.setattr(queries.V, name, lambda s, d: None)
    monkeypatch.setattr(queries, "work_dir", lambda s: "work")
    frame = type("Frame", (), {"where": lambda self, *a: self})()
    monkeypatch.setattr(queries.splits, "holdout", lambda *a: frame)
    monkeypatch.setattr(queries.F, "col", lambda c: True)
    for name, key in (("j3_experiment", "run_experiment"), ("j7_benchmark", "benchmark_resamplers"), ("j7_benchmark_all", "benchmark_resamplers"),
                      ("h2_halving_search", "halving_search"), ("m2_randomforestclassifier", "fit_model"), ("r14_resampled_fit", "fit_model")):
        calls.clear()
        try:
            queries.QUERIES[name](None, "unused")
        except StopIteration:
            pass
        got = calls[key]
        if key == "run_experiment":
            assert got["cfg"] == plans.Settings(runs=[0])  # one whole outer run
        elif key == "benchmark_resamplers":
            assert got["techniques"] is None and got["folds"] == config.BENCHMARK_SPLITS and not got["params"]
        elif key == "halving_search":
            assert got["candidates"] == config.TUNING_CANDIDATES
        else:
            assert got["params"] == {}
