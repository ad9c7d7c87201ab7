"""Inputs that once gave wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from raresift.functions.hashing import with_row_id
from raresift.operators import dynamic, features, models, search
from raresift.sources import tables


def test_perfect_separator_is_the_best_feature(spark):
    rows = [(float(i % 2), float(i), 7.1, float((i * 37) % 11), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "V1 double, V2 double, V3 double, V4 double, Class int")
    f = {r.feature: r.f for r in features.anova_f(df, ["V1", "V2", "V3", "V4"]).collect()}
    assert f["V1"] == math.inf and f["V3"] is None and 0 <= f["V2"] < math.inf
    assert [r.feature for r in features.k_best(df, ["V3", "V2", "V1"], 1).collect()] == ["V1"]


def test_missing_values_do_not_count(spark):
    rows = [(float(i % 5), i % 2) for i in range(30)]
    full = spark.createDataFrame(rows, "x double, Class int")
    holes = full.unionByName(spark.createDataFrame([(None, 0)] * 20 + [(None, 1)] * 3, "x double, Class int"))
    assert features.anova_f(full, ["x"]).first().f == pytest.approx(features.anova_f(holes, ["x"]).first().f)


def test_row_ids_differ_for_different_rows(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("-", "x"), ("", "ab"), ("a", "b"), ("1:a", ""), ("", "1:a")]
    ids = [r.row_id for r in with_row_id(spark.createDataFrame(rows, "p string, q string")).collect()]
    assert len(set(ids)) == len(rows)


def test_long_integers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b,c,d\n9007199254740993123,1,99999999999999999999999,1.5\n-9007199254740993124,2,-1,2\n")
    df = tables.load_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "bigint", "c": "decimal(38,0)", "d": "double"}
    assert [r.a for r in df.orderBy("a").collect()] == [-9007199254740993124, 9007199254740993123]
    assert int(df.agg(F.max("c")).first()[0]) == 99999999999999999999999


def test_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(1, f, s, "m", 0.5) for f in (1, 2) for s in ("test", "resubstitution")], "iteration int, fold int, split string, model string, f1 double")
    assert tables.finished_runs(spark, path, "r") == set()
    for _ in range(2):
        tables.append_results(rows, path, "r")
    tables.append_results(rows.where("fold = 1").withColumn("f1", F.lit(0.7)), path, "r")
    tables.append_results(rows.where("fold = 1"), path, "other")
    tables.append_results(rows.where("split = 'test'").withColumn("fold", F.lit(3)), path, "r")
    got = sorted((r.run_id, r.fold, r.split, r.f1) for r in spark.read.parquet(path).collect())
    assert [x for x in got if x[0] == "r" and x[1] < 3] == [("r", 1, "resubstitution", 0.7), ("r", 1, "test", 0.7), ("r", 2, "resubstitution", 0.5), ("r", 2, "test", 0.5)]
    assert tables.finished_runs(spark, path, "r") == {(1, 1), (1, 2)}
    tables.export_results(spark, path, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == len(got)


def test_empty_regions(spark):
    df = spark.sql("SELECT cast(array() AS array<struct<y:int, Class:int, dist:double>>) AS r")
    row = df.select(dynamic.minority_share(F.col("r")).alias("h"), models.neighbour_vote("r").alias("u"),
                    models.neighbour_vote("r", "distance").alias("d")).first()
    assert (row.h, row.u, row.d) == (0.0, None, None)


def test_best_params_name_what_was_applied():
    assert search.reported("MLPClassifier", {"learning_rate_init": 0.1, "hidden_layer_sizes": (5,)}) == {"ignored_learning_rate_init": "0.1", "hidden_layer_sizes": "(5,)"}
    assert search.reported("XGBClassifier", {"gamma": 1.0, "max_depth": 3}) == {"ignored_gamma": "1.0", "max_depth": "3"}
    assert set(search.reported("SVC", {"kernel": "poly", "gamma": 1, "degree": 2, "C": 1})) == {"kernel", "ignored_gamma", "degree", "C"}
    assert set(search.reported("SVC", {"kernel": "rbf", "gamma": 1, "degree": 2, "C": 1})) == {"kernel", "gamma", "ignored_degree", "C"}
    assert search.ignored("LogitBoostClassifier", {"min_impurity_decrease": 0.1, "ccp_alpha": 0.0}) == {"ccp_alpha"}


def test_depth_is_not_cut_silently(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(f"r{i}", Vectors.dense([float(i)]), i % 2) for i in range(20)], ["row_id", "features", "Class"])
    with pytest.raises(ValueError, match="levels deep"):
        models.make_base_model("DecisionTreeClassifier", {"max_depth": 31}).fit(df)
    assert models.make_base_model("DecisionTreeClassifier", {"max_depth": 25}).fit(df) is not None
