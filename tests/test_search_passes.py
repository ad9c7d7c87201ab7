"""Marks of a search from one split, counts of scored rows in place of the rows, blocks dealt out after binning."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from raresift.operators import models, search, splits, trees
from raresift.sources.storage import materialize


def _rows(spark, n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    return materialize(spark.createDataFrame([(f"r{i}", *map(float, x[i]), int(x[i, 0] + x[i, 1] > 1.2)) for i in range(n)],
                                             "row_id string, V1 double, V2 double, V3 double, Class int"))


def test_marks_of_a_search_are_those_of_its_splits(spark):
    df = _rows(spark)
    found = {r.row_id: r for r in splits.search_marks(df, 0.2, 2, [0.2, 0.6, 1.0], 42).collect()}
    apart = {r.row_id: r for r in splits.shuffle_splits(df, 0.2, 2, 42).collect()}
    assert all((found[i].val_0, found[i].val_1) == (r.val_0, r.val_1) for i, r in apart.items()) and len(found) == len(apart)
    for k, part in enumerate([0.2, 0.6, 1.0]):
        assert {i for i, r in found.items() if r[f"rung_{k}"]} == {r.row_id for r in splits.resource_rung(df, part, 42).collect()}


def test_counts_give_the_scores_of_the_rows(spark):
    df = _rows(spark).withColumn("features", array_to_vector(F.array("V1", "V2", "V3"))).withColumn("held", F.expr("crc32(row_id) % 5 = 0"))
    made = [models.make_base_model("DecisionTreeClassifier", {"max_depth": d}) for d in (1, 3)]
    _, table, jobs = models.fit_trees(made, df, F.col("held"))
    counted = trees.score_rows(table, jobs, counted=True)
    assert set(counted.columns) == {"candidate", "y", "pred", "n", "side"} and counted.agg(F.sum("n")).first()[0] == 2 * 900
    for metric in ("f1", "kappa", "precision"):
        rows = search.score_candidates(trees.score_rows(table, jobs), metric, "y")
        assert search.score_candidates(counted, metric, "y") == rows and len(rows) == 4


def test_blocks_of_one_partition_reach_all_tasks(spark):
    df = _rows(spark, 4096).coalesce(1).withColumn("features", array_to_vector(F.array("V1", "V2", "V3")))
    table = trees.binned(df, [[0.0]] * 3, "Class", "row_id", pairs=3 * trees.TASK_ROWS, count=4096)
    assert table.agg(F.sum("n")).first()[0] == 4096
    assert table.groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).agg(F.count("*"), F.max("n")).first() == (3, 1536)
