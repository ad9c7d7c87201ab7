"""Fourier features of a support vector machine: values by the formula, a batch at a time."""

import math
import random

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from raresift.operators import models


def test_fourier_features_by_batches(spark):
    x = np.random.default_rng(5).normal(size=(50, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    df = df.withColumn("features", array_to_vector(F.array("a", "b", "c")))
    lifted = models.FourierLift(3, 0.3, 42)(df)
    rng = random.Random("42-rff")
    table = [[rng.gauss(0.0, math.sqrt(0.6)) for _ in range(3)] for _ in range(models.FOURIER_WIDTH)]
    shifts = [rng.uniform(0.0, 2.0 * math.pi) for _ in range(models.FOURIER_WIDTH)]
    want = math.sqrt(2.0 / models.FOURIER_WIDTH) * np.cos(x @ np.array(table).T + shifts)
    rows = lifted.select("id", vector_to_array("_lift").alias("l")).orderBy("id").collect()
    assert np.allclose([r.l for r in rows], want, atol=1e-12)
    assert lifted.columns == [*df.columns, "_lift"] and lifted.where("id < 0").count() == 0
    # lambdas over arrays are interpreted for every row and weight
    assert "ArrowEvalPython" in lifted._jdf.queryExecution().executedPlan().toString()
