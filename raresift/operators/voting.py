"""Static ensembles over pool scores.

A scored row carries ``p``, an array with each classifier's score of class 1 in pool order; the
score of class 0 is its complement. Class 1 wins above 0.5, a tie goes to class 0.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.operators.features import with_class_weight


def decide(df: DataFrame, p1: str = "p1") -> DataFrame:
    return df.withColumn("pred", (F.col(p1) > 0.5).cast("int"))


def pool_long(df: DataFrame, names: list[str], label: str = "Class", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per scored row and classifier, with its decision and whether it is right."""
    rows = df.select("row_id", *keep, F.col(label).alias("y"), F.posexplode("p").alias("clf_idx", "p1"))
    names_of = F.lit(list(names))
    rows = decide(rows.withColumn("clf", F.element_at(names_of, F.col("clf_idx") + 1)))
    return rows.withColumn("p0", F.lit(1.0) - F.col("p1")).withColumn("correct", (F.col("pred") == F.col("y")).cast("int"))


def select_pool(df: DataFrame, names: list[str], pool: list[str]) -> DataFrame:
    """Keep the scores of a pool's members, in the pool's order; unknown members are an error."""
    unknown = sorted(set(pool) - set(names))
    if unknown:
        raise ValueError(f"the pool names models without scores: {', '.join(unknown)}")
    return df.withColumn("p", F.array(*[F.col("p")[names.index(m)] for m in pool]))


def mean_score(p: str | Column = "p") -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)


def soft_vote(df: DataFrame) -> DataFrame:
    """Mean of the class scores."""
    return decide(df.withColumn("p1", mean_score()))


def weighted_vote(df: DataFrame, weights: list[float]) -> DataFrame:
    """Weighted mean of the class scores; one weight per classifier in pool order."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.col("p")[i]
    return decide(df.withColumn("p1", total / F.lit(float(sum(weights)))))


def static_vote(name: str, df: DataFrame, weights: list[float] | None = None) -> DataFrame:
    if name == "VotingClassifier":
        return soft_vote(df)
    if name == "VotingClassifier_weighted":
        return weighted_vote(df, weights) if weights else soft_vote(df)
    raise ValueError(f"no static ensemble is called {name}")


def stacked(dsel: DataFrame, q: DataFrame, label: str = "Class") -> DataFrame:
    """Balanced logistic regression over the pool's scores, fitted on the selection set."""
    def vec(d):
        return d.withColumn("_x", array_to_vector("p"))

    data = vec(with_class_weight(dsel, label, "_w")).select("_x", F.col(label).cast("double").alias("_y"), "_w")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-4, maxIter=200,
                               probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pr").fit(data)
    scored = model.transform(vec(q)).withColumn("p1", vector_to_array("_prob")[1])
    return decide(scored.drop("_x", "_prob", "_raw", "_pr"))
