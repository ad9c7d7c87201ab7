"""Base classifiers, by the reference's names.

Each fit takes a table with ``features`` (vector) and a 0/1 label and gives a scorer: an object
with ``score(df)`` that adds ``p1``. Named differences to the original estimators:

- Trees, forests and boosted models (``trees``): cuts are among 63 quantiles of a feature (every value of one that has fewer); with a limit on
  leaves, a level's best gains are opened first; trees are 5 levels deep by default.
- RandomForest, BalancedRandomForest: a row's copies in a tree's sample are Poisson by its hash, so a sample's size varies.
- RUSBoost: the larger class is thinned by hash to the expected size of the smaller one, a round each.
- LogitBoost: the watched tenth is drawn by hash, and the model is cut at its best round; ``ccp_alpha`` is not used.
- XGB: ``gamma`` keeps a split from being made; nothing is pruned afterwards.
- MLP: sigmoid units and L-BFGS.
- SVC: linear machine on random Fourier (rbf) or polynomial features, Platt scaling on its margin.

Parameters without a counterpart are kept in the result under ``ignored_<name>``.
"""

from __future__ import annotations

import math
import random
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.operators import neighbors, trees
from raresift.operators.features import class_weights, with_class_weight
from raresift.sources.storage import materialize

FOURIER_WIDTH = 128
#: Trained together by the batched trainer of ``trees``.
TREE_MODELS = ("DecisionTreeClassifier", "RandomForestClassifier", "ExtraTreesClassifier", "BalancedRandomForestClassifier", "AdaBoostClassifier",
               "RUSBoostClassifier", "LogitBoostClassifier", "XGBClassifier")


@dataclass
class MLScorer:
    """A fitted pyspark.ml classifier with a probability."""

    model: object

    def score(self, df: DataFrame, output: str = "p1") -> DataFrame:
        out = self.model.transform(df)
        return out.withColumn(output, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


@dataclass
class MarginScorer:
    """Linear machine with Platt scaling, after an optional feature map."""

    model: object
    platt: tuple[float, float]
    lift: object = None

    def margin(self, df: DataFrame) -> DataFrame:
        lifted = self.lift(df) if self.lift else df.withColumn("_lift", F.col("features"))
        out = self.model.transform(lifted)
        return out.withColumn("_margin", vector_to_array("_raw")[1]).drop("_lift", "_raw", "_pred")

    def score(self, df: DataFrame, output: str = "p1") -> DataFrame:
        a, b = self.platt
        z = F.lit(a) * F.col("_margin") + F.lit(b)
        return self.margin(df).withColumn(output, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("_margin")


@dataclass
class NeighbourScorer:
    """k-nearest-neighbour vote; with distance weights, rows at distance 0 take all the weight."""

    data: DataFrame
    columns: list[str]
    k: int
    weights: str
    p: int
    label: str
    row_id: str

    def score(self, df: DataFrame, output: str = "p1") -> DataFrame:
        wide = unpack(df, self.columns)
        found = neighbors.with_neighbours(wide, self.data, self.k, self.columns, self.row_id, [self.label], p=self.p, name="_nn")
        return found.withColumn(output, neighbour_vote("_nn", self.weights, self.label, self.p)).drop("_nn", *self.columns)


def neighbour_scores(models: list[BaseModel], data: DataFrame, df: DataFrame) -> DataFrame:
    """(candidate, p1, label, side) of rows under several neighbour models: one search per distance, for the largest number of neighbours."""
    m, width = models[0], _width(df)
    columns = [f"_k{i}" for i in range(width)]
    known = materialize(unpack(data.select(m.row_id, m.label, "features"), columns).drop("features"), "knn-model")
    parts = []
    for p in sorted({int(x.get("p", 2)) for x in models}):
        own = [(i, x) for i, x in enumerate(models) if int(x.get("p", 2)) == p]
        most = max(int(x.get("n_neighbors", 5)) for _, x in own)
        wide = unpack(df, columns).select(m.row_id, m.label, "side", *columns)
        found = neighbors.with_neighbours(wide, known, most, columns, m.row_id, [m.label], p=p, name="_nn")
        cells = []
        for i, x in own:
            nearest = F.slice("_nn", 1, int(x.get("n_neighbors", 5)))
            cells.append(F.struct(F.lit(i).alias("candidate"), neighbour_vote(nearest, x.get("weights", "uniform"), m.label, p).alias("p1")))
        parts.append(found.select(m.label, "side", F.explode(F.array(*cells)).alias("s")).select("s.candidate", "s.p1", m.label, "side"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def neighbour_vote(region: str | Column, weights: str = "uniform", label: str = "Class", p: int = 2) -> Column:
    """Share of class 1 among the neighbours, NULL without any; with weights, those at distance 0 decide alone."""
    ones = lambda n: n[label] == 1
    if weights == "uniform":
        return F.when(F.size(region) > 0, F.size(F.filter(region, ones)) / F.size(region))
    exact = F.filter(region, lambda n: n["dist"] == 0)
    length = lambda n: F.sqrt(n["dist"]) if p == 2 else n["dist"]
    total = lambda keep: F.aggregate(F.filter(region, keep), F.lit(0.0), lambda a, n: a + F.lit(1.0) / length(n))
    return F.when(F.size(exact) > 0, F.size(F.filter(exact, ones)) / F.size(exact)).when(
        F.size(region) > 0, total(ones) / total(lambda n: F.lit(True)))


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    x = vector_to_array("features")
    return df.select("*", *[x[i].alias(c) for i, c in enumerate(columns)])


def _width(df: DataFrame) -> int:
    """Length of the feature vector, from column metadata where the assembler left it."""
    meta = df.schema["features"].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return int(df.select(F.size(vector_to_array("features")).alias("n")).first()["n"])


@dataclass
class BaseModel:
    """A named classifier with parameters; ``fit`` gives a scorer."""

    name: str
    params: dict = field(default_factory=dict)
    seed: int = 42
    label: str = "Class"
    row_id: str = "row_id"

    def fit(self, df: DataFrame):
        return _FITS[self.name](self, df)

    def get(self, key, default):
        return self.params.get(key, default)

    def weighted(self, df: DataFrame) -> DataFrame:
        return with_class_weight(df, self.label, "_w").withColumn("_y", F.col(self.label).cast("double"))


def tree_job(m: BaseModel, group: int = 0, allowed: list[int] | None = None) -> trees.Job:
    """The model as a job of the batched trainer."""
    grow = dict(depth=_depth(m.get("max_depth", 5)), min_leaf=int(m.get("min_samples_leaf", 1)), min_split=int(m.get("min_samples_split", 2)),
                max_leaves=m.get("max_leaf_nodes", None), min_gain=float(m.get("min_impurity_decrease", 0.0)), prune=float(m.get("ccp_alpha", 0.0)))
    # candidates of a search draw differently, the same parameters always alike
    more = dict(group=group, seed=m.seed + (zlib.crc32(repr(sorted(m.params.items())).encode()) << 20), allowed=allowed)
    forest = int(m.get("n_estimators", 100))
    if m.name == "DecisionTreeClassifier":
        return trees.Job("forest", 1, features=m.get("max_features", "all"), **grow, **more)
    if m.name == "RandomForestClassifier":
        return trees.Job("forest", forest, draw="bootstrap", rate=float(m.get("max_samples", 1.0)), features=m.get("max_features", "sqrt"), **grow, **more)
    if m.name == "ExtraTreesClassifier":
        return trees.Job("forest", forest, random_cuts=True, features=m.get("max_features", "sqrt"), **grow, **more)
    if m.name == "BalancedRandomForestClassifier":
        return trees.Job("forest", forest, draw="balanced", features=m.get("max_features", "sqrt"), **grow, **more)
    rate = float(m.get("learning_rate", {"XGBClassifier": 0.3, "LogitBoostClassifier": 0.1}.get(m.name, 1.0)))
    if m.name in ("AdaBoostClassifier", "RUSBoostClassifier"):
        return trees.Job("stumps", int(m.get("n_estimators", 50)), depth=1, learning_rate=rate, draw="under" if m.name.startswith("RUS") else "all", **more)
    if m.name == "LogitBoostClassifier":
        return trees.Job("logistic", forest, learning_rate=rate, features=m.get("max_features", "all"), patience=True,
                         **{**grow, "depth": _depth(m.get("max_depth", 3)), "prune": 0.0}, **more)
    share = float(m.get("subsample", 1.0))
    return trees.Job("penalised", forest, depth=_depth(m.get("max_depth", 6)), learning_rate=rate, draw="share" if share < 1 else "all", rate=share,
                     tree_features=float(m.get("colsample_bytree", 1.0)), l1=float(m.get("reg_alpha", 0.0)), l2=float(m.get("reg_lambda", 1.0)),
                     min_gain=float(m.get("gamma", 0.0)), min_child_weight=float(m.get("min_child_weight", 1)), max_step=float(m.get("max_delta_step", 0)),
                     positive_weight=float(m.get("scale_pos_weight", 1.0)), **more)


def _trees(m: BaseModel, df):
    return fit_trees([m], df)[0][0]


def fit_trees(models: list[BaseModel], df: DataFrame, held: Column | None = None) -> tuple[list, DataFrame, list]:
    """Scorers of models that differ in name, parameters and seed only, all trained together on the rows that are not ``held``; the binned table, and the jobs."""
    m = models[0]
    fit = df if held is None else df.where(~held)
    cuts = trees.cut_points(fit, _width(df))
    classes = class_weights(fit, m.label).collect()
    weight = F.lit(1.0)
    for r in classes:
        weight = F.when(F.col(m.label) == r[m.label], F.lit(r["weight"])).otherwise(weight)
    jobs = [tree_job(x) for x in models]
    at_once = sum(j.trees if j.kind == "forest" else 1 for j in jobs)
    count = sum(r["n"] for r in classes)
    rows = trees.binned(df, cuts, m.label, m.row_id, weight, held=held, pairs=at_once * count, count=count)
    jobs = trees.train(rows, jobs)
    return [trees.TreesScorer.of(j, cuts) for j in jobs], rows, jobs


def _depth(value) -> int:
    """Depth of a tree; what Spark cannot build is an error, not a smaller tree."""
    if not 0 <= int(value) <= 30:
        raise ValueError(f"trees can be 0 to 30 levels deep, not {value}")
    return int(value)


def _mlp(m: BaseModel, df):
    layers = [_width(df), *[int(v) for v in m.get("hidden_layer_sizes", (50,))], 2]
    data = df.withColumn("_y", F.col(m.label).cast("double"))
    return MLScorer(MultilayerPerceptronClassifier(featuresCol="features", labelCol="_y", layers=layers, maxIter=int(m.get("max_iter", 100)), seed=m.seed).fit(data))


@dataclass
class FourierLift:
    """Random Fourier features of the rbf kernel: one product and one cosine of a whole Arrow batch at a time."""

    width: int
    gamma: float
    seed: int

    def __call__(self, df: DataFrame) -> DataFrame:
        rng = random.Random(f"{self.seed}-rff")
        table = np.array([[rng.gauss(0.0, math.sqrt(2.0 * self.gamma)) for _ in range(self.width)] for _ in range(FOURIER_WIDTH)]).reshape(FOURIER_WIDTH, self.width)
        shifts = np.array([rng.uniform(0.0, 2.0 * math.pi) for _ in range(FOURIER_WIDTH)])

        @F.arrow_udf("array<double>")
        def run(features: pa.Array) -> pa.Array:
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), table.shape[1])
            lifted = x @ table.T
            lifted += shifts
            np.cos(lifted, out=lifted)
            lifted *= math.sqrt(2.0 / len(shifts))
            return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(shifts), lifted.ravel())

        return df.withColumn("_lift", array_to_vector(run(vector_to_array("features"))))


@dataclass
class PolynomialLift:
    degree: int

    def __call__(self, df: DataFrame) -> DataFrame:
        return PolynomialExpansion(degree=self.degree, inputCol="features", outputCol="_lift").transform(df)


def _svc(m: BaseModel, df):
    kernel = m.get("kernel", "rbf")
    lift = None
    if kernel == "rbf":
        lift = FourierLift(_width(df), float(m.get("gamma", 0.05)), m.seed)
    elif kernel == "poly":
        lift = PolynomialLift(int(m.get("degree", 3)))
    data = m.weighted(df)
    rows = data.count()
    lifted = lift(data) if lift else data.withColumn("_lift", F.col("features"))
    svc = LinearSVC(featuresCol="_lift", labelCol="_y", weightCol="_w", rawPredictionCol="_raw", predictionCol="_pred",
                    regParam=1.0 / (float(m.get("C", 1.0)) * max(rows, 1)), maxIter=50).fit(lifted)
    scorer = MarginScorer(svc, (1.0, 0.0), lift)
    # read several times, and a margin costs a lift
    margins = materialize(scorer.margin(data).select("_margin", "_y", "_w"), "margins").select(array_to_vector(F.array("_margin")).alias("_x"), "_y", "_w")
    platt = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=50).fit(margins)
    scorer.platt = (float(platt.coefficients[0]), float(platt.intercept))
    return scorer


def _knn(m: BaseModel, df):
    columns = [f"_k{i}" for i in range(_width(df))]
    data = materialize(unpack(df.select(m.row_id, m.label, "features"), columns).drop("features"), "knn-model")
    return NeighbourScorer(data, columns, int(m.get("n_neighbors", 5)), m.get("weights", "uniform"), int(m.get("p", 2)), m.label, m.row_id)


def _logistic(m: BaseModel, df):
    return MLScorer(LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", regParam=float(m.get("regParam", 0.0)),
                                       elasticNetParam=float(m.get("elasticNetParam", 0.0)), maxIter=100).fit(m.weighted(df)))


_FITS = {
    **dict.fromkeys(TREE_MODELS, _trees), "MLPClassifier": _mlp, "SVC": _svc,
    "KNeighborsClassifier": _knn, "LogisticRegression": _logistic,
}


def make_base_model(name: str, params: dict | None = None, seed: int = 42, label: str = "Class", row_id: str = "row_id") -> BaseModel:
    if name not in _FITS:
        raise ValueError(f"there is no base model called {name}")
    return BaseModel(name, dict(params or {}), seed, label, row_id)
