"""Hyper-parameter spaces, successive halving and cross-validation."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.config import (K_BEST, SCALED_COLUMNS, TUNING_CANDIDATES, TUNING_FACTOR, TUNING_SCORE, VALIDATION_SIZE, VALIDATION_SPLITS)
from raresift.operators import metrics
from raresift.operators.features import FeatureSteps, fit_feature_steps
from raresift.operators.models import TREE_MODELS, fit_trees, make_base_model, neighbour_scores
from raresift.operators.splits import search_marks
from raresift.operators.trees import score_rows
from raresift.operators.voting import decide
from raresift.sources.storage import materialize


@dataclass(frozen=True)
class Param:
    """int: low <= v < high; uniform: low <= v <= low + width; log: log-uniform in [low, high]; choice: a list."""

    kind: str
    low: object = None
    high: object = None

    def draw(self, rng: random.Random):
        if self.kind == "int":
            return rng.randrange(self.low, self.high)
        if self.kind == "uniform":
            return self.low + rng.random() * self.high
        if self.kind == "log":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.choice(self.low)


def whole(low, high):
    return Param("int", low, high)


def uniform(low, width):
    return Param("uniform", low, width)


def log(low, high):
    return Param("log", low, high)


def choice(*values):
    return Param("choice", list(values))


# The search ranges of the reference.
_TREE = {
    "max_depth": whole(3, 20), "min_samples_split": whole(2, 10), "min_samples_leaf": whole(1, 10),
    "max_features": choice("sqrt", "log2"), "max_leaf_nodes": whole(2, 20),
    "min_impurity_decrease": uniform(0.0, 0.1), "ccp_alpha": uniform(0.0, 0.01),
}
_BOOST = {"n_estimators": whole(50, 200), "learning_rate": log(1e-3, 1.0)}
SPACES: dict[str, dict[str, Param]] = {
    "SVC": {"C": log(1e-3, 1e3), "gamma": log(1e-4, 1.0), "kernel": choice("rbf", "poly", "linear"), "degree": whole(2, 5)},
    "KNeighborsClassifier": {"n_neighbors": whole(3, 20), "weights": choice("uniform", "distance"), "p": choice(1, 2)},
    "DecisionTreeClassifier": _TREE,
    "RandomForestClassifier": {"n_estimators": whole(50, 300), **_TREE, "max_samples": uniform(0.5, 0.5)},
    "ExtraTreesClassifier": {"n_estimators": whole(50, 300), **_TREE},
    "BalancedRandomForestClassifier": {"n_estimators": whole(50, 300), **_TREE},
    "AdaBoostClassifier": _BOOST,
    "RUSBoostClassifier": _BOOST,
    "LogitBoostClassifier": {"n_estimators": whole(50, 300), **_TREE, "learning_rate": log(1e-3, 1.0)},
    "XGBClassifier": {
        "n_estimators": whole(50, 300), "max_depth": whole(3, 10), "learning_rate": log(0.01, 0.3),
        "subsample": uniform(0.6, 0.4), "colsample_bytree": uniform(0.6, 0.4), "gamma": uniform(0.0, 5.0),
        "reg_alpha": log(1e-4, 10.0), "reg_lambda": log(1e-4, 10.0), "scale_pos_weight": uniform(1.0, 10.0),
        "min_child_weight": whole(1, 10), "max_delta_step": whole(0, 10),
    },
    "MLPClassifier": {"hidden_layer_sizes": choice((50,), (100,), (100, 50)), "alpha": log(1e-5, 1e-2), "learning_rate_init": log(1e-4, 1e-2)},
}
# Parameters of the original estimators that have no effect here.
IGNORED_BY = {"MLPClassifier": {"alpha", "learning_rate_init"}, "LogitBoostClassifier": {"ccp_alpha"}}


def ignored(name: str, params: dict) -> set[str]:
    """Names of the given parameters that the model does not use."""
    out = IGNORED_BY.get(name, set()) & set(params)
    if name == "SVC":  # each kernel has its own
        unused = {"rbf": {"degree"}, "poly": {"gamma"}, "linear": {"gamma", "degree"}}
        out |= unused[params.get("kernel", "rbf")] & set(params)
    return out


def space_of(name: str) -> dict[str, Param]:
    if name not in SPACES:
        raise ValueError(f"no search space for a model called {name}")
    return SPACES[name]


def draw(space: dict[str, Param], n: int, seed) -> list[dict]:
    rng = random.Random(str(seed))
    return [{k: p.draw(rng) for k, p in space.items()} for _ in range(n)]


def reported(name: str, params: dict) -> dict[str, str]:
    """Parameters as text; those without effect are named so."""
    unused = ignored(name, params)
    return {(f"ignored_{k}" if k in unused else k): str(v) for k, v in params.items()}


@dataclass
class Fitted:
    """Feature steps and classifier, applied together."""

    name: str
    steps: FeatureSteps
    scorer: object
    params: dict

    def score(self, df: DataFrame, output: str = "p1") -> DataFrame:
        return self.scorer.score(self.steps.transform(df), output).drop("features")


def fit_model(df: DataFrame, name: str, params: dict, columns: list[str], seed: int = 42, label: str = "Class",
              row_id: str = "row_id", scale: list[str] = SCALED_COLUMNS, k: int = K_BEST, resampler=None,
              steps: FeatureSteps | None = None) -> Fitted:
    """[resample ->] scale -> select -> classifier. Resampling touches the training rows only.

    Given ``steps`` were fitted on these very rows; they do not depend on the classifier.
    """
    if resampler is not None:
        df = materialize(resampler(df, columns), "resampled")
    steps = steps or fit_feature_steps(df, columns, [c for c in scale if c in columns], k, label)
    return Fitted(name, steps, make_base_model(name, params, seed, label, row_id).fit(steps.transform(df)), params)


@dataclass
class Search:
    best: Fitted
    params: dict
    train_scores: list[float]
    val_scores: list[float]
    seconds: float
    rungs: list[tuple[int, float]] = field(default_factory=list)


def rung_plan(candidates: int, factor: int, first: float) -> list[tuple[int, float]]:
    """(candidates, share of rows) per rung; 30 candidates, factor 3, 0.2 give (30, 0.2) and (10, 0.6)."""
    plan, share = [], first
    while share <= 1.0 + 1e-9 and candidates >= 1:
        plan.append((candidates, min(share, 1.0)))
        if candidates == 1:
            break
        candidates, share = math.ceil(candidates / factor), share * factor
    return plan


RANKING = ("roc_auc", "average_precision")  # metrics that need every score


def score_candidates(scored: DataFrame, metric: str, label: str = "Class") -> dict[tuple[int, str], float]:
    """Metric per (candidate, side) of a long table of scored rows, or of counts ``n`` of decided ones, in one job."""
    keys, counted = ["candidate", "side"], "n" in scored.columns
    rows = scored.withColumnRenamed(label, "y") if counted else decide(scored).select(*keys, F.col(label).alias("y"), "pred", "p1")
    table = metrics.metrics(rows, keys) if metric in RANKING else metrics.kappa(
        metrics.balanced_accuracy(metrics.basic_scores(metrics.rates(metrics.confusion(rows, keys, "n" if counted else None)))))
    return {(r["candidate"], r["side"]): r[metric] or 0.0 for r in table.collect()}


def _rung_scores(pool: list, name: str, fit_rows: DataFrame, rows: DataFrame, held, steps: FeatureSteps, seed: int, label: str, row_id: str,
                 parallelism: int, resampled: bool, metric: str) -> DataFrame:
    """(candidate, side, label, p1) of a rung's rows under all its candidates; their counts (candidate, side, label, pred, n) where the metric needs no more.

    Trees of all candidates grow together from shared sums; neighbour candidates share one search per distance; the others are
    fitted from a bounded pool of driver threads.
    """
    side = F.when(held, "val").otherwise("train").alias("side")
    made = [make_base_model(name, params, seed, label, row_id) for _, params in pool]
    number = F.element_at(F.array(*[F.lit(c) for c, _ in pool]), F.col("candidate") + 1).alias("candidate")
    if name in TREE_MODELS:
        if resampled:  # learned from other rows than those that are scored
            fitted, _, _ = fit_trees(made, steps.transform(fit_rows))
            return _wide_scores(steps.transform(rows), [(c, m.score) for (c, _), m in zip(pool, fitted)], label, side)
        _, table, jobs = fit_trees(made, steps.transform(rows), held)
        scores = ["p1"] if metric in RANKING else ["pred", "n"]
        return score_rows(table, jobs, counted=metric not in RANKING).select(number, F.col("y").alias(label), *scores, "side")
    if name == "KNeighborsClassifier":
        return neighbour_scores(made, steps.transform(fit_rows), steps.transform(rows).withColumn("side", side)).select(number, label, "p1", "side")

    def one(item):
        c, params = item
        fitted = fit_model(fit_rows, name, params, steps.columns, seed, label, row_id, steps=steps)
        return fitted.score(rows).select(F.lit(c).alias("candidate"), label, "p1", side)

    with ThreadPoolExecutor(max_workers=parallelism) as threads:
        return metrics.union_all(list(threads.map(one, pool)))


def _wide_scores(df: DataFrame, scorers: list, label: str, side) -> DataFrame:
    df = df.withColumn("side", side)
    for c, score in scorers:
        df = score(df, f"_c{c}")
    cells = [F.struct(F.lit(c).alias("candidate"), F.col(f"_c{c}").alias("p1")) for c, _ in scorers]
    return df.select(label, "side", F.explode(F.array(*cells)).alias("s")).select("s.candidate", label, "s.p1", "side")


def halving_search(df: DataFrame, name: str, columns: list[str], seed: int = 42, candidates: int = TUNING_CANDIDATES,
                   factor: int = TUNING_FACTOR, share: float = VALIDATION_SIZE, splits: int = VALIDATION_SPLITS,
                   metric: str = TUNING_SCORE, label: str = "Class", row_id: str = "row_id", parallelism: int = 4,
                   space: dict[str, Param] | None = None, fixed: dict | None = None, resampler=None, **model_args) -> Search:
    """Successive halving over rows: all candidates on a small share, the best third on three times as many.

    Candidates of a rung are fitted and measured together (``_rung_scores``). The winner is fitted on all rows.
    """
    start = time.time()
    pool = list(enumerate({**p, **(fixed or {})} for p in draw(space or space_of(name), candidates, f"{seed}-{name}")))
    plan = rung_plan(candidates, factor, share)
    marked = materialize(search_marks(df, share, splits, [part for _, part in plan], seed, label, row_id), "search")
    result: dict[int, tuple[list[float], list[float]]] = {}
    for i, _ in enumerate(plan):
        rows = materialize(marked.where(f"rung_{i}").drop(*[f"rung_{r}" for r in range(len(plan))]), "rung")
        train, val = {c: [] for c, _ in pool}, {c: [] for c, _ in pool}
        for s in range(splits):
            held = F.col(f"val_{s}")
            fit_rows = rows.where(~held)
            if resampler is not None:
                fit_rows = materialize(resampler(fit_rows, columns), "resampled")
            scale = [c for c in model_args.get("scale", SCALED_COLUMNS) if c in columns]
            steps = fit_feature_steps(fit_rows, columns, scale, model_args.get("k", K_BEST), label)

            scored = _rung_scores(pool, name, fit_rows, rows, held, steps, seed, label, row_id, parallelism, resampler is not None, metric)
            found = score_candidates(scored, metric, label)
            for c, _ in pool:
                train[c].append(found.get((c, "train"), 0.0))
                val[c].append(found.get((c, "val"), 0.0))
        result = {c: (train[c], val[c]) for c, _ in pool}
        ranked = sorted(pool, key=lambda item: (-sum(val[item[0]]), item[0]))
        pool = ranked[:plan[i + 1][0]] if i + 1 < len(plan) else ranked[:1]
    c, params = pool[0]
    best = fit_model(df, name, params, columns, seed, label, row_id, resampler=resampler, **model_args)
    return Search(best, params, *result[c], time.time() - start, plan)


def _mean_std(values: list[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def tuning_row(search: Search) -> dict:
    """Columns that describe a search in the results table."""
    (tm, ts), (vm, vs) = _mean_std(search.train_scores), _mean_std(search.val_scores)
    indices, names = search.best.steps.selected_features()
    return {"cv_tuning_mean_train_score": tm, "cv_tuning_std_train_score": ts, "cv_tuning_mean_val_score": vm,
            "cv_tuning_std_val_score": vs, "best_params": reported(search.best.name, search.params), "tuning_time": search.seconds,
            "selected_features_indices": indices, "selected_features_names": names}


def cross_validate(df: DataFrame, make: Callable[[DataFrame], object], folds: int, label: str = "Class",
                   fold: str = "fold", tag: str = "model") -> DataFrame:
    """Metrics per fold of a model built by ``make(training rows)``; all folds are measured in one job."""
    scored = []
    for f in range(folds):
        model = make(df.where(F.col(fold) != f))
        out = decide(model.score(df.where(F.col(fold) == f)))
        scored.append(out.select(F.lit(tag).alias("technique"), F.lit(f).alias("fold"), F.col(label).alias("y"), "pred", "p1"))
    return metrics.metrics(metrics.union_all(scored), ["technique", "fold"])
