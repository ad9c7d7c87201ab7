"""Feature engineering, scaling and selection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.config import DROPPED_COLUMNS, K_BEST, SCALED_COLUMNS
from raresift.sources.storage import materialize


def log_amount(df: DataFrame, source: str = "Amount", name: str = "Log_Amount") -> DataFrame:
    """log(1 + amount); an amount of -1 or less has no logarithm and is an error."""
    fits = F.col(source).isNull() | F.isnan(source) | (F.col(source) > -1)
    return df.withColumn(name, F.when(fits, F.log1p(source)).otherwise(
        F.raise_error(F.concat(F.lit(f"{source} must be above -1, got "), F.col(source).cast("string")))))


def drop_columns(df: DataFrame, names: list[str] = DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*names)


def split_label(df: DataFrame, label: str = "Class", row_id: str = "row_id",
                name: str = "features") -> DataFrame:
    """Row id, label and one vector with all other columns."""
    columns = [c for c in df.columns if c not in (label, row_id)]
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df).select(row_id, label, name)


def column_index(df: DataFrame, wanted: list[str], label: str = "Class", row_id: str = "row_id") -> dict[str, int]:
    """Position of each wanted column among the feature columns; unknown names are an error."""
    position = {c: i for i, c in enumerate(c for c in df.columns if c not in (label, row_id))}
    missing = [c for c in wanted if c not in position]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return {c: position[c] for c in wanted}


def scale_stats(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of the columns."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def scaled(name: str, stats: dict[str, tuple[float, float]]) -> Column:
    if name not in stats:
        return F.col(name)
    mean, std = stats[name]
    return ((F.col(name) - F.lit(mean)) / F.lit(std or 1.0)).alias(name)


def standardise(df: DataFrame, columns: list[str] = SCALED_COLUMNS) -> DataFrame:
    """Centre and scale some columns; every other column and the column order stay as they are."""
    stats = scale_stats(df, columns)
    return df.select(*[scaled(c, stats).alias(c) for c in df.columns])


def anova_f(df: DataFrame, features: list[str], label: str = "Class") -> DataFrame:
    """One-way ANOVA F of each feature, from one aggregate per class; missing values are left out feature by feature.

    A feature that is constant in every class but differs between them has an infinite F, a constant one has none.
    """
    parts = df.groupBy(label).agg(
        *[F.count(c).cast("double").alias(f"n{i}") for i, c in enumerate(features)],
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(features)],
        *[F.min(c).cast("double").alias(f"l{i}") for i, c in enumerate(features)],
        *[F.max(c).cast("double").alias(f"h{i}") for i, c in enumerate(features)])
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                      *[F.col(f"{a}{i}").alias(a) for a in "nmvlh"]) for i, c in enumerate(features)]
    long = parts.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*").where("n > 0")
    sums = long.groupBy("feature", "position").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("l") < F.col("h"), F.col("n") * F.col("v")).otherwise(0.0)).alias("within"),
        (F.min("l") < F.max("h")).alias("varies"),
        F.sum(F.col("n") * F.col("m")).alias("total"),
        F.sort_array(F.collect_list(F.struct("m", "n"))).alias("means"))
    grand = F.col("total") / F.col("n")
    between = F.aggregate("means", F.lit(0.0), lambda a, r: a + r.n * (r.m - grand) * (r.m - grand))
    ratio = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("feature", "position", F.when(F.col("within") > 0, ratio).when(F.col("varies"), F.lit(float("inf"))).alias("f"))


def k_best(df: DataFrame, features: list[str], k: int = K_BEST, label: str = "Class") -> DataFrame:
    """The min(k, n) features with the largest F, ties by position."""
    return anova_f(df, features, label).orderBy(F.desc_nulls_last("f"), "position").limit(k)


def class_weights(df: DataFrame, label: str = "Class") -> DataFrame:
    """Balanced weight n / (classes * n_c) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    packed = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"),
                        F.collect_list(F.struct(label, "n")).alias("_rows"))
    return (packed.select("_total", "_k", F.explode("_rows").alias("_r"))
            .select(f"_r.{label}", "_r.n", (F.col("_total") / (F.col("_k") * F.col("_r.n"))).alias("weight")))


def with_class_weight(df: DataFrame, label: str = "Class", name: str = "weight") -> DataFrame:
    """Add the balanced weight of the row's class (two literals for a binary label)."""
    return _weighted(df, label, {r[label]: r["weight"] for r in class_weights(df, label).collect()}, name)


def _weighted(df: DataFrame, label: str, weights: dict, name: str) -> DataFrame:
    column = F.lit(None).cast("double")
    for value, weight in weights.items():
        column = F.when(F.col(label) == value, F.lit(weight)).otherwise(column)
    return df.withColumn(name, column)


def l1_select(df: DataFrame, features: list[str], label: str = "Class", c: float = 0.1,
              threshold: float = 1e-5) -> list[str]:
    """Features with a coefficient of at least ``threshold`` in a balanced L1 logistic regression.

    If the penalty removes everything, the feature with the largest F is kept.
    """
    classes = {r[label]: (r["n"], r["weight"]) for r in class_weights(df, label).collect()}
    # Balanced weights add up to the number of rows.
    rows = sum(n * w for value, (n, w) in classes.items() if value is not None)
    if not rows:
        raise ValueError("there are no rows to select features on")
    weighted = _weighted(df, label, {value: w for value, (_, w) in classes.items()}, "_w")
    weights, _ = l1_logistic(weighted, features, label, "_w", 1.0 / (c * rows), tol=1e-6)
    kept = [f for f, w in zip(features, weights) if abs(w) >= threshold]
    return kept or [k_best(df, features, 1, label).first()["feature"]]


def l1_logistic(df: DataFrame, features: list[str], label: str, weight: str, penalty: float, steps: int = 60, tol: float = 1e-12) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise the weighted mean log-loss plus ``penalty`` times the sum of absolute coefficients.

    Newton steps on the smooth part with coordinate descent on the penalised quadratic: a step is one scan that adds up loss, gradient and
    curvature (a (d + 1) x (d + 1) matrix a task), and some fifteen steps do, where first-order methods take hundreds of scans. Steps that do not lower the
    objective are halved; the search ends with a step that gains ``tol`` at most.
    """
    data = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    d = len(features) + 1

    def pack(batches):
        for b in batches:
            if len(b):
                columns = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array([columns.tobytes()], pa.binary())], names=["block"])

    # Written once in blocks, as handing rows to Python costs several times what a scan computes.
    blocks = materialize(data.mapInArrow(pack, "block binary"), "logistic")

    def sums(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros(2 + d + d * d)
            for b in batches:
                for block in b.column(0):
                    *columns, y, w = np.frombuffer(block.as_buffer()).reshape(d + 1, -1)
                    x = np.array([*columns, np.ones(len(y))])
                    z = point @ x
                    e = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1.0, e) / (1 + e)
                    total[0] += w.sum()
                    total[1] += (w * (np.maximum(z, 0) + np.log1p(e) - y * z)).sum()
                    total[2:2 + d] += x @ (w * (p - y))
                    total[2 + d:] += ((x * (w * p * (1 - p))) @ x.T).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        total = sum((np.frombuffer(r.s) for r in blocks.mapInArrow(run, "s binary").collect()), np.zeros(2 + d + d * d))
        return total[1] / total[0], total[2:2 + d] / total[0], total[2 + d:].reshape(d, d) / total[0]

    def cost(loss: float, point: np.ndarray) -> float:
        return loss + penalty * np.abs(point[:-1]).sum()

    at = np.zeros(d)
    loss, slope, curve = sums(at)
    if not math.isfinite(loss) or not np.isfinite(curve).all():
        raise ValueError("a feature is missing or not finite")
    for _ in range(steps):
        step = _penalised_step(at, slope, curve, penalty)
        scale = 1.0
        while True:
            new = at + scale * step
            found = sums(new)
            if cost(found[0], new) <= cost(loss, at) + 1e-15 or scale < 1e-6:
                break
            scale /= 2
        moved = np.abs(new - at).max(initial=0.0)
        gained = cost(loss, at) - cost(found[0], new)
        if gained < 0:
            break
        at, (loss, slope, curve) = new, found
        if moved < 1e-9 or gained <= tol:
            break
    return at[:-1], float(at[-1])


def _penalised_step(at: np.ndarray, slope: np.ndarray, curve: np.ndarray, penalty: float) -> np.ndarray:
    """Minimiser of slope.s + s.curve.s / 2 + penalty * |at + s| over s, by coordinate descent; the last coordinate has no penalty.

    The last coordinate always stands at its best for the others, which takes their common part out of the curvature. Left in, as
    with features far from 0, descent crawls, and its unfinished steps cost the search many scans of the table.
    """
    free = curve[-1, -1] + 1e-12
    along = curve[:-1, -1] / free
    rest = curve[:-1, :-1] - np.outer(along, curve[-1, :-1])
    s, pull = np.zeros(len(at) - 1), slope[:-1] - along * slope[-1]  # pull: gradient of the quadratic at s
    for _ in range(10000):
        most = 0.0
        for i in range(len(s)):
            h = max(rest[i, i], 1e-12 * curve[i, i]) + 1e-12
            goal = at[i] + s[i] - pull[i] / h
            goal = np.sign(goal) * max(abs(goal) - penalty / h, 0.0)
            move = goal - at[i] - s[i]
            if move:
                s[i] += move
                pull += rest[:, i] * move
                most = max(most, abs(move) * math.sqrt(h))
        if most < 1e-12:
            break
    return np.append(s, -(slope[-1] + curve[-1, :-1] @ s) / free)


@dataclass
class FeatureSteps:
    """Fitted scaling and selection: a projection to the ``features`` vector."""

    columns: list[str]
    stats: dict[str, tuple[float, float]]
    selected: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        wanted = [scaled(c, self.stats).alias(f"_f_{c}") for c in self.selected]
        wide = df.select("*", *wanted)
        names = [f"_f_{c}" for c in self.selected]
        return VectorAssembler(inputCols=names, outputCol=output).transform(wide).drop(*names)

    def selected_features(self) -> tuple[list[int], list[str]]:
        """Indices in the original column order, and the names."""
        return [self.columns.index(c) for c in self.selected], list(self.selected)


def fit_feature_steps(df: DataFrame, columns: list[str], scale: list[str] = SCALED_COLUMNS,
                      k: int = K_BEST, label: str = "Class") -> FeatureSteps:
    """Scale, keep the k best by F, then the ones an L1 logistic regression keeps."""
    missing = [c for c in scale if c not in columns]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}")
    stats = scale_stats(df, scale)
    best = {r["feature"] for r in k_best(df, columns, k, label).collect()}
    best = [c for c in columns if c in best]
    ready = df.select(label, *[scaled(c, stats).alias(c) for c in best])
    return FeatureSteps(columns, stats, l1_select(ready, best, label))
