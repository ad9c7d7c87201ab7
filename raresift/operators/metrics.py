"""Binary-classification metrics for many models and folds in one job.

Input: one row per scored row with ``y`` (0/1), ``pred`` (0/1), ``p1`` (score of class 1) and any
grouping columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raresift.functions.ranks import ordered_cumsum
from raresift.sources.storage import materialize

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "kappa",
           "balanced_accuracy", "tp", "tn", "fp", "fn", "tnr", "fpr", "tpr"]


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, groups: list[str], n: str | None = None) -> DataFrame:
    """Counts of rows; a row of a table with counts ``n`` stands for as many."""
    y, p = F.col("y"), F.col("pred")
    rows = F.count_if if n is None else lambda c: F.sum(F.when(c, F.col(n)).otherwise(0))
    return df.groupBy(*groups).agg(
        rows((y == 1) & (p == 1)).alias("tp"), rows((y == 0) & (p == 0)).alias("tn"),
        rows((y == 0) & (p == 1)).alias("fp"), rows((y == 1) & (p == 0)).alias("fn"))


def rates(conf: DataFrame, fpr_compat: bool = False) -> DataFrame:
    """tnr, fpr, tpr; ``fpr_compat`` divides by fp + tnr as the original formula does."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    conf = conf.withColumn("tnr", _ratio(tn, tn + fp)).withColumn("tpr", _ratio(tp, tp + fn))
    return conf.withColumn("fpr", _ratio(fp, fp + (F.col("tnr") if fpr_compat else tn)))


def basic_scores(conf: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return (conf.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
            .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)))


def balanced_accuracy(conf: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return conf.withColumn("balanced_accuracy", (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2)


def kappa(conf: DataFrame) -> DataFrame:
    """Cohen's kappa; NULL where chance agreement is total."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    observed = (tp + tn) / n
    chance = ((tp + fp) / n) * ((tp + fn) / n) + ((tn + fn) / n) * ((tn + fp) / n)
    return conf.withColumn("kappa", F.when(chance < 1, (observed - chance) / (F.lit(1.0) - chance)))


def score_table(df: DataFrame, groups: list[str]) -> DataFrame:
    """Positives and negatives per group, decision and distinct score, written out.

    The ranking metrics read their input more than once; what they read is this small table, so
    that scoring itself runs once. A score that is missing or no number has no rank: an error that names its group.
    """
    where = F.concat_ws(", ", *[F.concat(F.lit(f"{g} = "), F.coalesce(F.col(g).cast("string"), F.lit("null"))) for g in groups])
    bad = F.raise_error(F.concat(F.lit("a score is missing or not a number where "), where)).cast("double")
    df = df.withColumn("p1", F.when(F.col("p1").isNull() | F.isnan(F.col("p1").cast("double")), bad).otherwise(F.col("p1")))
    counts = df.groupBy(*groups, "pred", "p1").agg(F.count_if(F.col("y") == 1).alias("pos"),
                                                   F.count_if(F.col("y") == 0).alias("neg"))
    return materialize(counts, "scores")


def _curve(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and distinct score: positives and negatives at it, strictly below it, and in total."""
    merged = scores.groupBy(*groups, "p1").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ordered_cumsum(merged, groups, "p1", ["pos", "neg"])


def _plain_scores(df: DataFrame, groups: list[str]) -> DataFrame:
    return score_table(df.withColumn("pred", F.lit(0)), groups)


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.lit(0.5) * F.col("neg")))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return F.when(pairs > 0, wins / pairs)


def _ap() -> Column:
    at_or_above = F.col("total_pos") - F.col("below_pos")
    called = at_or_above + F.col("total_neg") - F.col("below_neg")
    area = F.sum(F.col("pos") * at_or_above / called)
    return F.when(F.max("total_pos") > 0, area / F.max("total_pos")).otherwise(F.lit(0.0))


def roc_auc(df: DataFrame, groups: list[str]) -> DataFrame:
    """Mann-Whitney area with half credit for ties; NULL for a single class."""
    return _curve(_plain_scores(df, groups), groups).groupBy(*groups).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, groups: list[str]) -> DataFrame:
    """Sum of recall steps times precision, without interpolation."""
    return _curve(_plain_scores(df, groups), groups).groupBy(*groups).agg(_ap().alias("average_precision"))


def metrics(df: DataFrame, groups: list[str], fpr_compat: bool = False) -> DataFrame:
    """All metrics per group."""
    scores = score_table(df, groups)
    ranked = _curve(scores, groups).groupBy(*groups).agg(_auc().alias("roc_auc"), _ap().alias("average_precision"))
    called = F.col("pred") == 1
    counts = scores.groupBy(*groups).agg(
        F.sum(F.when(called, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(called, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(called, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(called, 0).otherwise(F.col("pos"))).alias("fn"))
    conf = kappa(balanced_accuracy(basic_scores(rates(counts, fpr_compat))))
    return conf.join(ranked, groups).select(*groups, *METRICS)


def voting_weights(pool_long: DataFrame, metric: str = "f1", groups: list[str] | None = None) -> DataFrame:
    """Metric of each classifier divided by the pool's sum; equal weights if the sum is zero.

    ``pool_long`` holds one row per scored row and classifier (``clf_idx``, ``clf``). An unknown
    metric scores 0, which gives equal weights.
    """
    groups = groups or []
    keys = [*groups, "clf_idx", "clf"]
    if metric in ("roc_auc", "average_precision"):
        scored = metrics(pool_long, keys)
    else:
        scored = kappa(balanced_accuracy(basic_scores(rates(confusion(pool_long, keys)))))
    score = F.coalesce(F.col(metric).cast("double"), F.lit(0.0)) if metric in METRICS else F.lit(0.0)
    # One row per classifier: the window runs over the pool, not over data rows.
    pool = Window.partitionBy(*(groups or [F.lit(0)]))
    scored = scored.withColumn("_s", score).withColumn("_sum", F.sum("_s").over(pool)) \
        .withColumn("_n", F.count("*").over(pool))
    return scored.select(*keys, F.when(F.col("_sum") > 0, F.col("_s") / F.col("_sum"))
                         .otherwise(F.lit(1.0) / F.col("_n")).alias("weight"))


def append_metrics(store: DataFrame | None, rows: DataFrame, **ids) -> DataFrame:
    """Add id columns to metric rows and append them; columns only one side has become NULL."""
    rows = rows.select(*[F.lit(v).alias(k) for k, v in ids.items()], *[c for c in rows.columns if c not in ids])
    return rows if store is None else store.unionByName(rows, allowMissingColumns=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def summarise_cv(fold_metrics: DataFrame, names: tuple[str, ...] = ("roc_auc", "f1", "precision", "recall"),
                 group: str = "technique") -> DataFrame:
    """Mean and population std over folds per technique, best ROC AUC then F1 first."""
    out = fold_metrics.groupBy(group).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in names], *[F.stddev_pop(m).alias(f"{m}_std") for m in names])
    text = [F.format_string("%.4f ± %.4f", f"{m}_mean", f"{m}_std").alias(f"{m}_text") for m in names]
    return out.select("*", *text).orderBy(F.desc(f"{names[0]}_mean"), F.desc(f"{names[1]}_mean"), group)
