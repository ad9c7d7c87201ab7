"""Nested cross-validation of base models, static ensembles and dynamic ensembles; resampler benchmark; scoring."""

from __future__ import annotations

import time
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift import config
from raresift.functions.hashing import hash_key
from raresift.operators import dynamic, metrics, neighbors, resample, splits, trees, voting
from raresift.operators.features import column_index, fit_feature_steps
from raresift.operators.models import TREE_MODELS, make_base_model, tree_job
from raresift.operators.search import Search, cross_validate, fit_model, halving_search, tuning_row
from raresift.sources.model_store import load_model
from raresift.sources.storage import materialize, scratch
from raresift.sources.tables import append_results, finished_runs, require_columns


@dataclass
class Settings:
    """Protocol of an experiment; the defaults are the full 10 x 10 protocol."""

    splits: int = config.CV_SPLITS
    repeats: int = config.CV_REPEATS
    dsel_share: float = config.DSEL_SIZE
    models: list[str] = field(default_factory=lambda: list(config.BASE_MODELS))
    static: list[str] = field(default_factory=lambda: list(config.STATIC_MODELS))
    dynamic: list[str] = field(default_factory=lambda: list(config.DYNAMIC_MODELS))
    pools: dict[str, list[str]] = field(default_factory=lambda: dict(config.POOLS))
    resampling: str | None = config.RESAMPLING_METHOD
    resample_inside: bool = False
    candidates: int = config.TUNING_CANDIDATES
    k_best: int = config.K_BEST
    region: int = config.REGION_SIZE
    clusters: int = 5
    seed: int = config.SEED
    label: str = config.LABEL
    row_id: str = "row_id"
    scale: list[str] = field(default_factory=lambda: list(config.SCALED_COLUMNS))
    parallelism: int = 4
    fixed_params: dict = field(default_factory=dict)
    runs: list[int] | None = None

    def check(self) -> None:
        for name, members in self.pools.items():
            unknown = sorted(set(members) - set(self.models))
            if unknown:
                raise ValueError(f"pool {name} names models that are not trained: {', '.join(unknown)}")
        known = set(dynamic.SELECTORS) | {"DESClustering", "METADES", "StackedClassifier"}
        unknown = sorted(set(self.dynamic) - known)
        if unknown:
            raise ValueError(f"no dynamic selector is called {' or '.join(unknown)}")


def fit_base(train: DataFrame, name: str, features: list[str], cfg: Settings) -> Search:
    """Tune one base model on the training rows and fit the winner on all of them."""
    inner = resample.resampler(cfg.resampling, cfg.seed) if cfg.resampling and cfg.resample_inside else None
    return halving_search(train, name, features, cfg.seed, cfg.candidates, label=cfg.label, row_id=cfg.row_id,
                          parallelism=cfg.parallelism, fixed=cfg.fixed_params.get(name), resampler=inner,
                          k=cfg.k_best, scale=cfg.scale)


def pool_scores(df: DataFrame, fitted: dict, label: str, row_id: str, features: list[str]) -> DataFrame:
    """Score rows once with every fitted model: the array ``p`` in the models' order."""
    for i, m in enumerate(fitted.values()):
        df = m.score(df, f"_p{i}")
    return df.select(row_id, label, *features, F.array(*[F.col(f"_p{i}") for i in range(len(fitted))]).alias("p"))


def measured(rows: DataFrame, label: str, groups: list[str]) -> DataFrame:
    return metrics.metrics(rows.withColumn("y", F.col(label)), groups)


def base_rows(scored: DataFrame, names: list[str], label: str) -> DataFrame:
    """Metrics of every base model on rows scored by all of them."""
    long = voting.pool_long(scored, names, label)
    return metrics.metrics(long.withColumnRenamed("clf", "model"), ["model"])


def first_rows(df: DataFrame, n: int, seed, row_id: str) -> DataFrame:
    """n seed rows in hash order (a bounded top-k)."""
    return df.withColumn("_h", hash_key(seed, row_id)).orderBy("_h", row_id).limit(n).drop("_h")


def ensemble_answers(q: DataFrame, dsel: DataFrame, members: list[str], cfg: Settings, features: list[str]) -> DataFrame:
    """Answers (row_id, label, model, p1, pred) of all static and dynamic ensembles of a pool.

    ``q`` and ``dsel`` are scored by the pool. Region-based selectors share one neighbour search.
    """
    cols = [cfg.row_id, cfg.label]
    size, out = len(members), []
    if cfg.static:
        weights = metrics.voting_weights(voting.pool_long(dsel, members, cfg.label), "f1").orderBy("clf_idx").collect()
        weights = [r["weight"] for r in weights]
        for name in cfg.static:
            out.append(voting.static_vote(name, q, weights).select(*cols, F.lit(name).alias("model"), "p1", "pred"))
    regional = [n for n in cfg.dynamic if n in dynamic.SELECTORS]
    if regional:
        out.append(dynamic.dynamic_select(q, dsel, regional, size, features, cfg.region, cfg.label).select(*cols, "model", "p1", "pred"))
    if "DESClustering" in cfg.dynamic:
        centres = neighbors.lloyd(dsel, first_rows(dsel, cfg.clusters, f"{cfg.seed}c", cfg.row_id), features, row_id=cfg.row_id)
        out.append(dynamic.desclustering(q, dsel, centres, features, size, cfg.label)
                   .select(*cols, F.lit("DESClustering").alias("model"), "p1", "pred"))
    if "METADES" in cfg.dynamic:
        out.append(dynamic.metades(q, dsel, size, features, cfg.region, label=cfg.label)
                   .select(*cols, F.lit("METADES").alias("model"), "p1", "pred"))
    if "StackedClassifier" in cfg.dynamic:
        out.append(voting.stacked(dsel, q, cfg.label).select(*cols, F.lit("StackedClassifier").alias("model"), "p1", "pred"))
    return metrics.union_all(out)


TUNING_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    *[T.StructField(f"cv_tuning_{a}_{b}_score", T.DoubleType()) for b in ("train", "val") for a in ("mean", "std")],
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tuning_time", T.DoubleType()),
    T.StructField("selected_features_indices", T.ArrayType(T.IntegerType())),
    T.StructField("selected_features_names", T.ArrayType(T.StringType()))])


#: Models whose training has the most steps one after the other.
LONGEST = ["XGBClassifier", "LogitBoostClassifier", "RUSBoostClassifier", "AdaBoostClassifier", "MLPClassifier", "SVC"]


def timed(action) -> tuple[object, float]:
    start = time.time()
    result = action()
    return result, time.time() - start


def _by_model(values: dict[str, float]) -> Column:
    column = F.lit(None).cast("double")
    for name, value in values.items():
        column = F.when(F.col("model") == name, F.lit(value)).otherwise(column)
    return column


def run_once(df: DataFrame, features: list[str], run: int, cfg: Settings) -> tuple[DataFrame, dict]:
    """One outer run: metric rows (resubstitution, test, ensembles) and the fitted base models."""
    spark = df.sparkSession
    repeat, fold = splits.run_position(run, cfg.splits)
    rows = splits.with_roles(df, fold, cfg.dsel_share, cfg.seed, f"fold_{repeat}", cfg.label, cfg.row_id)
    rows = materialize(rows.select(cfg.row_id, cfg.label, *features, "role"), "roles")
    train, dsel, test = (rows.where(F.col("role") == r).drop("role") for r in ("train", "dsel", "test"))
    if cfg.resampling and not cfg.resample_inside:
        train = materialize(resample.resampler(cfg.resampling, cfg.seed)(train, features, label=cfg.label, row_id=cfg.row_id), "train")
    # models do not wait for each other: the ones with most rounds begin, as their chain of jobs is the longest
    order = sorted(cfg.models, key=lambda n: (LONGEST.index(n) if n in LONGEST else len(LONGEST), n))
    with ThreadPoolExecutor(max_workers=2 * cfg.parallelism) as threads:  # most of them wait for small jobs
        tuned = dict(zip(order, threads.map(lambda name: fit_base(train, name, features, cfg), order)))
    searches = {name: tuned[name] for name in cfg.models}
    fitted = {name: s.best for name, s in searches.items()}

    def scored(part, name):
        return materialize(pool_scores(part, fitted, cfg.label, cfg.row_id, features), name)

    train_p, dsel_p = scored(train, "train-pool"), scored(dsel, "dsel-pool")
    test_p = scored(test, "test-pool")
    seconds = {n: timed(lambda m=m: m.score(test).write.format("noop").mode("overwrite").save())[1] for n, m in fitted.items()}
    counts = {"train": train_p.count(), "test": test_p.count()}
    tuning = spark.createDataFrame([{"model": n, **tuning_row(s)} for n, s in searches.items()], TUNING_SCHEMA)
    ids = {"iteration": repeat + 1, "fold": fold + 1}
    store = metrics.append_metrics(
        None, base_rows(train_p, cfg.models, cfg.label).join(tuning, "model").withColumn("fold_size", F.lit(counts["train"])),
        **ids, pool_name="BASE_MODEL", split="resubstitution")
    test_rows = base_rows(test_p, cfg.models, cfg.label)
    store = metrics.append_metrics(
        store, test_rows.withColumns({"fold_size": F.lit(counts["test"]), "score_time": _by_model(seconds)}),
        **ids, pool_name="BASE_MODEL", split="test")
    for pool, members in cfg.pools.items():
        q, d = (voting.select_pool(p, cfg.models, members) for p in (test_p, dsel_p))
        # One job answers all ensembles of a pool, so that they share the neighbour search: its time is theirs together.
        answers, seconds = timed(lambda: materialize(ensemble_answers(q, d, members, cfg, features), "answers"))
        found = measured(answers, cfg.label, ["model"]).withColumns(
            {"fold_size": F.lit(counts["test"]), "score_time": F.lit(seconds)})
        store = metrics.append_metrics(store, found, **ids, pool_name=pool.upper(), split="test")
    return store, fitted


def run_experiment(df: DataFrame, features: list[str], cfg: Settings, path: str, run_id: str) -> DataFrame:
    """All outer runs; each run's rows go to the results table when it is done, and a second start goes on after them.

    Intermediate tables are deleted after the run that wrote them, the planned folds at the end.
    """
    cfg.check()
    require_columns(df, [cfg.row_id, cfg.label, *features])
    column_index(df, [c for c in cfg.scale if c in features or c in config.SCALED_COLUMNS], cfg.label, cfg.row_id)
    spark = df.sparkSession
    with scratch(spark):
        _outer_runs(df, features, cfg, path, run_id)
    return spark.read.option("mergeSchema", True).parquet(path).where(F.col("run_id") == run_id)


def _outer_runs(df: DataFrame, features: list[str], cfg: Settings, path: str, run_id: str) -> None:
    spark = df.sparkSession
    planned = materialize(splits.repeated_folds(df, cfg.splits, cfg.repeats, cfg.seed, cfg.label, cfg.row_id), "folds")
    done = finished_runs(spark, path, run_id)
    for run in cfg.runs if cfg.runs is not None else range(cfg.splits * cfg.repeats):
        repeat, fold = splits.run_position(run, cfg.splits)
        if (repeat + 1, fold + 1) in done:
            continue
        with scratch(spark):
            store, _ = run_once(planned, features, run, cfg)
            append_results(store, path, run_id)


def benchmark_resamplers(df: DataFrame, features: list[str], techniques: list[str] | None = None, folds: int = config.BENCHMARK_SPLITS,
                         seed: int = config.SEED, params: dict | None = None, label: str = config.LABEL, row_id: str = "row_id",
                         model: str = "XGBClassifier", k: int = config.K_BEST) -> DataFrame:
    """Cross-validated scores of one model behind each resampling technique, best first.

    Resampling sees the training folds only. A model made of trees is trained once for all techniques and folds, from shared sums;
    others are trained one after the other. A technique whose ratio a training fold cannot give is not left out: it has a row without
    scores, and a warning says why.
    """
    spark = df.sparkSession
    data = materialize(splits.stratified_folds(df, folds, seed, label, row_id), "folds")
    names = techniques or list(resample.TECHNIQUES)
    if model in TREE_MODELS:
        return metrics.summarise_cv(_benchmark_trees(data, names, features, folds, seed, params or {}, label, row_id, model, k))
    frames = []
    for name in names:
        step = resample.resampler(name, seed)

        def make(train):
            return fit_model(train, model, params or {}, features, seed, label, row_id, k=k, resampler=step)

        try:
            frames.append(cross_validate(data, make, folds, label, tag=name))
        except resample.RatioError as e:
            frames.append(_without_scores(spark, name, folds, e))
    return metrics.summarise_cv(metrics.union_all(frames))


def _without_scores(spark: SparkSession, name: str, folds: int, error: Exception) -> DataFrame:
    """Folds of a technique that cannot be applied to the table."""
    warnings.warn(f"{name} has no scores: {error}", stacklevel=3)
    nulls = [F.lit(None).cast("double").alias(m) for m in ("roc_auc", "f1", "precision", "recall")]
    return spark.range(folds).select(F.lit(name).alias("technique"), F.col("id").cast("int").alias("fold"), *nulls)


def _benchmark_trees(data: DataFrame, names: list[str], features: list[str], folds: int, seed: int, params: dict, label: str, row_id: str, model: str, k: int,
                     parallelism: int = 4) -> DataFrame:
    """Metrics per technique and fold; the resampled training folds are groups of one table, and all models grow together."""
    runs = [(name, fold) for name in names for fold in range(folds)]

    def prepared(run):
        name, fold = run
        train = data.where(F.col("fold") != fold).drop("fold")
        step = resample.resampler(name, seed)
        try:
            rows = materialize(step(train, features, label=label, row_id=row_id) if step else train, "resampled")
        except resample.RatioError as e:
            return e
        steps = fit_feature_steps(rows, features, [c for c in config.SCALED_COLUMNS if c in features], k, label)
        return rows.select(row_id, label, *features), steps.selected_features()[0]

    with ThreadPoolExecutor(max_workers=parallelism) as threads:
        ready = list(threads.map(prepared, runs))
    failed = {name: r for (name, _), r in zip(runs, ready) if isinstance(r, Exception)}
    missing = [_without_scores(data.sparkSession, name, folds, e) for name, e in failed.items()]
    ready = [r for (name, _), r in zip(runs, ready) if name not in failed]
    runs = [(name, fold) for name, fold in runs if name not in failed]
    if not runs:
        return metrics.union_all(missing)
    assemble = VectorAssembler(inputCols=features, outputCol="features").transform
    parts = [assemble(rows).withColumn("g", F.lit(i)) for i, (rows, _) in enumerate(ready)]
    cuts = trees.cut_points(assemble(data), len(features))
    table = trees.binned(metrics.union_all([p.select(row_id, label, "features", "g") for p in parts]), cuts, label, row_id, group=F.col("g"))
    jobs = [tree_job(make_base_model(model, params, seed, label, row_id), i, selected) for i, (_, selected) in enumerate(ready)]
    trees.train(table, jobs)
    test = trees.binned(assemble(data), cuts, label, row_id, group=F.col("fold"))
    scored = trees.score_rows(test, jobs, [fold for _, fold in runs])
    named = data.sparkSession.createDataFrame([(i, name, fold) for i, (name, fold) in enumerate(runs)], "candidate int, technique string, fold int")
    found = metrics.metrics(voting.decide(scored.join(F.broadcast(named), "candidate")), ["technique", "fold"])
    return metrics.union_all([found, *missing])


def score_batch(spark: SparkSession, df: DataFrame, model_paths: dict[str, str], features: list[str], rule: str = "VotingClassifier",
                dsel: DataFrame | None = None, label: str = config.LABEL, row_id: str = "row_id") -> DataFrame:
    """Predictions of saved base models combined by a static or dynamic rule (row_id, p1, pred).

    Dynamic rules need a labelled selection set.
    """
    fitted = {name: load_model(spark, path) for name, path in model_paths.items()}
    if label not in df.columns:
        df = df.withColumn(label, F.lit(None).cast("int"))
    q = pool_scores(df, fitted, label, row_id, features)
    if rule == "VotingClassifier":
        return voting.soft_vote(q).select(row_id, "p1", "pred")
    if dsel is None:
        raise ValueError(f"{rule} needs a selection set")
    members = list(fitted)
    cfg = Settings(models=members, pools={"pool": members}, label=label, row_id=row_id,
                   static=[rule] if rule in config.STATIC_MODELS else [], dynamic=[] if rule in config.STATIC_MODELS else [rule])
    cfg.check()
    q = materialize(q, "pool")
    d = materialize(pool_scores(dsel, fitted, label, row_id, features), "pool")
    return ensemble_answers(q, d, members, cfg, features).select(row_id, "p1", "pred")
