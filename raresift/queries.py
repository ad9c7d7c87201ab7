"""The registered queries: every operator over whole test tables, with its check in SQL where one fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift import oracles as O
from raresift import views as V
from raresift.functions.hashing import hash_key
from raresift.operators import dynamic, features, metrics, models, neighbors, profile, resample, search, splits, voting
from raresift.plans import experiment, jobs
from raresift.sources import model_store, tables
from raresift.sources.storage import materialize, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- profiling ------------------------------------------------------------------------------------

_ALL_NULL = " + ".join(f"CAST({O.missing(c)} AS INT)" for c in O.NUMERIC)
_ORDER = ", ".join(O.NUMERIC)

add("p1_shape", lambda s, d: profile.shape(V.txn(s, d)),
    O.sql(O.TXN, "SELECT count(*) AS n_rows, 9 AS n_columns FROM txn"))
add("p2_head", lambda s, d: profile.head(V.txn(s, d), 10), O.sql(O.TXN, "SELECT * FROM txn ORDER BY row_id LIMIT 10"))
add("p2_tail", lambda s, d: profile.tail(V.txn(s, d), 10), O.sql(O.TXN, "SELECT * FROM txn ORDER BY row_id DESC LIMIT 10"))
add("p3_info", lambda s, d: profile.info(V.null_txn(s, d)),
    O.sql(O.NUL, O.per_column(O.NUL_COLUMNS, lambda c: f"""SELECT '{c}' AS "column",
      '{'string' if c == 'row_id' else 'int' if c == 'Class' else 'double'}' AS dtype,
      count(*) FILTER (NOT {O.missing(c)}) AS non_null FROM nul""")))
add("p4_describe", lambda s, d: rounded(profile.describe(V.null_txn(s, d)), 3),
    O.sql(O.NUL, O.per_column(O.NUMERIC, lambda c: f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 3) AS mean,
      round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 3) AS q25,
      round(quantile_cont({c}::DOUBLE, 0.5), 3) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 3) AS q75,
      round(max({c})::DOUBLE, 3) AS max FROM nul WHERE NOT {O.missing(c)}""")))
add("p5_null_report", lambda s, d: profile.null_report(V.null_txn(s, d)),
    O.sql(O.NUL, 'SELECT "column", n_missing, round(n_missing * 100.0 / (SELECT count(*) FROM nul), 3) AS pct FROM ('
          + O.per_column(O.NUL_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(*) FILTER ({O.missing(c)}) AS n_missing FROM nul")
          + ") WHERE n_missing > 0 ORDER BY n_missing DESC, 1"))
add("p6_missing_matrix", lambda s, d: profile.missing_matrix(V.null_txn(s, d), O.NUMERIC),
    O.sql(O.NUL, f"SELECT CAST(floor({O.unit("'matrix|' || row_id")} * 64) AS INT) AS bucket, count(*) AS n_rows, "
          + ", ".join(f"count(*) FILTER ({O.missing(c)}) AS missing_{c}" for c in O.NUMERIC) + " FROM nul GROUP BY 1"))
add("p7_row_missing", lambda s, d: profile.row_missing_share(V.null_txn(s, d), O.NUMERIC).select("row_id", "missing_pct"),
    O.sql(O.NUL, f"SELECT row_id, ({_ALL_NULL}) / 8.0::DOUBLE * 100 AS missing_pct FROM nul"))
add("p8_drop_sparse", lambda s, d: profile.drop_sparse_rows(V.null_txn(s, d), O.NUMERIC).select("row_id"),
    O.sql(O.NUL, f"SELECT row_id FROM nul WHERE ({_ALL_NULL}) / 8.0::DOUBLE * 100 <= 50"))


def _sparse_report(s, d):
    df = V.null_txn(s, d)
    return profile.removal_report(df, profile.drop_sparse_rows(df, O.NUMERIC), "sparse_rows")


add("p8_drop_report", _sparse_report, O.sql(O.NUL, f"""SELECT 'sparse_rows' AS step, count(*) AS n_before,
  count(*) FILTER (({_ALL_NULL}) / 8.0::DOUBLE * 100 > 50) AS n_removed,
  round(count(*) FILTER (({_ALL_NULL}) / 8.0::DOUBLE * 100 > 50) * 100.0 / count(*), 3) AS pct FROM nul"""))
add("p9_class_distribution", lambda s, d: profile.class_distribution(V.null_txn(s, d)),
    O.sql(O.NUL, """SELECT Class, count(*) AS n, round(count(*) * 100.0 / (SELECT count(Class) FROM nul), 3) AS pct
      FROM nul WHERE Class IS NOT NULL GROUP BY Class ORDER BY n DESC"""))
_GROUPS = f"gr AS (SELECT {_ORDER}, count(*) AS c FROM dup GROUP BY ALL HAVING count(*) > 1)"
add("p10_duplicate_count", lambda s, d: profile.duplicate_count(V.dup_txn(s, d)),
    O.sql(O.DUP + ", " + _GROUPS, """SELECT (SELECT count(*) FROM dup) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates,
      round(sum(c - 1) * 100.0 / (SELECT count(*) FROM dup), 3) AS pct FROM gr"""))
add("p11_duplicate_rows", lambda s, d: profile.duplicate_rows(V.dup_txn(s, d)),
    O.sql(O.DUP, f"SELECT * FROM dup QUALIFY count(*) OVER (PARTITION BY {_ORDER}) > 1"))
add("p12_duplicate_patterns", lambda s, d: profile.duplicate_patterns(V.dup_txn(s, d)),
    O.sql(O.DUP + ", " + _GROUPS, f"SELECT {_ORDER}, c AS count FROM gr"))
add("p13_duplicate_frequency", lambda s, d: profile.duplicate_frequency(V.dup_txn(s, d)),
    O.sql(O.DUP + ", " + _GROUPS, "SELECT c AS repetitions, count(*) AS n_patterns FROM gr GROUP BY c"))
add("p14_duplicate_class_share", lambda s, d: profile.duplicate_class_share(V.dup_txn(s, d)),
    O.sql(O.DUP + ", " + _GROUPS, """SELECT Class, CAST(sum(c) AS BIGINT) AS n,
      round(sum(c) * 100.0 / (SELECT sum(c) FROM gr), 4) AS pct FROM gr GROUP BY Class"""))
add("p15_patterns_by_class", lambda s, d: profile.duplicate_patterns_by_class(V.dup_txn(s, d)),
    O.sql(O.DUP + ", " + _GROUPS, "SELECT Class, c AS repetitions, count(*) AS n_patterns FROM gr GROUP BY ALL"))
add("p16_drop_duplicates", lambda s, d: profile.drop_duplicates(V.dup_txn(s, d)),
    O.sql(O.DUP, "SELECT DISTINCT * FROM dup"))


def _dedup_report(s, d):
    df = V.dup_txn(s, d)
    return profile.removal_report(df, df.dropDuplicates(), "duplicates")


add("p16_dedup_report", _dedup_report, O.sql(O.DUP, """SELECT 'duplicates' AS step, count(*) AS n_before,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup)) AS n_removed,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup))) * 100.0 / count(*), 3) AS pct FROM dup"""))

# --- jobs J1, J2 ------------------------------------------------------------------------------------

add("j1_clean", lambda s, d: jobs.clean(V.dup_txn(s, d))[0], O.sql(O.DUP, "SELECT DISTINCT * FROM dup"))
_NULLS2 = O.NUL + f", kept AS (SELECT {_ORDER} FROM nul WHERE ({_ALL_NULL}) / 8.0::DOUBLE * 100 <= 50)"
add("j1_clean_nulls", lambda s, d: jobs.clean(V.null_txn(s, d).drop("row_id"))[0].agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(f"n_{c}") for c in O.NUMERIC]),
    O.sql(_NULLS2, "SELECT count(*) AS n, " + ", ".join(
        f"count(*) FILTER (NOT {O.missing(c)}) AS n_{c}" for c in O.NUMERIC) + " FROM (SELECT DISTINCT * FROM kept)"))
add("j2_engineer", lambda s, d: rounded(jobs.engineer(V.txn(s, d))),
    O.sql(O.TF, "SELECT row_id, V1, V2, V3, V4, V5, Class, round(Log_Amount, 6) AS Log_Amount FROM tf"))

# --- features -----------------------------------------------------------------------------------------

add("f1_log_amount", lambda s, d: rounded(features.log_amount(V.txn(s, d)).select("row_id", "Log_Amount")),
    O.sql(O.TXN, "SELECT row_id, round(ln(1 + Amount), 6) AS Log_Amount FROM txn"))
add("f2_drop_columns", lambda s, d: features.drop_columns(V.txn(s, d)),
    O.sql(O.TXN, "SELECT * EXCLUDE (Amount, Time) FROM txn"))


def _split(s, d):
    from pyspark.ml.functions import vector_to_array

    return features.split_label(V.vec_features(s, d)).select("row_id", "Class", F.size(vector_to_array("features")).alias("width"))


add("f3_split_label", _split, O.sql(O.VF, "SELECT row_id, Class, 29 AS width FROM vf"))
add("f5_shuffle_key", lambda s, d: splits.shuffled(V.txn(s, d), 42).select("row_id", "shuffle_key"),
    O.sql(O.TXN, "SELECT row_id, md5('42|' || row_id) AS shuffle_key FROM txn"))
add("f6_standardise", lambda s, d: rounded(features.standardise(V.txn_features(s, d))),
    O.sql(O.TF, """SELECT row_id, V1, V2, V3, V4, V5, round((Log_Amount - (SELECT avg(Log_Amount) FROM tf))
      / (SELECT stddev_pop(Log_Amount) FROM tf), 6) AS Log_Amount, Class FROM tf"""))


def _anova_sql(tables: str, src: str, cols: list[str]) -> str:
    def one(c):
        return f"""SELECT '{c}' AS feature, {cols.index(c)} AS position, round((sum(n * (m - g) * (m - g)) / (count(*) - 1))
          / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM (SELECT count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v,
          (SELECT avg({c}) FROM {src}) AS g FROM {src} GROUP BY Class)"""
    return O.sql(tables, O.per_column(cols, one))


add("f7_anova_f", lambda s, d: rounded(features.anova_f(V.txn_features(s, d), V.TXN_FEATURES)),
    _anova_sql(O.TF, "tf", V.TXN_FEATURES))
add("f7_anova_f_docs", lambda s, d: rounded(features.anova_f(V.labelled_docs(s, d), ["V1", "V2", "V3", "V4"])),
    _anova_sql(O.DOCS, "docs", ["V1", "V2", "V3", "V4"]))
add("f7_k_best", lambda s, d: rounded(features.k_best(V.vec_features(s, d), V.VEC_FEATURES)),
    _anova_sql(O.VF, "vf", V.VEC_FEATURES) + " ORDER BY f DESC LIMIT 20")
add("f11_class_weights", lambda s, d: rounded(features.class_weights(V.txn_features(s, d))),
    O.sql(O.TF, "SELECT Class, count(*) AS n, round((SELECT count(*) FROM tf) / (2.0::DOUBLE * count(*)), 6) AS weight FROM tf GROUP BY Class"))

# --- splits -------------------------------------------------------------------------------------------

add("x1_repeated_folds",
    lambda s, d: splits.repeated_folds(V.txn_features(s, d), 10, 3, 42).select("row_id", "Class", "fold_0", "fold_1", "fold_2"),
    O.sql(", ".join([O.TF, *[O.ranked("tf", 42 + r, f"rk{r}") for r in range(3)]]),
          """SELECT row_id, a.Class, CAST(((a.rk - 1) * 10) // a.n AS INT) AS fold_0, CAST(((b.rk - 1) * 10) // b.n AS INT) AS fold_1,
      CAST(((c.rk - 1) * 10) // c.n AS INT) AS fold_2 FROM rk0 a JOIN rk1 b USING (row_id) JOIN rk2 c USING (row_id)"""))
add("x1_ten_repeats", lambda s, d: splits.repeated_folds(V.txn_features(s, d), 10, 10, 42).select("row_id", *[f"fold_{r}" for r in range(10)]),
    O.sql(", ".join([O.TF, *[O.ranked("tf", 42 + r, f"rk{r}") for r in range(10)]]), "SELECT row_id, "
          + ", ".join(f"CAST(((rk{r}.rk - 1) * 10) // rk{r}.n AS INT) AS fold_{r}" for r in range(10))
          + " FROM rk0 " + " ".join(f"JOIN rk{r} USING (row_id)" for r in range(1, 10))))
add("x2_folds", lambda s, d: splits.stratified_folds(V.labelled_docs(s, d), 5, 42).select("row_id", "Class", "fold"),
    O.sql(O.DOCS + ", " + O.ranked("docs", 42), "SELECT row_id, Class, CAST(((rk - 1) * 5) // n AS INT) AS fold FROM rk"))
add("x3_holdout", lambda s, d: splits.holdout(V.txn_features(s, d), 0.15, 7).select("row_id", "Class", "held_out"),
    O.sql(O.TF + ", " + O.ranked("tf", 7), "SELECT row_id, Class, rk <= round(0.15 * n) AS held_out FROM rk"))
add("x4_shuffle_splits", lambda s, d: splits.shuffle_splits(V.txn_features(s, d), 0.2, 2, 42).select("row_id", "val_0", "val_1"),
    O.sql(", ".join([O.TF, O.ranked("tf", "42v0", "r0"), O.ranked("tf", "42v1", "r1")]),
          "SELECT row_id, a.rk <= round(0.2 * a.n) AS val_0, b.rk <= round(0.2 * b.n) AS val_1 FROM r0 a JOIN r1 b USING (row_id)"))


def _rungs(s, d):
    df = V.txn_features(s, d)
    parts = [splits.resource_rung(df, share, 42).groupBy("Class").agg(F.count("*").alias("n"), F.sum("V1").alias("v1"))
             .withColumn("share", F.lit(share)) for share in (0.2, 0.6, 1.0)]
    return metrics.union_all(parts)


add("x5_resource_rungs", _rungs, O.sql(O.TF + ", " + O.ranked("tf", "42r"),
    "SELECT share::DOUBLE AS share, Class, count(*) AS n, sum(V1) AS v1 FROM rk, (VALUES (0.2), (0.6), (1.0)) t(share) WHERE rk <= round(share * n) GROUP BY ALL"))


def _roles(s, d):
    df = splits.stratified_folds(V.txn_features(s, d), 10, 42)
    return splits.with_roles(df, 0, 0.15, 42)


_ROLES_SQL = ", ".join([O.TF, O.ranked("tf", 42, "r0"), """r1 AS (SELECT * EXCLUDE (rk, n), ((rk - 1) * 10) // n AS fold FROM r0),
  tr AS (SELECT * FROM r1 WHERE fold > 0)""", O.ranked("tr", "42d"), """roles AS (SELECT row_id, Class,
  CASE WHEN rk <= round(0.15 * n) THEN 'dsel' ELSE 'train' END AS role FROM rk
  UNION ALL SELECT row_id, Class, 'test' FROM r1 WHERE fold = 0)"""])
add("x3_roles", lambda s, d: _roles(s, d).select("row_id", "role"), O.sql(_ROLES_SQL, "SELECT row_id, role FROM roles"))
add("p17_role_balance", lambda s, d: profile.role_balance(_roles(s, d)),
    O.sql(_ROLES_SQL, "SELECT role, Class, count(*) AS n FROM roles GROUP BY ALL"))

# --- metrics --------------------------------------------------------------------------------------------


def _pool(s, d):
    return V.formula_pool(V.txn_features(s, d))


def _scored(s, d):
    folds = splits.stratified_folds(_pool(s, d), 10, 42)
    return voting.pool_long(folds, V.POOL_NAMES, keep=("fold",))


_SCORED_SQL = ", ".join([O.TF, O.ranked("tf", 42, "r0"), "fl AS (SELECT *, CAST(((rk - 1) * 10) // n AS INT) AS fold FROM r0)",
                         O.pool_long("fl", keep="fold, ")])
_METRIC_SQL = O.all_metrics("pl", ["fold", "clf"])
add("e1_confusion", lambda s, d: metrics.confusion(_scored(s, d), ["fold", "clf"]),
    O.sql(_SCORED_SQL + ", " + O.confusion("pl", "fold, clf"), "SELECT * FROM cf"))
add("e2_rates", lambda s, d: rounded(metrics.rates(metrics.confusion(_scored(s, d), ["fold", "clf"])).select("fold", "clf", "tnr", "fpr", "tpr")),
    O.sql(_SCORED_SQL + ", " + O.confusion("pl", "fold, clf"), "SELECT fold, clf, " + ", ".join(f"round({O.SCORES[m]}, 6) AS {m}" for m in ("tnr", "fpr", "tpr")) + " FROM cf"))
add("e3_basic_scores", lambda s, d: rounded(metrics.basic_scores(metrics.confusion(_scored(s, d), ["clf"]))),
    O.sql(_SCORED_SQL + ", " + O.confusion("pl", "clf"), "SELECT *, " + ", ".join(f"round({O.SCORES[m]}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1")) + " FROM cf"))
add("e4_balanced_accuracy", lambda s, d: rounded(metrics.balanced_accuracy(metrics.confusion(_scored(s, d), ["clf"])).select("clf", "balanced_accuracy")),
    O.sql(_SCORED_SQL + ", " + O.confusion("pl", "clf"), f"SELECT clf, round({O.SCORES['balanced_accuracy']}, 6) AS balanced_accuracy FROM cf"))
add("e5_kappa", lambda s, d: rounded(metrics.kappa(metrics.confusion(_scored(s, d), ["clf"])).select("clf", "kappa")),
    O.sql(_SCORED_SQL + ", " + O.confusion("pl", "clf"), f"SELECT clf, round({O.SCORES['kappa']}, 6) AS kappa FROM cf"))
add("e6_roc_auc", lambda s, d: rounded(metrics.roc_auc(_scored(s, d), ["fold", "clf"])),
    O.sql(_SCORED_SQL + ", " + O.curve("pl", "fold, clf"), "SELECT fold, clf, round(roc_auc, 6) AS roc_auc FROM cv"))
add("e7_average_precision", lambda s, d: rounded(metrics.average_precision(_scored(s, d), ["fold", "clf"])),
    O.sql(_SCORED_SQL + ", " + O.curve("pl", "fold, clf"), "SELECT fold, clf, round(average_precision, 6) AS average_precision FROM cv"))


def _continuous(s, d):
    """One smooth score per row, with almost as many distinct values as rows."""
    df = V.txn_features(s, d)
    z = F.col("V2") * 10 + F.col("Log_Amount") / 10
    return df.select(F.col("Class").alias("y"), F.lit("m").alias("model"), z.alias("p1"))


add("e6_roc_auc_continuous", lambda s, d: rounded(metrics.roc_auc(_continuous(s, d), ["model"])),
    O.sql(O.TF + ", cs AS (SELECT Class AS y, 'm' AS model, V2 * 10 + Log_Amount / 10 AS p1 FROM tf), " + O.curve("cs", "model"),
          "SELECT model, round(roc_auc, 6) AS roc_auc FROM cv"))
add("e_all_metrics", lambda s, d: rounded(metrics.metrics(_scored(s, d), ["fold", "clf"])),
    O.sql(_SCORED_SQL + ", " + _METRIC_SQL[0], _METRIC_SQL[1]))

_DSEL_SQL = ", ".join([O.TF, O.ranked("tf", 7), "ds AS (SELECT * FROM rk WHERE rk <= round(0.15 * n))",
                       "qs AS (SELECT * FROM rk WHERE rk > round(0.15 * n))", O.pool_long("ds", "dl"), O.confusion("dl", "clf, j")])


def _dsel_and_queries(s, d):
    # Searches read both sides more than once, so the split is written out first.
    df = materialize(splits.holdout(_pool(s, d), 0.15, 7), "split")
    return df.where("held_out").drop("held_out"), df.where(~F.col("held_out")).drop("held_out")


def _weights(s, d):
    return metrics.voting_weights(voting.pool_long(_dsel_and_queries(s, d)[0], V.POOL_NAMES), "f1")


add("e9_voting_weights", lambda s, d: rounded(_weights(s, d).select("clf", "weight")),
    O.sql(_DSEL_SQL, f"SELECT clf, round(f1 / sum(f1) OVER (), 6) AS weight FROM (SELECT clf, {O.SCORES['f1']} AS f1 FROM cf)"))


def _append(s, d):
    rows = metrics.metrics(_scored(s, d), ["fold", "clf"]).select("fold", F.col("clf").alias("model"), "f1", "tp")
    test = metrics.append_metrics(None, rows, iteration=1, pool_name="BASE_MODEL", split="test")
    return rounded(metrics.append_metrics(test, rows.withColumn("fold_size", F.lit(1)), iteration=2, pool_name="BASE_MODEL", split="resubstitution"))


_APPEND = f"fold, clf AS model, round({O.SCORES['f1']}, 6) AS f1, tp"
add("e10_append_metrics", _append, O.sql(_SCORED_SQL + ", " + O.confusion("pl", "fold, clf"),
    f"""SELECT 1 AS iteration, 'BASE_MODEL' AS pool_name, 'test' AS split, {_APPEND}, CAST(NULL AS INT) AS fold_size FROM cf
    UNION ALL SELECT 2, 'BASE_MODEL', 'resubstitution', {_APPEND}, 1 FROM cf"""))
add("e11_summarise_cv",
    lambda s, d: rounded(metrics.summarise_cv(metrics.metrics(_scored(s, d), ["fold", "clf"]), group="clf")
                         .select("clf", "roc_auc_mean", "roc_auc_std", "f1_mean", "f1_std", "precision_mean", "precision_std", "recall_mean", "recall_std")),
    O.sql(_SCORED_SQL + ", " + _METRIC_SQL[0] + f", mm AS (SELECT clf, roc_auc, {O.SCORES['f1']} AS f1, {O.SCORES['precision']} AS precision, {O.SCORES['recall']} AS recall FROM cf JOIN cv USING (fold, clf))",
          "SELECT clf, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("roc_auc", "f1", "precision", "recall")) + " FROM mm GROUP BY clf"))

# --- static ensembles -----------------------------------------------------------------------------------


def _answer(df):
    return rounded(df.select("row_id", "p1", "pred"))


add("t1_soft_vote", lambda s, d: _answer(voting.soft_vote(_dsel_and_queries(s, d)[1])),
    O.sql(_DSEL_SQL, f"SELECT row_id, round(list_sum(p) / 8, 6) AS p1, CAST(list_sum(p) / 8 > 0.5 AS INT) AS pred FROM (SELECT row_id, {O.POOL_SQL} AS p FROM qs)"))


def _weighted(s, d):
    weights = [r["weight"] for r in _weights(s, d).orderBy("clf_idx").collect()]
    return _answer(voting.weighted_vote(_dsel_and_queries(s, d)[1], weights))


add("t2_weighted_vote", _weighted, O.sql(_DSEL_SQL + ", " + O.pool_long("qs", "ql"), f"""SELECT row_id, round(sum(w * p1) / sum(w), 6) AS p1,
  CAST(sum(w * p1) / sum(w) > 0.5 AS INT) AS pred FROM ql JOIN (SELECT j, {O.SCORES['f1']} AS w FROM cf) USING (j) GROUP BY row_id"""))
add("t3_stacked", lambda s, d: _answer(voting.stacked(*_dsel_and_queries(s, d))))

# --- neighbours --------------------------------------------------------------------------------------------


def _rare(s, d):
    return V.txn_features(s, d).where("Class = 1")


def _pairs(df):
    return df.select("q", F.col("rank").cast("int").alias("rank"), "d_id", F.round("dist", 6).alias("dist"))


_RARE_TF = O.TF + ", rr AS (SELECT * FROM tf WHERE Class = 1)"
_PAIR_SQL = "SELECT q, CAST(rank AS INT) AS rank, id AS d_id, round({d}, 6) AS dist FROM nn"
add("n1_knn_join", lambda s, d: _pairs(neighbors.knn_join(V.txn_features(s, d), _rare(s, d), 8, V.TXN_FEATURES)),
    O.sql(_RARE_TF + ", " + O.knn("tf", "rr", 8, V.TXN_FEATURES, "nn"), _PAIR_SQL.format(d="sqrt(dist)")))
add("n1_knn_join_blocks",
    lambda s, d: _pairs(neighbors.knn_join(V.txn_features(s, d), _rare(s, d), 8, V.TXN_FEATURES, broadcast_rows=0, block_rows=64)),
    ORACLES["n1_knn_join"])
add("n1_knn_few_queries", lambda s, d: _pairs(neighbors.knn_join(_rare(s, d), V.txn_features(s, d), 8, V.TXN_FEATURES, exclude_self=True)),
    O.sql(_RARE_TF + ", " + O.knn("rr", "tf", 8, V.TXN_FEATURES, "nn", True), _PAIR_SQL.format(d="sqrt(dist)")))
add("n1_knn_self_join", lambda s, d: _pairs(neighbors.knn_join(V.txn_features(s, d), V.txn_features(s, d), 3, V.TXN_FEATURES, exclude_self=True)))
add("n2_knn_manhattan", lambda s, d: _pairs(neighbors.knn_join(V.txn_features(s, d), _rare(s, d), 8, V.TXN_FEATURES, p=1)),
    O.sql(_RARE_TF + ", " + O.knn("tf", "rr", 8, V.TXN_FEATURES, "nn", p=1), _PAIR_SQL.format(d="dist")))
add("n1_knn_vectors", lambda s, d: _pairs(neighbors.knn_join(V.vec_features(s, d), V.vec_features(s, d), 8, V.VEC_FEATURES, exclude_self=True)),
    O.sql(O.VF + ", " + O.knn("vf", "vf", 8, V.VEC_FEATURES, "nn", True), _PAIR_SQL.format(d="sqrt(dist)")))


def _even(s, d):
    return neighbors.knne_join(V.vec_features(s, d), V.vec_features(s, d), 8, V.VEC_FEATURES)


add("n3_knne_join", lambda s, d: _even(s, d).select("q", F.col("rank").cast("int").alias("rank"), "d_id", F.round("dist", 6).alias("dist"), F.col("y").cast("int").alias("y")),
    O.sql(O.VF + ", v0 AS (SELECT * FROM vf WHERE Class = 0), v1 AS (SELECT * FROM vf WHERE Class = 1), "
          + O.knn("vf", "v0", 4, V.VEC_FEATURES, "n0") + ", " + O.knn("vf", "v1", 4, V.VEC_FEATURES, "n1"),
          """SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY dist, id) AS INT) AS rank, id AS d_id, round(sqrt(dist), 6) AS dist, y
          FROM (SELECT q, dist, id, 0 AS y FROM n0 UNION ALL SELECT q, dist, id, 1 AS y FROM n1)"""))


def _profile_pairs(s, d):
    dsel, q = _dsel_and_queries(s, d)
    _, hard = dynamic.split_agreement(q)
    found = dynamic.with_profile_region(hard, dsel, len(V.POOL))
    return found.select(F.col("row_id").alias("q"), F.posexplode("profile").alias("i", "e")).select(
        "q", (F.col("i") + 1).alias("rank"), F.col("e.id").alias("d_id"), F.round(F.sqrt("e.dist"), 6).alias("dist"))


add("n4_profile_knn", _profile_pairs, O.sql(O.dynamic_tables(kind="profile"),
    "SELECT q, CAST(rank AS INT) AS rank, id AS d_id, round(sqrt(dist), 6) AS dist FROM nb"))


def _first_dsel(dsel, n=5, seed="7c"):
    return dsel.withColumn("_h", hash_key(seed)).orderBy("_h", "row_id").limit(n).drop("_h")


def _assigned(s, d):
    dsel, q = _dsel_and_queries(s, d)
    return neighbors.assign_cluster(q, _first_dsel(dsel), V.TXN_FEATURES).select("row_id", "cluster")


def _clustered_rows(s, d):
    """Queries by the nearest of five k-means centroids of the selection set."""
    dsel, q = _dsel_and_queries(s, d)
    centres = neighbors.lloyd(dsel, _first_dsel(dsel), V.TXN_FEATURES)
    return neighbors.assign_cluster(q, centres, V.TXN_FEATURES).select("row_id", "cluster")


add("n5_kmeans_clusters", _clustered_rows)
add("n5_assign_cluster", _assigned, O.sql(_DSEL_SQL + ", cen AS (SELECT * FROM ds ORDER BY md5('7c|' || row_id), row_id LIMIT 5), "
    + O.knn("qs", "cen", 1, V.TXN_FEATURES, "nn"), "SELECT q AS row_id, id AS cluster FROM nn"))

# --- dynamic selection ------------------------------------------------------------------------------------------


def _dynamic(name):
    def run(s, d):
        dsel, q = _dsel_and_queries(s, d)
        return _answer(dynamic.dynamic_select(q, dsel, [name], len(V.POOL), V.TXN_FEATURES))

    return run


add("d0a_agreement", lambda s, d: _answer(dynamic.split_agreement(_dsel_and_queries(s, d)[1])[0]),
    O.sql(O.dynamic_tables(), "SELECT row_id, round(list_sum(p) / 8, 6) AS p1, CAST(list_sum(p) / 8 > 0.5 AS INT) AS pred FROM q WHERE row_id NOT IN (SELECT row_id FROM hard)"))


def _region(s, d):
    dsel, q = _dsel_and_queries(s, d)
    return dynamic.with_regions(dynamic.split_agreement(q)[1], dsel, V.TXN_FEATURES)


def _kept(s, d):
    region = _region(s, d).withColumn("_r", dynamic.described("even"))
    return (region.select("row_id", F.posexplode(dynamic.frienemy_keep(F.col("_r"))).alias("clf_idx", "keep"))
            .groupBy("row_id").agg(F.sum(F.col("keep").cast("int")).alias("n_kept")))


add("d0b_frienemy_prune", _kept, O.sql(O.dynamic_tables() + ", " + O._prune(True),
    "SELECT q AS row_id, count(*) FILTER (keep) AS n_kept FROM kp GROUP BY q"))


def _gated(s, d):
    return _answer(dynamic.hardness_gate(_region(s, d), "KNORAU", 0.3, "plain"))


add("d0e_hardness_gate", _gated, O.gated("KNORAU", 0.3))
for _i, _n in enumerate(["OLA", "LCA", "MLA", "APriori", "APosteriori", "KNORAE", "KNORAU", "DESP"], 1):
    add(f"d{_i}_{_n.lower()}", _dynamic(_n), O.selector(_n))
add("d9_desknn", _dynamic("DESKNN"), O.desknn())


def _clustered(s, d):
    dsel, q = _dsel_and_queries(s, d)
    return _answer(dynamic.desclustering(q, dsel, _first_dsel(dsel), V.TXN_FEATURES, len(V.POOL)))


add("d10_desclustering", _clustered, O.desclustering())


def _kmeans_clustered(s, d):
    dsel, q = _dsel_and_queries(s, d)
    centres = neighbors.lloyd(dsel, _first_dsel(dsel), V.TXN_FEATURES)
    return _answer(dynamic.desclustering(q, dsel, centres, V.TXN_FEATURES, len(V.POOL)))


add("d10_desclustering_kmeans", _kmeans_clustered)
for _i, _n in enumerate(["KNOP", "RRC", "DESKL", "Exponential", "Logarithmic"], 11):
    add(f"d{_i}_{_n.lower()}", _dynamic(_n), O.selector(_n))


def _meta(s, d):
    dsel, q = _dsel_and_queries(s, d)
    return _answer(dynamic.metades(q, dsel, len(V.POOL), V.TXN_FEATURES))


add("d16_metades", _meta)


def _every_selector(s, d):
    dsel, q = _dsel_and_queries(s, d)
    out = dynamic.dynamic_select(q, dsel, dynamic.REGION_SELECTORS, len(V.POOL), V.TXN_FEATURES)
    # sums of floating-point numbers differ in the last digits with their order; equal scores must stay equal
    out = out.withColumn("p1", F.round("p1", 9)).withColumnRenamed("Class", "y")
    return rounded(metrics.metrics(out, ["model"]))


add("d_all_selectors", _every_selector, O.every_selector())

# --- resampling -----------------------------------------------------------------------------------------------------


def _rows(df):
    return rounded(df)


def rare_features(s, d):
    rare = (F.col("V1") >= 49) & (F.col("V2") >= 0.095)
    return V.txn_features(s, d).withColumn("Class", F.when(rare, 1).otherwise(0))


def _on_txn(step):
    return lambda s, d: _rows(step(V.txn_features(s, d), V.TXN_FEATURES))


def _on_vec(step):
    return lambda s, d: _rows(step(V.vec_features(s, d), V.VEC_FEATURES))


_TO = O.TF + ", " + O.origin("tf", "t0")
_VO = O.VF + ", " + O.origin("vf", "t0")
_TXN_OUT, _VEC_OUT = O.resampled("out", V.TXN_FEATURES), O.resampled("out", V.VEC_FEATURES)


def _txn_sql(*parts):
    return O.sql(", ".join([_TO, *parts]), _TXN_OUT)


def _vec_sql(*parts):
    return O.sql(", ".join([_VO, *parts]), _VEC_OUT)


add("r1_under_sample", _on_txn(resample.resampler("RandomUnderSampler")), _txn_sql(O.under("t0", "out", 1.0, 42)))
add("r2_under_05", _on_txn(lambda df, f: resample.under_sample(df, f, 0.05)), _txn_sql(O.under("t0", "out", 0.05, 42)))
add("r3_smote", _on_txn(resample.resampler("SMOTE")), _txn_sql(O.smote("t0", "out", V.TXN_FEATURES, 42)))
add("r4_adasyn", _on_txn(resample.resampler("ADASYN")), _txn_sql(O.adasyn("t0", "out", V.TXN_FEATURES, 42)))
add("r5_borderline_smote", _on_txn(resample.resampler("BorderlineSMOTE")), _txn_sql(O.borderline("t0", "out", V.TXN_FEATURES, 42)))
add("r6_enn", _on_vec(resample.resampler("EditedNearestNeighbours")), _vec_sql(O.enn("t0", "out", V.VEC_FEATURES)))
add("r6_enn_txn", _on_txn(resample.resampler("EditedNearestNeighbours")))
add("r7_tomek", _on_vec(resample.tomek), _vec_sql(O.tomek("t0", "out", V.VEC_FEATURES)))
add("r7_tomek_txn", _on_txn(resample.tomek), _txn_sql(O.tomek_rare("t0", "out", V.TXN_FEATURES)))
add("r8_smote_enn", _on_vec(resample.resampler("SMOTEENN")),
    _vec_sql(O.smote("t0", "t1", V.VEC_FEATURES, 42), O.enn("t1", "out", V.VEC_FEATURES, classes="all")))
add("r9_smote_tomek", _on_vec(resample.resampler("SMOTETomek")),
    _vec_sql(O.smote("t0", "t1", V.VEC_FEATURES, 42), O.tomek("t1", "out", V.VEC_FEATURES, "all")))
add("r10_ncr", _on_vec(lambda df, f: resample.ncr(df, f)), _vec_sql(O.ncr("t0", "out", V.VEC_FEATURES)))
add("r11_oss", _on_vec(lambda df, f: resample.oss(df, f)), _vec_sql(O.oss("t0", "out", V.VEC_FEATURES, 42)))
add("r12_cluster_centroids", _on_vec(lambda df, f: resample.cluster_centroids(df, f, iterations=2)),
    _vec_sql(O.centroids("t0", "out", V.VEC_FEATURES, 42, 2)))
add("r12_cluster_centroids_at_rest", _on_vec(lambda df, f: resample.cluster_centroids(df, f)))
add("r13_under_0_005", lambda s, d: _rows(resample.resampler("Under_0.005")(rare_features(s, d), V.TXN_FEATURES)),
    O.sql(", ".join([O.RARE, O.origin("rf", "t0"), O.under("t0", "out", 0.005, 42)]), _TXN_OUT))
add("r13_under20_smoteenn", _on_vec(resample.resampler("Under20_SMOTEENN")),
    _vec_sql(O.under("t0", "t1", 0.20, 42), O.smote("t1", "t2", V.VEC_FEATURES, 42), O.enn("t2", "out", V.VEC_FEATURES, classes="all")))


def _under_smoteenn(ratio):
    return _txn_sql(O.under("t0", "t1", ratio, 42), O.smote("t1", "t2", V.TXN_FEATURES, 42), O.enn("t2", "out", V.TXN_FEATURES, classes="all"))


add("r13_under05_smoteenn_txn", _on_txn(resample.resampler("Under05_SMOTEENN")), _under_smoteenn(0.05))
add("r13_under10_smoteenn_txn", _on_txn(resample.resampler("Under10_SMOTEENN")), _under_smoteenn(0.10))
add("r13_oss_smote", _on_vec(resample.resampler("OSS_SMOTE")),
    _vec_sql(O.oss("t0", "t1", V.VEC_FEATURES, 42), O.smote("t1", "out", V.VEC_FEATURES, 42)))
add("r13_tomek_smote", _on_vec(resample.resampler("Tomek_SMOTE")),
    _vec_sql(O.tomek("t0", "t1", V.VEC_FEATURES), O.smote("t1", "out", V.VEC_FEATURES, 42)))
add("r13_ncr_smote", _on_vec(resample.resampler("NCR_SMOTE")),
    _vec_sql(O.ncr("t0", "t1", V.VEC_FEATURES), O.smote("t1", "out", V.VEC_FEATURES, 42)))
add("r13_cluster_centroids_smoteenn", _on_vec(resample.resampler("ClusterCentroids_SMOTEENN")))
add("r13_under_0_005_smoteenn", lambda s, d: _rows(resample.resampler("Under_0.005_SMOTEENN")(rare_features(s, d), V.TXN_FEATURES)))


def _before_after(s, d):
    df = V.txn_features(s, d)
    return _rows(resample.before_after(df, resample.smote(df, V.TXN_FEATURES)))


add("r15_before_after", _before_after, O.sql(", ".join([_TO, O.smote("t0", "out", V.TXN_FEATURES, 42)]),
    "SELECT round(V1, 6) AS V1, round(V2, 6) AS V2, Class, 'before' AS stage FROM tf UNION ALL SELECT round(V1, 6), round(V2, 6), Class, 'after' FROM out"))


# --- sources and sinks --------------------------------------------------------------------------------------------------


def _csv_round_trip(s, d):
    import uuid

    path = f"{work_dir(s)}/csv-{uuid.uuid4().hex}"
    tables.save_csv(V.null_txn(s, d), path, delimiter=";")
    return tables.load_csv(s, path, delimiter=";", dtype=V.null_txn(s, d).schema)


add("s1_s2_csv_round_trip", _csv_round_trip, O.sql(O.NUL, "SELECT row_id, " + ", ".join(
    f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c != "Class" else c for c in O.NUMERIC) + " FROM nul"))


def _results_store(s, d):
    import uuid

    path = f"{work_dir(s)}/results-{uuid.uuid4().hex}"
    rows = metrics.metrics(_scored(s, d), ["fold", "clf"])
    run = "run_1"
    for split in ("test", "resubstitution"):
        tables.append_results(metrics.append_metrics(None, rows, iteration=1, split=split), path, run)
    return rounded(s.read.parquet(path).select("run_id", "split", "fold", "clf", "f1", "tp"))


add("s3_s5_results_store", _results_store, O.sql(_SCORED_SQL + ", " + O.confusion("pl", "fold, clf"),
    f"SELECT 'run_1' AS run_id, split, fold, clf, round({O.SCORES['f1']}, 6) AS f1, tp FROM cf, (VALUES ('test'), ('resubstitution')) t(split)"))


def _csv_quoted(s, d):
    """Cells with quotes, separators, backslashes and line breaks, written and read again."""
    import uuid

    path = f"{work_dir(s)}/csv-{uuid.uuid4().hex}"
    note = F.concat(F.lit('say "'), F.col("c_name"), F.lit('", then\n'), F.col("c_mktsegment"), F.lit(' \\ '), F.col("c_acctbal").cast("string"), F.lit('"'))
    tables.save_csv(V.table(s, d, "customer").select("c_custkey", note.alias("note"), F.lit(" kept ").alias("pad")), path)
    return tables.load_csv(s, path)


add("s1_s2_csv_quoted", _csv_quoted, """SELECT c_custkey, 'say "' || c_name || '", then' || chr(10) || c_mktsegment || ' \\ ' || CAST(c_acctbal AS VARCHAR) || '"' AS note,
  ' kept ' AS pad FROM customer""")


def _checked_source(s, d):
    tables.require_source(s, f"{d}/lineitem.parquet")
    return tables.require_columns(V.table(s, d, "lineitem"), ["l_quantity", "l_discount"]).agg(F.count("*").alias("n"))


add("s4_require_source", _checked_source, "SELECT count(*) AS n FROM lineitem")

# --- base models, search, jobs --------------------------------------------------------------------------------------------

def _selected(s, d):
    df = V.txn_features(s, d)
    steps = features.fit_feature_steps(df, V.TXN_FEATURES)
    index, names = steps.selected_features()
    return s.createDataFrame([(i, n) for i, n in zip(index, names)], "position int, feature string")


add("f8_f10_selected_features", _selected)


def _model(name, params=None, step=None):
    """Fit on the training share, measure on the rows held out."""
    def run(s, d):
        split = materialize(splits.holdout(V.txn_features(s, d), 0.15, 7), "split")
        train, test = split.where("not held_out"), split.where("held_out")
        resampler = resample.resampler(step) if step else None
        fitted = search.fit_model(train, name, params or {}, V.TXN_FEATURES, resampler=resampler)
        out = voting.decide(fitted.score(test)).select(F.lit(name).alias("model"), F.col("Class").alias("y"), "p1", "pred")
        return rounded(metrics.metrics(out, ["model"]))

    return run


for _i, _n in enumerate(["DecisionTreeClassifier", "RandomForestClassifier", "ExtraTreesClassifier", "BalancedRandomForestClassifier",
                         "AdaBoostClassifier", "LogitBoostClassifier", "XGBClassifier", "RUSBoostClassifier", "MLPClassifier", "SVC",
                         "KNeighborsClassifier", "LogisticRegression"], 1):
    add(f"m{_i}_{_n.lower()}", _model(_n))
add("m10_svc_linear", _model("SVC", {"kernel": "linear", "C": 1.0}))
add("m10_svc_poly", _model("SVC", {"kernel": "poly", "degree": 2, "C": 1.0}))
add("r14_resampled_fit", _model("DecisionTreeClassifier", step="Under20_SMOTEENN"))


def _neighbour_votes(weights, p):
    def run(s, d):
        split = splits.holdout(V.vec_features(s, d), 0.15, 7)
        dsel, q = split.where("held_out"), split.where(~F.col("held_out"))
        found = neighbors.with_neighbours(q, dsel, 7, V.VEC_FEATURES, payload=["Class"], p=p, name="nn")
        return rounded(found.select("row_id", models.neighbour_vote("nn", weights, p=p).alias("p1")))

    return run


def _vote_sql(weights, p):
    dist = "sqrt(dist)" if p == 2 else "dist"
    vote = "avg(d.Class)" if weights == "uniform" else f"""CASE WHEN min(dist) = 0 THEN avg(d.Class) FILTER (dist = 0)
      ELSE sum(d.Class / {dist}) / sum(1 / {dist}) END"""
    return O.sql(", ".join([O.VF, O.ranked("vf", 7), "ds AS (SELECT * FROM rk WHERE rk <= round(0.15 * n))",
                            "qs AS (SELECT * FROM rk WHERE rk > round(0.15 * n))", O.knn("qs", "ds", 7, V.VEC_FEATURES, "nn", p=p)]),
                 f"SELECT q AS row_id, round({vote}, 6) AS p1 FROM nn JOIN ds d ON d.row_id = nn.id GROUP BY q")


add("m11_knn_vote_uniform", _neighbour_votes("uniform", 2), _vote_sql("uniform", 2))
add("m11_knn_vote_distance", _neighbour_votes("distance", 1), _vote_sql("distance", 1))


def _halving(s, d):
    found = search.halving_search(V.txn_features(s, d), "DecisionTreeClassifier", V.TXN_FEATURES)
    return s.createDataFrame([{"model": "DecisionTreeClassifier", **search.tuning_row(found)}], experiment.TUNING_SCHEMA).drop("tuning_time")


add("h2_halving_search", _halving)


def _cross_validated(s, d):
    df = materialize(splits.stratified_folds(V.txn_features(s, d), 5, 42), "folds")
    make = lambda train: search.fit_model(train, "DecisionTreeClassifier", {}, V.TXN_FEATURES)
    return rounded(search.cross_validate(df, make, 5).select("technique", "fold", "roc_auc", "f1", "precision", "recall"))


add("h5_cross_validate", _cross_validated)


def _experiment(s, d):
    """One whole outer run of the 10 x 10 protocol: eleven models, 30 candidates each, three pools, all selectors. ``Settings()`` alone names all hundred."""
    import uuid

    out = experiment.run_experiment(V.txn_features(s, d), V.TXN_FEATURES, experiment.Settings(runs=[0]), f"{work_dir(s)}/experiment-{uuid.uuid4().hex}", "run_1")
    return rounded(out.select("split", "pool_name", "model", *metrics.METRICS))


add("j3_experiment", _experiment)
# all techniques behind one model, on line items and on the small table of vectors
add("j7_benchmark", lambda s, d: rounded(experiment.benchmark_resamplers(V.txn_features(s, d), V.TXN_FEATURES)))
add("j7_benchmark_all", lambda s, d: rounded(experiment.benchmark_resamplers(V.vec_features(s, d), V.VEC_FEATURES)))


def _batch(s, d):
    import uuid

    split = materialize(splits.holdout(V.txn_features(s, d), 0.15, 7), "split")
    train, rest = split.where(~F.col("held_out")).drop("held_out"), split.where("held_out").drop("held_out")
    paths = {}
    for name in ("DecisionTreeClassifier", "LogisticRegression"):
        paths[name] = f"{work_dir(s)}/model-{uuid.uuid4().hex}"
        model_store.save_model(s, search.fit_model(train, name, {}, V.TXN_FEATURES), paths[name])
    return rounded(experiment.score_batch(s, rest.drop("Class"), paths, V.TXN_FEATURES, "KNORAU", train))


add("j8_score_batch", _batch)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Line items: clean -> features -> selection set -> fixed pool -> KNORA-U -> metrics."""
    rows, _ = jobs.clean(V.txn(s, d))
    pool = V.formula_pool(jobs.engineer(rows))
    split = materialize(splits.holdout(pool, 0.15, 7), "split")
    dsel, q = split.where("held_out").drop("held_out"), split.where(~F.col("held_out")).drop("held_out")
    out = dynamic.dynamic_select(q, dsel, ["KNORAU"], len(V.POOL), V.TXN_FEATURES)
    return metrics.metrics(out.withColumnRenamed("Class", "y"), ["model"])
