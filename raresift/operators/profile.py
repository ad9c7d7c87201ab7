"""Inspection reports: nulls, classes, duplicates and summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.functions.hashing import hash_key, unit
from raresift.functions.nulls import is_missing, missing_share
from raresift.functions.ranks import ordered_cumsum, replicate


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def head(df: DataFrame, n: int = 5, by: str = "row_id") -> DataFrame:
    return df.orderBy(F.col(by).asc()).limit(n)


def tail(df: DataFrame, n: int = 5, by: str = "row_id") -> DataFrame:
    return df.orderBy(F.col(by).desc()).limit(n)


def _unpivot(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One wide row of ``<field>_<i>`` cells to one row per column."""
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
             for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")


def info(df: DataFrame) -> DataFrame:
    """Type and non-missing count of every column."""
    types = dict(df.dtypes)
    row = df.agg(*[F.count(F.when(~is_missing(df, c), 1)).alias(f"non_null_{i}")
                   for i, c in enumerate(df.columns)],
                 *[F.lit(types[c]).alias(f"dtype_{i}") for i, c in enumerate(df.columns)])
    return _unpivot(row, df.columns, ["dtype", "non_null"])


def describe(df: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, std, min, quantiles and max per numeric column; quantiles are exact.

    Quantiles interpolate between neighbouring ranks. They come from a distributed cumulative count
    over distinct values instead of an aggregate that keeps every distinct value in one buffer.
    """
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    values = (df.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")
              .where(F.col("value").isNotNull() & ~F.isnan("value")))
    moments = values.groupBy("column").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    counts = values.groupBy("column", "value").agg(F.count("*").alias("c"))
    placed = ordered_cumsum(counts, ["column"], "value", ["c"])
    spread = F.col("total_c") - F.lit(1)
    wanted = [(f"q{round(q * 100)}", F.lit(q) * spread) for q in quantiles]
    has = lambda r: (F.col("below_c") <= r) & (r < F.col("below_c") + F.col("c"))
    marks = placed.groupBy("column").agg(
        *[F.max(F.when(has(F.floor(h)), F.col("value"))).alias(f"lo_{n}") for n, h in wanted],
        *[F.max(F.when(has(F.ceil(h)), F.col("value"))).alias(f"hi_{n}") for n, h in wanted],
        *[F.max(h - F.floor(h)).alias(f"w_{n}") for n, h in wanted])
    between = [(F.col(f"lo_{n}") + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) * F.col(f"w_{n}")).alias(n) for n, _ in wanted]
    return (moments.join(marks, "column", "left")
            .select("column", "n", "mean", "std", "min", *between, "max"))


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with missing cells, most first, with their share of the rows."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("_n"),
                 *[F.count(F.when(is_missing(df, c), 1)).alias(f"n_missing_{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n_missing_{i}").alias("n_missing"), "_n")
             for i, c in enumerate(columns)]
    return (row.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*").where("n_missing > 0")
            .select("column", "n_missing", F.round(F.col("n_missing") / F.col("_n") * 100, 3).alias("pct"))
            .orderBy(F.desc("n_missing"), "column"))


def missing_matrix(df: DataFrame, columns: list[str], buckets: int = 64, by: str = "row_id") -> DataFrame:
    """Missing cells per row bucket and column: the numbers behind a missingness heatmap."""
    bucket = F.floor(unit(hash_key("matrix", by)) * F.lit(buckets)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n_rows"),
        *[F.count(F.when(is_missing(df, c), 1)).alias(f"missing_{c}") for c in columns])


def row_missing_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn("missing_pct", missing_share(df, columns))


def drop_sparse_rows(df: DataFrame, columns: list[str] | None = None, limit: float = 50.0) -> DataFrame:
    """Keep rows whose share of missing cells is at most ``limit`` percent.

    The share is generated, so that the filter stays above what makes the columns: moved below, it would hold a copy of a column's expression for every use.
    """
    share = "_share"
    while share in df.columns:
        share += "_"
    kept = df.select("*", F.explode(F.array(missing_share(df, columns))).alias(share)).where(F.col(share) <= limit)
    return kept.drop(share)


def _pct(part, whole):
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def removal_report(before: DataFrame, after: DataFrame, step: str) -> DataFrame:
    """Rows before, rows removed and their percentage (0 for an empty table)."""
    counted = (before.agg(F.count("*").alias("n_before"))
               .select("n_before", F.lit(0).cast("long").alias("n_after"))
               .unionByName(after.agg(F.count("*").alias("n_after"))
                            .select(F.lit(0).cast("long").alias("n_before"), "n_after"))
               .agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after")))
    gone = F.col("n_before") - F.col("n_after")
    return counted.select(F.lit(step).alias("step"), "n_before", gone.alias("n_removed"),
                          F.round(_pct(gone, F.col("n_before")), 3).alias("pct"))


def class_distribution(df: DataFrame, label: str = "Class") -> DataFrame:
    """Count and percentage per class, most first; rows without a class are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # The percentage needs the grand total: an aggregate over the per-class rows only.
    packed = counts.agg(F.sum("n").alias("_total"), F.collect_list(F.struct(label, "n")).alias("_rows"))
    return (packed.select("_total", F.explode("_rows").alias("_r"))
            .select(f"_r.{label}", "_r.n", F.round(F.col("_r.n") / F.col("_total") * 100, 3).alias("pct"))
            .orderBy(F.desc("n"), label))


def role_balance(df: DataFrame, role: str = "role", label: str = "Class") -> DataFrame:
    return df.groupBy(role, label).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their number of copies as ``count``."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of extra copies."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_c"))
    n, extra = F.sum("_c"), F.sum(F.col("_c") - 1)
    return groups.agg(F.coalesce(n, F.lit(0)).alias("n_rows"), F.coalesce(extra, F.lit(0)).alias("n_duplicates")) \
        .withColumn("pct", F.round(_pct(F.col("n_duplicates"), F.col("n_rows")), 3))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row that is in a set of copies, the first one included.

    Copies are equal in all columns, so they are written out from the grouped counts: no join back
    to the table, and a row with millions of copies is spread over the cluster.
    """
    return replicate(duplicate_groups(df), F.col("count"), "_copy").select(*df.columns)


def duplicate_patterns(df: DataFrame) -> DataFrame:
    """Duplicated rows with counts, most first; rows with a missing cell are left out."""
    return duplicate_groups(df.na.drop()).orderBy(F.desc("count"), *df.columns)


def duplicate_frequency(df: DataFrame) -> DataFrame:
    return (duplicate_groups(df.na.drop()).groupBy(F.col("count").alias("repetitions"))
            .agg(F.count("*").alias("n_patterns")).orderBy("repetitions"))


def duplicate_class_share(df: DataFrame, label: str = "Class") -> DataFrame:
    """Rows per class among duplicated rows; the share is of all duplicated rows."""
    counts = duplicate_groups(df).groupBy(label).agg(F.sum("count").alias("n"))
    packed = counts.agg(F.sum("n").alias("_total"), F.collect_list(F.struct(label, "n")).alias("_rows"))
    return (packed.select("_total", F.explode("_rows").alias("_r"))
            .where(F.col(f"_r.{label}").isNotNull())
            .select(f"_r.{label}", "_r.n", F.round(F.col("_r.n") / F.col("_total") * 100, 4).alias("pct")))


def duplicate_patterns_by_class(df: DataFrame, label: str = "Class") -> DataFrame:
    return (duplicate_groups(df.na.drop()).groupBy(label, F.col("count").alias("repetitions"))
            .agg(F.count("*").alias("n_patterns")).orderBy(label, "repetitions"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
