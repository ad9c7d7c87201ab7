"""Data preparation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.operators import profile
from raresift.operators.features import drop_columns, log_amount
from raresift.sources.storage import materialize
from raresift.sources.tables import RAW_SCHEMA, load_csv, require_columns, save_csv


def clean(df: DataFrame, label: str = "Class") -> tuple[DataFrame, DataFrame]:
    """Drop mostly-missing rows, then exact duplicates. Returns (clean rows, report).

    The report has one row per fact: (section, item, n, pct).
    """
    require_columns(df, [label])
    kept = profile.drop_sparse_rows(df)
    unique = profile.drop_duplicates(kept)

    def classes(d, section):
        return profile.class_distribution(d, label).select(
            F.lit(section).alias("section"), F.col(label).cast("string").alias("item"), "n", "pct")

    def removed(before, after, section):
        return profile.removal_report(before, after, section).select(
            F.lit("removed").alias("section"), F.col("step").alias("item"), F.col("n_removed").alias("n"), "pct")

    nulls = profile.null_report(df).select(F.lit("missing").alias("section"), F.col("column").alias("item"),
                                           F.col("n_missing").alias("n"), "pct")
    report = (nulls.unionByName(removed(df, kept, "sparse_rows")).unionByName(classes(kept, "classes_before"))
              .unionByName(removed(kept, unique, "duplicates")).unionByName(classes(unique, "classes_after")))
    return unique, report


def engineer(df: DataFrame) -> DataFrame:
    """Add Log_Amount, drop Amount and Time."""
    return drop_columns(log_amount(df))


def cleaning_job(spark: SparkSession, source: str, target: str, schema=RAW_SCHEMA) -> DataFrame:
    """Raw CSV to clean CSV; returns the report."""
    df = materialize(load_csv(spark, source, dtype=schema), "raw")
    cleaned, report = clean(df)
    save_csv(cleaned, target)
    return report


def features_job(spark: SparkSession, source: str, target: str, schema=RAW_SCHEMA) -> None:
    save_csv(engineer(load_csv(spark, source, dtype=schema)), target)
