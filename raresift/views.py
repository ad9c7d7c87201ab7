"""Labelled tables made from the supplied test tables; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.functions.hashing import hash_key, unit

TXN_FEATURES = ["V1", "V2", "V3", "V4", "V5", "Log_Amount"]
TXN_COLUMNS = ["Time", "V1", "V2", "V3", "V4", "V5", "Amount", "Class"]
VEC_FEATURES = [f"V{i}" for i in range(1, 29)] + ["Log_Amount"]

# Fixed values of the formula pool: scorer i is p1 = 0.5 + 0.5 z/(1+|z|), z = slope*(V - cut).
POOL = [
    ("s1", "V1", 1.0, 47.5), ("s2", "V2", 200.0, 0.0875), ("s3", "V1", 0.5, 46.25),
    ("s4", "V2", 90.0, 0.0925), ("s5", "V1", 2.0, 48.75), ("s6", "V2", 400.0, 0.0965),
    ("s7", "V1", 0.25, 44.5), ("s8", "V1", 1.5, 49.5),
]
POOL_NAMES = [p[0] for p in POOL]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    rare = (F.col("l_quantity") >= 48) & (F.col("l_discount") >= 0.09)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day.cast("string")).alias("row_id"),
        (F.datediff(day, F.lit("1995-01-01").cast("date")) * 86400).cast("double").alias("Time"),
        F.col("l_quantity").alias("V1"), F.col("l_discount").alias("V2"), F.col("l_tax").alias("V3"),
        F.col("l_linenumber").cast("double").alias("V4"), F.col("l_suppkey").cast("double").alias("V5"),
        F.col("l_extendedprice").alias("Amount"), F.when(rare, 1).otherwise(0).alias("Class"))


def txn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = txn(spark, sf_dir)
    return df.select("row_id", "V1", "V2", "V3", "V4", "V5", F.log1p("Amount").alias("Log_Amount"), "Class")


def vec_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = [F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)]
    return e.select(
        F.col("vec_id").cast("string").alias("row_id"), F.col("vec_id").cast("double").alias("Time"), *v,
        (F.abs(F.col("embedding")[28].cast("double")) * 100.0).alias("Amount"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("Class"))


def vec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (vec_txn(spark, sf_dir).withColumn("Log_Amount", F.log1p("Amount"))
            .select("row_id", *VEC_FEATURES, "Class"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.length("text").cast("double")

    def without(token: str) -> Column:
        return n - F.length(F.replace(F.col("text"), F.lit(token), F.lit(""))).cast("double")

    return d.select(F.col("doc_id").cast("string").alias("row_id"), n.alias("V1"),
                    without(" ").alias("V2"), without("\n").alias("V3"), without("e").alias("V4"),
                    F.col("toxic").alias("Class"))


def dup_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(hash_key("dup"))
    copies = F.lit(1) + (u < 0.02).cast("int") + (u < 0.01).cast("int") + (u < 0.005).cast("int")
    return (txn(spark, sf_dir).withColumn("_i", F.explode(F.sequence(F.lit(1), copies)))
            .select(*TXN_COLUMNS))


def null_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = txn(spark, sf_dir).withColumn("_u", unit(hash_key("row")))
    out = [F.col("row_id")]
    for i, c in enumerate(TXN_COLUMNS):
        gap = unit(hash_key(c)) < 0.02
        gap = gap | ((F.col("_u") >= 0.006) & (F.col("_u") < 0.008))
        if c in ("V1", "V2", "V3", "V4"):
            gap = gap | (F.col("_u") < 0.006)
        if c == "V5":
            gap = gap | (F.col("_u") < 0.003)
        hole = F.lit(float("nan")) if c == "V3" else F.lit(None).cast(df.schema[c].dataType)
        out.append(F.when(gap, hole).otherwise(F.col(c)).alias(c))
    return df.select(*out)


def pool_scores() -> Column:
    """Array of the positive-class scores of the formula pool, in pool order."""
    scores = []
    for _, column, slope, cut in POOL:
        z = F.lit(slope) * (F.col(column) - F.lit(cut))
        scores.append(F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z)))
    return F.array(*scores)


def formula_pool(df: DataFrame) -> DataFrame:
    """Add ``p``, the scores of the eight fixed scorers."""
    return df.withColumn("p", pool_scores())
