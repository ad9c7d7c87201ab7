"""Delimited-file scan, table sinks and the results store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.config import LABEL, V_COLUMNS

# The default missing-value tokens of the reference's CSV reader.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

RAW_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in V_COLUMNS]
    + [T.StructField("Amount", T.DoubleType()), T.StructField(LABEL, T.IntegerType())])


def require_source(spark: SparkSession, path: str) -> None:
    """Raise FileNotFoundError unless the path (or glob) exists on its file system."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"nothing to read at {path}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table has no {', '.join(missing)}")
    return df


def load_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
             na_values: str | list[str] | None = None, dtype: T.StructType | dict | None = None,
             columns: list[str] | None = None, **options) -> DataFrame:
    """Scan a CSV file with a header.

    Cells are read as text, tokens that mean "missing" become NULL, then columns are cast. ``dtype``
    is a full schema (no inference pass) or a mapping of some columns; without a type a column is
    inferred. A value that does not fit its type is an error, not a silent NULL.

    Cells may be quoted, with doubled quotes and line breaks inside. A file with such breaks cannot be cut, so one scan of its lines looks for them
    first, and files without are read by many tasks; ``multiLine`` given as an option decides instead.
    """
    require_source(spark, path)
    extra = [na_values] if isinstance(na_values, str) else list(na_values or [])
    tokens = NA_TOKENS + extra
    broken = options.pop("multiLine", None)
    broken = _breaks_inside(spark, path, encoding) if broken is None else broken
    reader = (spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
              .option("multiLine", broken).option("encoding", encoding).options(**options))
    if isinstance(dtype, T.StructType):
        types = {f.name: f.dataType for f in dtype.fields}
        text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in dtype.fields]))
        df = text.option("enforceSchema", False).csv(path)
    else:
        df = reader.csv(path)
        types = {c: t for c, t in (dtype or {}).items()}
    names = columns or df.columns
    require_columns(df, names)
    cleaned = df.select(*[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) for c in names])
    unknown = [c for c in names if c not in types]
    if unknown:
        types = {**types, **_numeric_types(cleaned, unknown)}
    return cleaned.select(*[F.col(c).cast(types[c]).alias(c) for c in names])


def _breaks_inside(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a quoted cell goes over several lines: then some line holds an odd number of quotes."""
    if encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32", "utf16", "utf32")):
        return True  # lines of bytes are no lines of text there
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return bool(spark.read.text(path).where(odd).head(1))


def _numeric_types(df: DataFrame, columns: list[str]) -> dict:
    """bigint, or decimal beyond it, if no value is missing and all are whole numbers; double if all are numbers, else string."""
    whole = [F.col(c).rlike(r"^\s*[+-]?\d+\s*$") for c in columns]
    row = df.agg(*[F.bool_and(w & F.expr(f"try_cast(trim(`{c}`) as bigint)").isNotNull()).alias(f"i{i}") for i, (c, w) in enumerate(zip(columns, whole))],
                 *[F.bool_and(w & F.expr(f"try_cast(trim(`{c}`) as decimal(38, 0))").isNotNull()).alias(f"w{i}") for i, (c, w) in enumerate(zip(columns, whole))],
                 *[F.bool_and(F.expr(f"try_cast(`{c}` as double)").isNotNull() | F.col(c).isNull()).alias(f"d{i}")
                   for i, c in enumerate(columns)],
                 *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"] and row[f"i{i}"] and not row[f"m{i}"]:
            out[c] = T.LongType()
        elif row[f"n{i}"] and row[f"w{i}"] and not row[f"m{i}"]:
            out[c] = T.DecimalType(38, 0)
        else:
            out[c] = T.DoubleType() if row[f"d{i}"] else T.StringType()
    return out


def save_csv(df: DataFrame, path: str, delimiter: str = ",", encoding: str = "utf-8",
             float_format: str | None = None, mode: str = "overwrite", **options) -> None:
    """Write a CSV folder; ``float_format`` is a printf pattern for floating columns. Quotes in cells are doubled, cells with breaks or
    separators quoted, white space at their ends kept, so that ``load_csv`` reads the same text again."""
    if float_format:
        df = df.select(*[
            F.when(F.col(f.name).isNotNull(), F.format_string(float_format, F.col(f.name))).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
            for f in df.schema.fields])
    (df.write.mode(mode).option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", encoding).options(**options).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    if fmt == "csv":
        save_csv(df, path, mode=mode, **options)
    else:
        df.write.mode(mode).format(fmt).options(**options).save(path)


def new_run_id(resampler: str | None = None) -> str:
    return f"run_{time.strftime('%Y%m%d_%H%M%S')}_{resampler}"


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Put metric rows into the results table, partitioned by run, split, iteration and fold (those it has).

    The partitions that the rows belong to are replaced, so writing the same rows again changes nothing.
    """
    parts = ["run_id", "split", *[c for c in ("iteration", "fold") if c in df.columns]]
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def finished_runs(spark: SparkSession, path: str, run_id: str) -> set[tuple[int, int]]:
    """(iteration, fold) of the runs whose rows of both splits are in the results table."""
    try:
        require_source(spark, path)
    except FileNotFoundError:
        return set()
    rows = spark.read.option("mergeSchema", True).parquet(path).where(F.col("run_id") == run_id) \
        .select("iteration", "fold", "split").distinct().collect()
    seen: dict[tuple[int, int], set] = {}
    for r in rows:
        seen.setdefault((int(r["iteration"]), int(r["fold"])), set()).add(r["split"])
    return {k for k, v in seen.items() if {"test", "resubstitution"} <= v}


def export_results(spark: SparkSession, path: str, out: str) -> None:
    """Results table as CSV, one folder per split; list and map columns become JSON text."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    flat = [F.to_json(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).partitionBy("split").csv(out)
