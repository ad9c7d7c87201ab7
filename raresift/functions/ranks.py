"""Exact ranks and cumulative sums without sending a whole class or group to one task.

A class may hold nearly all rows, so ``row_number() over (partition by label)`` would sort the
table in one task. Both helpers first count per bucket, which combines on the map side, and then
look only inside the buckets that matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raresift.sources.storage import materialize

# Hash ranges are split by so many more hex digits at a time; a split has 4,096 parts, few enough to combine well before
# the shuffle.
PREFIX_DIGITS = 3
# Most rows that are sorted in one task.
RANGE_ROWS = 1 << 20


def _classed(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """The table; a null class is an error, as such a row has no place in a stratified split."""
    message = F.concat(F.lit("the class of row "), F.coalesce(F.col(row_id).cast("string"), F.lit("null")), F.lit(" is null"))
    return df.withColumn(label, F.coalesce(F.col(label), F.raise_error(message).cast(df.schema[label].dataType)))


def hash_cutoffs(df: DataFrame, label: str, keys: dict[str, Column], row_id: str,
                 ranks: Callable[[Column], Column] | dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows that stand at given ranks of their class, in the hash order of every key.

    ``ranks(n)`` maps the class size to an array of one-based ranks; a dictionary has a function for every key. Returns (label, cuts), where cuts maps a key's name to
    the sorted array of struct(key, row_id). All keys are counted in one pass. Ranges that hold a rank are split until
    they have at most RANGE_ROWS rows (one pass for every factor of 4,096, so none but the first below 10^9 rows of a class); only their rows are sorted.
    """
    cells = [F.struct(F.lit(n).alias("_name"), k.alias("_h")) for n, k in keys.items()]
    cells = F.explode(F.array(*cells)) if len(cells) > 1 else cells[0]  # one key needs no copies
    keyed = df.select(F.col(label).alias("_label"), F.col(row_id).alias("_id"), cells.alias("_k")).select(
        "_label", "_id", "_k._name", "_k._h")
    if isinstance(ranks, dict):
        by_key = ranks
        ranks = lambda n: F.coalesce(*[F.when(F.col("_name") == name, of(n)) for name, of in by_key.items()])
    part, digits = ["_label", "_name"], PREFIX_DIGITS
    counts = keyed.groupBy(*part, F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_at", ranks(F.sum("_c").over(Window.partitionBy(*part))))
    wanted = _ranges(counts, part)
    # One row per class, key and rank at most: small at any table size.
    while wanted.where(F.col("_c") > RANGE_ROWS).head(1) and digits < 30:
        inside = _inside(keyed, wanted.drop("_c"), digits)
        digits += PREFIX_DIGITS
        counts = inside.groupBy(*part, "_b", F.substring("_h", 1, digits).alias("_n")).agg(F.count("*").alias("_c"), F.first("_at").alias("_at"))
        wanted = _ranges(counts.withColumnRenamed("_b", "_o").withColumnRenamed("_n", "_b"), [*part, "_o"]).drop("_o")
    placed = _inside(keyed, wanted.drop("_c"), digits).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h", "_id")))
    hits = placed.where(F.array_contains("_at", F.col("_rn").cast("long"))).groupBy(*part).agg(
        F.sort_array(F.collect_list(F.struct("_h", "_id"))).alias("_cuts"))
    return hits.groupBy(F.col("_label").alias(label)).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_cuts"))).alias("cuts"))


def _inside(keyed: DataFrame, wanted: DataFrame, digits: int) -> DataFrame:
    """Keys in the wanted ranges, with the ranks asked for."""
    return keyed.withColumn("_b", F.substring("_h", 1, digits)).join(F.broadcast(wanted), ["_label", "_name", "_b"])


def _ranges(counts: DataFrame, part: list[str]) -> DataFrame:
    """Of ranges _b with their sizes _c and the ranks _at of the part they divide: those that hold a rank, written out with the ranks in them."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_lo", before)
    own = F.transform(F.filter("_at", lambda t: (t > F.col("_lo")) & (t <= F.col("_lo") + F.col("_c"))), lambda t: t - F.col("_lo"))
    return materialize(placed.select(*part, "_b", "_c", own.alias("_at")).where(F.size("_at") > 0), "ranges")


def with_cutoffs(df: DataFrame, label: str, key: Column, row_id: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """Join the class cut-offs to every row as ``_cuts`` and the row's own place as ``_key``."""
    return with_many_cutoffs(df, label, {"key": key}, row_id, ranks).withColumn("_cuts", F.col("_cuts")["key"]) \
        .withColumnRenamed("_key_key", "_key")


def with_many_cutoffs(df: DataFrame, label: str, keys: dict[str, Column], row_id: str,
                      ranks: Callable[[Column], Column] | dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Join the cut-offs of several keys to every row as the map ``_cuts``, and its places as ``_key_<name>``: one join for all."""
    df = _classed(df, label, row_id)
    cuts = hash_cutoffs(df, label, keys, row_id, ranks).withColumnRenamed("cuts", "_cuts")
    return (df.join(F.broadcast(cuts), label, "left")
            .withColumns({f"_key_{n}": F.struct(k.alias("_h"), F.col(row_id).alias("_id")) for n, k in keys.items()}))


def ordered_cumsum(df: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """Ascending cumulative sums over a table with one row per (groups, order).

    Adds ``below_<s>`` (strictly smaller values) and ``total_<s>`` per group. The table is dealt out by ranges of (groups, order)
    and written, so a range is fixed however often it is read, and one group may lie in any number of them. If a range
    has more than RANGE_ROWS rows, it is dealt out again into more.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        df = materialize(df.repartitionByRange(parts, *groups, order).withColumn("_b", F.spark_partition_id()), "ranges")
        sizes = df.groupBy("_b").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        if (sizes.most or 0) <= RANGE_ROWS or parts > 4 * sizes.n / RANGE_ROWS:
            break
        parts = max(2 * parts, 2 * sizes.n // RANGE_ROWS + 1)
        df = df.drop("_b")
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*groups, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
               .select(*groups, "_b",
                       *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
                       *[F.sum(f"_s_{s}").over(by_group).alias(f"total_{s}") for s in sums]))
    inside = (Window.partitionBy(*groups, "_b").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = df.join(offsets, [*groups, "_b"])
    for s in sums:
        out = out.withColumn(f"below_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_b", *[f"_o_{s}" for s in sums])


def replicate(df: DataFrame, times: Column, index: str = "copy", chunk: int = 4096) -> DataFrame:
    """Repeat each row ``times`` times, numbering the copies from 0.

    Large counts are first cut into chunks that are spread over the cluster, so one row that stands
    for millions of copies does not expand inside one task.
    """
    counted = df.withColumn("_times", times.cast("long")).where(F.col("_times") > 0)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / F.lit(chunk)))))
    first = F.col("_chunk") * F.lit(chunk)
    last = F.least(first + F.lit(chunk), F.col("_times")) - F.lit(1)
    keys = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    return (chunks.repartition("_chunk", *keys)
            .withColumn(index, F.explode(F.sequence(first, last)))
            .drop("_times", "_chunk"))
