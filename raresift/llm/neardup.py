"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.components import connected_components
from raresift.llm.frames import materialize

ROWS = 1024  # vectors of a bucket compared together


def tables_needed(bits: int, cosine: float, miss: float) -> int:
    """Tables after which a pair at the threshold is missed with probability ``miss`` at most."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-same)))


def _vectors(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and unit vectors (double) of the usable rows of an Arrow list column."""
    rows, out = [], []
    for i, x in enumerate(column):
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(all="ignore"):
                norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
                if norm == math.inf or (norm == 0.0 and np.any(v)):  # squares out of range
                    if np.isfinite(v).all():
                        v = v / np.abs(v).max()
                        norm = math.sqrt(float(v @ v))
            if norm > 0 and math.isfinite(norm):
                rows.append(i)
                out.append(v / norm)
    return np.array(rows, np.int64), out


def _signed(df: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Distinct usable vectors of a label: smallest id, how many rows have it, unit vector, one code per table."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows, vectors = _vectors(batch.column("vector"))
            codes = np.zeros((len(rows), tables), np.int64)
            for size in {len(v) for v in vectors}:
                if size not in planes:
                    planes[size] = np.random.default_rng(seed).standard_normal((size, bits * tables))
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                signs = np.stack([vectors[i] for i in at]) @ planes[size] >= 0
                codes[at] = signs.reshape(len(at), tables, bits) @ weights
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("id"), part.column("weight"), pa.array([v.tobytes() for v in vectors], pa.binary()),
                 pa.array(list(codes), pa.list_(pa.int64()))], names=["label", "id", "weight", "unit", "codes"])

    return df.mapInArrow(run, "label string, id long, weight long, unit binary, codes array<long>")


def _compare(cosine: float):
    """Links of one bucket, or of two parts of a hot one; a pair met in an earlier table counts there."""
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        label, table, code, size, left, right = key
        x = np.frombuffer(b"".join(df["unit"]), np.float64).reshape(len(df), -1)
        codes = np.stack(df["codes"].to_numpy())
        weight, part = df["weight"].to_numpy(), df["part"].to_numpy()
        a = np.flatnonzero(part == left)
        b = a if left == right else np.flatnonzero(part == right)
        links = np.zeros(len(df), np.int64)
        root = np.arange(len(df))
        edges_from, edges_to = [], []
        for i in range(0, len(a), ROWS):
            for j in range(i if left == right else 0, len(b), ROWS):
                p, q = a[i:i + ROWS], b[j:j + ROWS]
                near = x[p] @ x[q].T >= cosine
                if left == right and i == j:
                    near = np.triu(near, 1)
                u, v = np.nonzero(near)
                u, v = p[u], q[v]
                if table:  # count a pair once: in its first common table
                    first = np.ones(len(u), bool)
                    for t in range(table):
                        first &= codes[u, t] != codes[v, t]
                    u, v = u[first], v[first]
                links += np.bincount(u, weight[v], len(df)).astype(np.int64) + np.bincount(v, weight[u], len(df)).astype(np.int64)
                edges_from.append(u)
                edges_to.append(v)
        u, v = np.concatenate(edges_from or [np.zeros(0, int)]), np.concatenate(edges_to or [np.zeros(0, int)])
        while len(u):  # a forest of at most one edge a vertex: smallest row number by hooking and jumping
            low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
            if np.array_equal(low, high):
                break
            np.minimum.at(root, high, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
        ids = df["id"].to_numpy()
        use = links > 0
        return pd.DataFrame({"id": ids[use], "links": links[use], "root": ids[root[use]]})

    return run


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept.

    Two rows link if their labels are equal and not null and their cosine, in double precision, is at least ``cosine``.
    Equal vectors are merged first and weighted, so copies cost nothing. Sign codes have so many bits that a bucket of
    the largest label has about ``ROWS`` vectors, and so many tables that a pair at the threshold shares no bucket with
    probability ``miss``. A bucket of more than 2 * ROWS vectors is cut into parts whose pairs are compared in separate
    tasks. Comparison counts links in place and returns at most one edge per vector, never pairs; edges meet in
    distributed connected components.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a null
    label or id (component_id is the id); vectors of different length have different codes' planes and never link.
    Repeated rows are separate rows with the same id: they link with each other and their component counts once. An empty
    table gives no row; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                     F.col(label_col).cast("string").alias("label"))
    usable = rows.filter("vec_id is not null and label is not null and vector is not null").withColumn(
        "label", F.concat_ws("|", F.size("vector"), "label"))
    merged = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    merged = materialize(merged, "neardup-merged")
    largest = merged.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(largest, 2) / ROWS))) if largest > ROWS else 1
    tables = tables_needed(bits, cosine, miss)
    signed = materialize(_signed(merged, bits, tables, seed), "neardup-signed")
    keys = signed.select("label", "id", F.posexplode("codes").alias("t", "code"))
    hot = keys.groupBy("label", "t", "code").count().filter(F.col("count") > 2 * ROWS).select(
        "label", "t", "code", F.ceil(F.col("count") / ROWS).cast("int").alias("parts"))
    spread = signed.select("*", F.posexplode("codes").alias("t", "code")).join(hot, ["label", "t", "code"], "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .withColumn("l", F.least("part", "other")).withColumn("r", F.greatest("part", "other"))
    found = spread.select("label", "t", "code", "parts", "l", "r", "id", "weight", "unit", "codes", "part") \
        .groupBy("label", "t", "code", "parts", "l", "r").applyInPandas(_compare(cosine), "id long, links long, root long")
    found = materialize(found, "neardup-links")
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    each = merged.join(links, "id", "left").join(groups, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    # unusable vectors take part in the grouping by value but were never signed: they keep to themselves
    usable_again = F.expr("size(vector) > 0 and not exists(vector, v -> v is null or isnan(v) or abs(v) = double('infinity')) "
                          "and exists(vector, v -> v != 0)")
    keyed = rows.withColumn("label", F.when(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.col("label").isNotNull()
                                            & usable_again, F.concat_ws("|", F.size("vector"), "label")))
    joined = keyed.join(each, ["label", "vector"], "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                         F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
