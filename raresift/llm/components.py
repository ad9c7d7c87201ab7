"""Connected components of an edge table that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id of the edges (columns a, b, long): the smallest id it reaches.

    Alternates two steps until only stars are left: every vertex links its larger neighbours to its smallest neighbour, then
    its smaller neighbours and itself to the smallest of them. Both keep connectivity, never add edges, and end in stars
    after O(log^2 n) rounds. The smallest neighbour comes from an aggregate with map-side combining and is joined back, so a
    hub's neighbours are never gathered. Every round is written to the shared folder, which cuts lineage; a row at most
    goes to the driver.

    Self-loops make their id a component of its own; repeated and reversed edges count once; edges with a null end are
    dropped; an empty table gives no row.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    now = materialize(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    nodes = now.select(F.col("u").alias("id")).union(now.select("v")).distinct()
    now = now.filter("u > v")
    for _ in range(rounds):
        # a forest of stars: no edge leads to a vertex that has a smaller neighbour
        if not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").head(1) and not _twice(now).head(1):
            break
        # large star: u's larger neighbours go to the smallest of u's neighbourhood
        both = now.union(now.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v") \
            .union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))


def _twice(edges: DataFrame) -> DataFrame:
    """Vertices with two smaller neighbours."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
