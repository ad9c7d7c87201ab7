"""Exact stratified splits as hash cut-offs.

A split is decided by where md5(seed|row_id) stands in its class. Only the cut-off keys are ranked,
so assigning folds or roles to the wide table is a map-side filter: the table itself is not
shuffled, and one class may hold nearly all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.functions.hashing import hash_key
from raresift.functions.ranks import with_many_cutoffs


def _position(cuts: Column, key: str) -> Column:
    """How many cut-offs lie strictly before the row.

    Sorted in rather than compared in a lambda, which would hash the row again for every cut-off.
    """
    placed = F.array_sort(F.array_append(cuts, F.col(key)))
    return F.coalesce(F.array_position(placed, F.col(key)) - 1, F.lit(0)).cast("int")


def _fold_ends(k: int):
    # Distinct, because a class with fewer than k rows gives equal ends.
    return lambda n: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.ceil(j * n / F.lit(k)).cast("long")))


def stratified_folds(df: DataFrame, k: int, seed, label: str = "Class", row_id: str = "row_id",
                     name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; within each class fold sizes differ by at most one. A null class is an error."""
    return _folds(df, k, {name: seed}, label, row_id)


def repeated_folds(df: DataFrame, k: int, repeats: int, seed: int, label: str = "Class",
                   row_id: str = "row_id") -> DataFrame:
    """Fold numbers of several repeats as columns fold_0, fold_1, ...; the table is read three times, however many."""
    return _folds(df, k, {f"fold_{r}": seed + r for r in range(repeats)}, label, row_id)


def _folds(df: DataFrame, k: int, seeds: dict, label: str, row_id: str) -> DataFrame:
    if k < 2:
        return df.withColumns({n: F.lit(0) for n in seeds})
    keys = {n: hash_key(s, row_id) for n, s in seeds.items()}
    placed = with_many_cutoffs(df, label, keys, row_id, _fold_ends(k))
    placed = placed.withColumns({n: _position(F.col("_cuts")[n], f"_key_{n}") for n in seeds})
    return placed.drop("_cuts", *[f"_key_{n}" for n in seeds])


def run_position(run: int, k: int) -> tuple[int, int]:
    """(repeat, fold) of a run number."""
    return divmod(run, k)


def _first(df: DataFrame, share: Column | float | dict, seeds: dict, label: str, row_id: str) -> DataFrame:
    """Mark the first round(share * n_c) rows of every class in the order of each seed; a dictionary has a share for every seed."""
    quota = lambda part: lambda n: F.array(F.round(F.lit(part) * n).cast("long"))
    ranks = {n: quota(part) for n, part in share.items()} if isinstance(share, dict) else quota(share)
    placed = with_many_cutoffs(df, label, {n: hash_key(s, row_id) for n, s in seeds.items()}, row_id, ranks)
    placed = placed.withColumns({n: F.coalesce(F.col(f"_key_{n}") <= F.col("_cuts")[n][0], F.lit(False)) for n in seeds})
    return placed.drop("_cuts", *[f"_key_{n}" for n in seeds])


def holdout(df: DataFrame, share: float, seed, label: str = "Class", row_id: str = "row_id",
            name: str = "held_out") -> DataFrame:
    """Mark round(share * n_c) rows of every class."""
    return _first(df, share, {name: seed}, label, row_id)


def shuffle_splits(df: DataFrame, share: float, n_splits: int, seed: int, label: str = "Class",
                   row_id: str = "row_id") -> DataFrame:
    """Independent stratified validation marks val_0, val_1, ..."""
    return _first(df, share, {f"val_{s}": f"{seed}v{s}" for s in range(n_splits)}, label, row_id)


def resource_rung(df: DataFrame, share: float, seed, label: str = "Class", row_id: str = "row_id") -> DataFrame:
    """Rows of a halving rung; a larger share holds every row of a smaller one."""
    return _first(df, share, {"_in": f"{seed}r"}, label, row_id).where("_in").drop("_in")


def search_marks(df: DataFrame, share: float, n_splits: int, rungs: list[float], seed: int, label: str = "Class", row_id: str = "row_id") -> DataFrame:
    """``shuffle_splits`` and the rows of every rung (``resource_rung``) as marks rung_0, rung_1, ..., from the passes of one split."""
    seeds = {f"val_{s}": f"{seed}v{s}" for s in range(n_splits)} | {f"rung_{i}": f"{seed}r" for i in range(len(rungs))}
    shares = {f"val_{s}": share for s in range(n_splits)} | {f"rung_{i}": part for i, part in enumerate(rungs)}
    return _first(df, shares, seeds, label, row_id)


def with_roles(df: DataFrame, fold: int, dsel_share: float, seed, fold_column: str = "fold",
               label: str = "Class", row_id: str = "row_id") -> DataFrame:
    """Role test / dsel / train for one run; the selection set is taken from the training folds."""
    test = df.where(F.col(fold_column) == fold).withColumn("role", F.lit("test"))
    rest = holdout(df.where(F.col(fold_column) != fold), dsel_share, f"{seed}d", label, row_id, "_d")
    rest = rest.withColumn("role", F.when(F.col("_d"), "dsel").otherwise("train")).drop("_d")
    return test.unionByName(rest)


def shuffled(df: DataFrame, seed, row_id: str = "row_id") -> DataFrame:
    """All rows in a seeded random order; a global sort, so only for outputs that need the order."""
    return df.withColumn("shuffle_key", hash_key(seed, row_id)).orderBy("shuffle_key", row_id)
