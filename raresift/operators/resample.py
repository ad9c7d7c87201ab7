"""Over- and under-sampling for a rare class.

Every operator maps a table (row_id, features, label) to one with the same columns plus ``origin``
(original, synthetic or centroid). Neighbour searches are the joins of ``neighbors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.functions.hashing import hash_key, unit
from raresift.functions.ranks import replicate, with_cutoffs
from raresift.operators.neighbors import lloyd, with_neighbours
from raresift.sources.storage import materialize


class RatioError(ValueError):
    """An under-sampling ratio that the rows cannot give, as the majority is too small."""


def class_counts(df: DataFrame, label: str = "Class") -> dict:
    """Rows per class (a handful of rows on the driver)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def _roles(counts: dict) -> tuple:
    """(minority class, majority class); the greater label is the minority in a tie."""
    if len(counts) != 2:
        raise ValueError(f"Two classes are needed, found {sorted(counts)}")
    ordered = sorted(counts, key=lambda c: (counts[c], -c))
    return ordered[0], ordered[1]


def _tagged(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    origin = F.col("origin") if "origin" in df.columns else F.lit("original")
    return df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features], label, origin.alias("origin"))


def under_sample(df: DataFrame, features: list[str], ratio: float = 1.0, seed=42, label: str = "Class",
                 row_id: str = "row_id") -> DataFrame:
    """Keep floor(n_min / ratio) majority rows; only the cut-off row is ranked, rows are filtered in place."""
    df = _tagged(df, features, label, row_id)
    counts = class_counts(df, label)
    low, high = _roles(counts)
    keep = int(counts[low] / ratio + 1e-9)
    if keep > counts[high]:
        raise RatioError(f"Ratio {ratio} needs {keep} majority rows, only {counts[high]} exist")
    marked = with_cutoffs(df, label, hash_key(f"{seed}u", row_id), row_id, lambda n: F.array(F.lit(keep).cast("long")))
    chosen = (F.col(label) == low) | F.coalesce(F.col("_key") <= F.col("_cuts")[0], F.lit(False))
    return marked.where(chosen).select(df.columns)


def _synthesise(seeds: DataFrame, times: Column, like: DataFrame, features: list[str], seed, label: str,
                row_id: str) -> DataFrame:
    """New rows x + u (nn - x) from ``seeds`` with a neighbour list ``_nn``."""
    copies = replicate(seeds.withColumn("_t", times), F.col("_t"))
    mark = F.concat_ws("|", F.col(row_id), F.col("copy").cast("string"))
    pick = F.floor(unit(hash_key(f"{seed}n", mark)) * F.size("_nn")).cast("int")
    made = copies.withColumn("_o", F.get("_nn", pick)).withColumn("_u", unit(hash_key(f"{seed}g", mark)))
    cells = {c: F.col(c) + F.col("_u") * (F.col(f"_o.{c}") - F.col(c)) for c in features}
    made = made.select(F.concat(F.lit("s|"), mark).alias(row_id), *[v.alias(c) for c, v in cells.items()],
                       label, F.lit("synthetic").alias("origin"))
    return like.unionByName(made)


def _even_times(seeds: DataFrame, total: int, n: int, seed, label: str, row_id: str) -> DataFrame:
    """Share ``total`` copies evenly; the first ``total mod n`` rows in hash order get one more."""
    base, extra = divmod(total, n)
    marked = with_cutoffs(seeds, label, hash_key(f"{seed}e", row_id), row_id,
                          lambda _: F.array(F.lit(extra).cast("long")))
    more = F.coalesce(F.col("_key") <= F.col("_cuts")[0], F.lit(False)).cast("int")
    return marked.withColumn("_times", F.lit(base) + more).drop("_cuts", "_key")


def _need_neighbours(n: int, k: int) -> None:
    if n <= k:
        raise ValueError(f"{k} neighbours need more than {k} minority rows, found {n}")


def smote(df: DataFrame, features: list[str], k: int = 5, ratio: float = 1.0, seed=42, label: str = "Class",
          row_id: str = "row_id", **limits) -> DataFrame:
    """Synthetic minority rows on segments to minority neighbours, up to ratio * n_maj rows."""
    df = _tagged(df, features, label, row_id)
    counts = class_counts(df, label)
    low, high = _roles(counts)
    total = int(ratio * counts[high]) - counts[low]
    if total <= 0:
        return df
    _need_neighbours(counts[low], k)
    rare = df.where(F.col(label) == low)
    seeds = with_neighbours(rare, rare, k, features, row_id, features, True, name="_nn", **limits)
    seeds = _even_times(seeds, total, counts[low], seed, label, row_id)
    return _synthesise(seeds, F.col("_times"), df, features, seed, label, row_id)


def _other_class(names: str, label: str) -> Column:
    return F.size(F.filter(names, lambda n: n[label] != F.col(label)))


def adasyn(df: DataFrame, features: list[str], k: int = 5, seed=42, label: str = "Class",
           row_id: str = "row_id", **limits) -> DataFrame:
    """SMOTE with more copies where more of the k nearest rows belong to the majority."""
    df = _tagged(df, features, label, row_id)
    counts = class_counts(df, label)
    low, high = _roles(counts)
    total = counts[high] - counts[low]
    if total <= 0:
        return df
    _need_neighbours(counts[low], k)
    rare = df.where(F.col(label) == low)
    near = with_neighbours(rare, df, k, features, row_id, [label], True, name="_near", **limits)
    rated = materialize(near.withColumn("_m", _other_class("_near", label)).drop("_near"), "adasyn")
    mass = rated.agg(F.sum("_m").alias("m")).first()["m"]
    if not mass:
        raise ValueError("No minority row has a majority neighbour")
    seeds = with_neighbours(rated.where("_m > 0"), rare, k, features, row_id, features, True, name="_nn", **limits)
    times = F.rint(F.col("_m").cast("double") * F.lit(float(total)) / F.lit(float(mass)))
    return _synthesise(seeds, times, df, features, seed, label, row_id)


def borderline_smote(df: DataFrame, features: list[str], k: int = 5, m: int = 10, seed=42, label: str = "Class",
                     row_id: str = "row_id", **limits) -> DataFrame:
    """SMOTE from "danger" rows only: at least half, but not all, of the m nearest rows are majority."""
    df = _tagged(df, features, label, row_id)
    counts = class_counts(df, label)
    low, high = _roles(counts)
    total = counts[high] - counts[low]
    if total <= 0:
        return df
    _need_neighbours(counts[low], k)
    rare = df.where(F.col(label) == low)
    near = with_neighbours(rare, df, m, features, row_id, [label], True, name="_near", **limits)
    others = _other_class("_near", label)
    danger = near.where((others * 2 >= m) & (others < m)).drop("_near")
    danger = materialize(danger, "danger")
    n = danger.count()
    if n == 0:
        return df
    seeds = with_neighbours(danger, rare, k, features, row_id, features, True, name="_nn", **limits)
    seeds = _even_times(seeds, total, n, seed, label, row_id)
    return _synthesise(seeds, F.col("_times"), df, features, seed, label, row_id)


def _without(df: DataFrame, gone: DataFrame, row_id: str) -> DataFrame:
    return df.join(gone.select(row_id).distinct(), row_id, "left_anti").select(df.columns)


def _targets(df: DataFrame, classes: str, label: str) -> DataFrame:
    if classes == "all":
        return df
    return df.where(F.col(label) == _roles(class_counts(df, label))[1])


def enn(df: DataFrame, features: list[str], k: int = 3, classes: str = "majority", label: str = "Class",
        row_id: str = "row_id", **limits) -> DataFrame:
    """Drop rows (majority only, or all) unless all k neighbours are of the row's class."""
    df = _tagged(df, features, label, row_id)
    near = with_neighbours(_targets(df, classes, label), df, k, features, row_id, [label], True, name="_near", **limits)
    return _without(df, near.where(_other_class("_near", label) > 0), row_id)


def tomek_links(df: DataFrame, features: list[str], label: str = "Class", row_id: str = "row_id", **limits) -> DataFrame:
    """Pairs (rare, common) of different class that are each other's nearest row.

    Only minority rows and the rows nearest to them can form a link, so the search covers those
    instead of the whole table.
    """
    low, _ = _roles(class_counts(df, label))
    rare = df.where(F.col(label) == low)
    first = with_neighbours(rare, df, 1, features, row_id, [label, *features], True, name="_n", **limits)
    near = first.select(F.col(row_id).alias("_a"), F.col("_n")[0].alias("_b")).where(F.col(f"_b.{label}") != low)
    near = near.select("_a", F.col("_b.id").alias(row_id), *[F.col(f"_b.{c}").alias(c) for c in features])
    near = materialize(near, "tomek")
    back = with_neighbours(near.select(row_id, *features).dropDuplicates([row_id]), df, 1, features, row_id, [],
                           True, name="_n", **limits)
    back = back.select(row_id, F.col("_n")[0]["id"].alias("_a"))
    return near.join(back, [row_id, "_a"]).select(F.col("_a").alias("rare_id"), F.col(row_id).alias("common_id"))


def tomek(df: DataFrame, features: list[str], remove: str = "majority", label: str = "Class",
          row_id: str = "row_id", **limits) -> DataFrame:
    """Remove the majority member of every Tomek link, or both members."""
    df = _tagged(df, features, label, row_id)
    links = tomek_links(df, features, label, row_id, **limits)
    gone = links.select(F.col("common_id").alias(row_id))
    if remove == "all":
        gone = gone.unionByName(links.select(F.col("rare_id").alias(row_id)))
    return _without(df, gone, row_id)


def smote_enn(df: DataFrame, features: list[str], seed=42, label: str = "Class", row_id: str = "row_id", **limits) -> DataFrame:
    grown = materialize(smote(df, features, seed=seed, label=label, row_id=row_id, **limits), "smote")
    return enn(grown, features, classes="all", label=label, row_id=row_id, **limits)


def smote_tomek(df: DataFrame, features: list[str], seed=42, label: str = "Class", row_id: str = "row_id", **limits) -> DataFrame:
    grown = materialize(smote(df, features, seed=seed, label=label, row_id=row_id, **limits), "smote")
    return tomek(grown, features, "all", label, row_id, **limits)


def ncr(df: DataFrame, features: list[str], k: int = 3, label: str = "Class", row_id: str = "row_id", **limits) -> DataFrame:
    """Edited neighbours, and majority neighbours of minority rows that their neighbours misclassify."""
    df = _tagged(df, features, label, row_id)
    low, high = _roles(class_counts(df, label))
    near = with_neighbours(df, df, k, features, row_id, [label], True, name="_near", **limits)
    others = _other_class("_near", label)
    edited = near.where((F.col(label) == high) & (others > 0)).select(row_id)
    blamed = (near.where((F.col(label) == low) & (others * 2 > k)).select(F.explode("_near").alias("_e"))
              .where(F.col(f"_e.{label}") == high).select(F.col("_e.id").alias(row_id)))
    return _without(df, edited.unionByName(blamed), row_id)


def _first_majority(df: DataFrame, n: int, high, seed, label: str, row_id: str) -> DataFrame:
    """The first n majority rows in hash order."""
    rows = df.where(F.col(label) == high)
    marked = with_cutoffs(rows, label, hash_key(f"{seed}c", row_id), row_id, lambda _: F.array(F.lit(n).cast("long")))
    return marked.where(F.col("_key") <= F.col("_cuts")[0]).select(df.columns)


def oss(df: DataFrame, features: list[str], seed=42, label: str = "Class", row_id: str = "row_id", **limits) -> DataFrame:
    """One-sided selection: majority rows that 1-NN over minority plus one majority row gets wrong, then Tomek."""
    df = _tagged(df, features, label, row_id)
    low, high = _roles(class_counts(df, label))
    rare = df.where(F.col(label) == low)
    core = materialize(rare.unionByName(_first_majority(df, 1, high, seed, label, row_id)), "core")
    rest = df.where(F.col(label) == high).join(core.select(row_id), row_id, "left_anti")
    near = with_neighbours(rest, core, 1, features, row_id, [label], name="_n", **limits)
    wrong = near.where(F.col("_n")[0][label] == low).select(df.columns)
    return tomek(materialize(core.unionByName(wrong), "oss"), features, "majority", label, row_id, **limits)


def cluster_centroids(df: DataFrame, features: list[str], seed=42, iterations: int = 300, label: str = "Class",
                      row_id: str = "row_id") -> DataFrame:
    """Replace the majority by n_min k-means centroids, by steps until they rest (``iterations`` at most)."""
    df = _tagged(df, features, label, row_id)
    counts = class_counts(df, label)
    low, high = _roles(counts)
    rows = df.where(F.col(label) == high)
    centres = lloyd(rows, _first_majority(df, counts[low], high, seed, label, row_id), features, iterations, row_id)
    made = centres.select(F.concat(F.lit("c|"), F.col(row_id)).alias(row_id), *features,
                          F.lit(high).cast(df.schema[label].dataType).alias(label), F.lit("centroid").alias("origin"))
    return df.where(F.col(label) == low).unionByName(made)


Step = Callable[..., DataFrame]


def chain(steps: list[Step]) -> Step:
    """One resampler that applies several in turn; results between steps are written out."""
    def run(df: DataFrame, features: list[str], **kw) -> DataFrame:
        for i, step in enumerate(steps):
            df = step(materialize(df, "chain") if i else df, features, **kw)
        return df

    return run


def _with(step: Step, seeded: bool = True, **fixed) -> Step:
    def run(df, features, seed=42, label="Class", row_id="row_id"):
        extra = {"seed": seed} if seeded else {}
        return step(df, features, label=label, row_id=row_id, **extra, **fixed)

    return run


_SMOTE, _SMOTEENN = _with(smote), _with(smote_enn)
TECHNIQUES: dict[str, Step] = {
    "SMOTE": _SMOTE, "ADASYN": _with(adasyn), "BorderlineSMOTE": _with(borderline_smote),
    "RandomUnderSampler": _with(under_sample), "EditedNearestNeighbours": _with(enn, False),
    "SMOTEENN": _SMOTEENN, "SMOTETomek": _with(smote_tomek),
    "Under05_SMOTEENN": chain([_with(under_sample, ratio=0.05), _SMOTEENN]),
    "Under10_SMOTEENN": chain([_with(under_sample, ratio=0.10), _SMOTEENN]),
    "Under20_SMOTEENN": chain([_with(under_sample, ratio=0.20), _SMOTEENN]),
    "ClusterCentroids_SMOTEENN": chain([_with(cluster_centroids), _SMOTEENN]),
    "OSS_SMOTE": chain([_with(oss), _SMOTE]), "Tomek_SMOTE": chain([_with(tomek, False), _SMOTE]),
    "NCR_SMOTE": chain([_with(ncr, False), _SMOTE]),
}
EXPERIMENT_RESAMPLERS: dict[str, Step] = {
    "Under_0.005": _with(under_sample, ratio=0.005),
    "Under_0.005_SMOTEENN": chain([_with(under_sample, ratio=0.005), _SMOTEENN]),
}


def resampler(name: str, seed=42) -> Step:
    """Resampler by name; an unknown name is an error."""
    known = {**TECHNIQUES, **EXPERIMENT_RESAMPLERS}
    if name not in known:
        raise ValueError(f"no resampler is called {name}; there are {', '.join(known)}")
    return lambda df, features, **kw: known[name](df, features, **{"seed": seed, **kw})


def before_after(df: DataFrame, resampled: DataFrame, columns: tuple[str, str] = ("V1", "V2"),
                 label: str = "Class") -> DataFrame:
    """Two coordinates and the class of every row before and after resampling."""
    pick = lambda d, s: d.select(*columns, label, F.lit(s).alias("stage"))
    return pick(df, "before").unionByName(pick(resampled, "after"))
