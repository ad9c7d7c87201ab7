"""Dynamic selection: which classifiers of a pool answer each query.

A query row carries ``p`` (scores of the pool) and a region of competence: an array of its
neighbours in the selection set, each with ``dist`` (squared), ``id``, the label ``y`` and the
pool's scores ``p`` on that row, in (distance, id) order. A selector is then a row expression, so
all selectors of a pool run in one pass without further shuffles.

Definitions, for classifier j and neighbour i: c = 1 if j is right on i, s = the score j gives the
true class of i, o = the class j gives the query, w = 1/(distance + 1e-10).
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raresift.config import REGION_SIZE
from raresift.operators.neighbors import assign_cluster, even_region, merged, with_class_neighbours
from raresift.operators.voting import decide, mean_score

SHARE_ACCURATE = 0.5
SHARE_DIVERSE = 0.3


def described(region: str | Column) -> Column:
    """Region rows with hits ``c``, supports of the true class ``s``, inverse distance ``w`` and potential ``g``.

    The potential is Gaussian relative to the nearest row, so that far regions do not underflow.
    """
    region = F.col(region) if isinstance(region, str) else region
    nearest = F.coalesce(F.get(region, 0)["dist"], F.lit(0.0))

    def row(n: Column) -> Column:
        one = n["y"] == 1
        return F.struct(
            n["dist"].alias("dist"), n["y"].alias("y"), n["p"].alias("p"),
            F.transform(n["p"], lambda x: F.when((x > 0.5) == one, 1.0).otherwise(0.0)).alias("c"),
            F.transform(n["p"], lambda x: F.when(one, x).otherwise(F.lit(1.0) - x)).alias("s"),
            (F.lit(1.0) / (F.sqrt(n["dist"]) + F.lit(1e-10))).alias("w"),
            F.exp(nearest - n["dist"]).alias("g"))

    return F.transform(region, row)


# Vectors over the pool are arrays, added element by element: expressions do not grow with the pool.

def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def _vsum(region: Column, term) -> Column:
    """Per classifier, the sum over the region of ``term(neighbour)``, an array."""
    zeros = F.transform("p", lambda x: F.lit(0.0))
    return F.aggregate(region, zeros, lambda acc, n: _zip(acc, term(n), lambda a, x: a + x))


def _num(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _vsafe(num: Column, den: Column) -> Column:
    return _zip(num, den, _safe)


def _per(size: int, f) -> Column:
    return F.array(*[f(j) for j in range(size)])


def _with_queries(values: Column, n: Column, f) -> Column:
    """Combine a neighbour's vector with whether the classifier's answer to the query is the neighbour's class."""
    return _zip(values, F.col("p"), lambda v, p: f(v, (p > 0.5) == (n["y"] == 1)))


# --- shortcuts and pruning ------------------------------------------------------------------

def agreed() -> Column:
    """True where every classifier of the pool decides for the same class."""
    ones = F.size(F.filter("p", lambda x: x > 0.5))
    return (ones == 0) | (ones == F.size("p"))


def split_agreement(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agreed rows answered with the pool mean, rows that need a region)."""
    return decide(pool.where(agreed()).withColumn("p1", mean_score())), pool.where(~agreed())


def frienemy_keep(region: Column) -> Column:
    """Flags of the classifiers that are right on a neighbour of each class present.

    In a region of one class, or if nobody qualifies, all are kept.
    """
    def hits(y):
        return _vsum(region, lambda n: F.transform(n["c"], lambda c: F.when(n["y"] == y, c).otherwise(0.0)))

    mixed = F.exists(region, lambda n: n["y"] == 0) & F.exists(region, lambda n: n["y"] == 1)
    flags = _zip(hits(0), hits(1), lambda a, b: (a > 0) & (b > 0))
    return F.when(mixed & F.exists(flags, lambda f: f), flags).otherwise(F.transform("p", lambda x: F.lit(True)))


def minority_share(region: Column) -> Column:
    """Share of the rarer class in the region (instance hardness); 0 for an empty region."""
    ones = _safe(F.size(F.filter(region, lambda n: n["y"] == 1)).cast("double"), F.size(region))
    return F.least(ones, F.lit(1.0) - ones)


# --- competence: described region to one value per classifier ---------------------------------

def hits(region):
    return _vsum(region, lambda n: n["c"])


def ola(region):
    return F.transform(hits(region), lambda h: _safe(h, F.size(region)))


def lca(region):
    return _vsafe(_vsum(region, lambda n: _with_queries(n["c"], n, lambda c, same: F.when(same, c).otherwise(0.0))),
                  _vsum(region, lambda n: _with_queries(n["c"], n, lambda c, same: _num(same))))


def mla(region):
    return _vsafe(_vsum(region, lambda n: _with_queries(n["c"], n, lambda c, same: F.when(same, n["w"] * c).otherwise(0.0))),
                  _vsum(region, lambda n: _with_queries(n["c"], n, lambda c, same: F.when(same, n["w"]).otherwise(0.0))))


def apriori(region):
    return _vsafe(_vsum(region, lambda n: F.transform(n["s"], lambda s: n["w"] * s)),
                  _vsum(region, lambda n: F.transform(n["s"], lambda s: n["w"])))


def aposteriori(region):
    def share(n):
        return _zip(n["p"], F.col("p"), lambda v, p: n["w"] * F.when(p > 0.5, v).otherwise(F.lit(1.0) - v))

    same = lambda n: _with_queries(share(n), n, lambda v, ok: F.when(ok, v).otherwise(0.0))
    return _vsafe(_vsum(region, same), _vsum(region, share))


def leading_run(region):
    """Number of nearest neighbours in a row on which the classifier is right."""
    start = F.transform("p", lambda x: F.struct(F.lit(0.0).alias("n"), F.lit(True).alias("on")))

    def step(acc, n):
        return _zip(acc, n["c"], lambda a, c: F.struct((a["n"] + _num(a["on"] & (c > 0))).alias("n"), (a["on"] & (c > 0)).alias("on")))

    return F.transform(F.aggregate(region, start, step), lambda a: a["n"])


def _potential_mean(region, score):
    return _vsafe(_vsum(region, lambda n: F.transform(score(n), lambda v: n["g"] * v)),
                  _vsum(region, lambda n: F.transform(n["s"], lambda v: n["g"])))


@functools.cache
def beta_table(points: int = 1001) -> tuple[float, ...]:
    """P(U1 > U2) for independent U1 ~ Beta(2p, 2-2p), U2 ~ Beta(2-2p, 2p), at p = 0, 0.001, ..., 1.

    Double-exponential quadrature in log space: x = 1/(1+exp(-pi sinh s)).
    """
    s = np.linspace(-10.0, 10.0, 8001)
    t = np.pi * np.sinh(s)
    log_x, log_1x = -np.logaddexp(0.0, -t), -np.logaddexp(0.0, t)
    log_dt = np.log(np.pi * np.cosh(s)) + np.log(s[1] - s[0])
    out = np.empty(points)
    for i in range(points):
        p = i / (points - 1)
        if p in (0.0, 0.5, 1.0):
            out[i] = p
            continue
        a, b = 2 * p, 2 - 2 * p
        mass = np.exp(a * log_x + b * log_1x + log_dt - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
        cdf = np.cumsum(mass) - 0.5 * mass
        out[i] = float(np.sum(mass * (1.0 - cdf[::-1])))
    return tuple(round(float(v), 9) for v in np.clip(out, 0.0, 1.0))


def _beta_probability(p: Column) -> Column:
    table = F.expr("array(" + ",".join(f"{v!r}D" for v in beta_table()) + ")")
    at = p * F.lit(1000.0)
    low = F.least(F.floor(at), F.lit(999)).cast("int")
    a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return a + (b - a) * (at - low)


def rrc(region):
    """Probability that a randomised classifier is right, weighted by closeness."""
    return _potential_mean(region, lambda n: F.transform(n["s"], _beta_probability))


def deskl(region):
    """Signed divergence of the scores from the uniform distribution."""
    def part(v):
        return F.when(v > 0, v * F.log(F.lit(2.0) * v)).otherwise(F.lit(0.0))

    def score(p, c):
        v = (part(p) + part(F.lit(1.0) - p)) / F.lit(math.log(2.0))
        return F.when(c > 0, v).otherwise(-v)

    return _potential_mean(region, lambda n: _zip(n["p"], n["c"], score))


def exponential(region):
    """1 - 2^(1 - s/(1-s)) for two classes."""
    def score(s):
        s = F.least(s, F.lit(1.0 - 1e-10))
        return F.lit(1.0) - F.pow(F.lit(2.0), F.lit(1.0) - s / (F.lit(1.0) - s))

    return _potential_mean(region, lambda n: F.transform(n["s"], score))


def logarithmic(region):
    """2 s^(log 2 / log classes) - 1, which is 2 s - 1 for two classes."""
    return _potential_mean(region, lambda n: F.transform(n["s"], lambda s: F.lit(2.0) * s - F.lit(1.0)))


def shared_errors(region: Column) -> Column:
    """Double faults of each classifier with all others, summed over the region."""
    return _vsum(region, lambda n: F.transform(n["c"], lambda c: F.when(c > 0, 0.0).otherwise(
        F.size(F.filter(n["c"], lambda o: o < 1)) - F.lit(1.0))))


def accuracy_and_errors(region):
    return _zip(ola(region), shared_errors(region), lambda a, e: F.struct(a.alias("a"), e.alias("e")))


# --- selection: competence and pruning flags to vote weights -----------------------------------

def _or_everyone(chosen: Column, keep: Column) -> Column:
    """If nobody is selected, all unpruned classifiers vote."""
    return F.when(F.exists(chosen, lambda w: w > 0), chosen).otherwise(F.transform(keep, _num))


def select_best(comp: Column, keep: Column) -> Column:
    """Weight 1 for the unpruned classifier with the greatest competence, the first in a tie."""
    masked = _zip(comp, keep, lambda c, k: F.when(k, c).otherwise(F.lit(-1e300)))
    best = F.array_position(masked, F.array_max(masked))
    return F.transform(keep, lambda k, j: _num(best == j + 1))


def _above(level):
    return lambda comp, keep: _or_everyone(_zip(comp, keep, lambda c, k: _num(k & (c > level))), keep)


def _unpruned(comp, keep):
    return _zip(comp, keep, lambda c, k: F.when(k, c).otherwise(0.0))


def longest_run(comp, keep):
    top = F.array_max(_unpruned(comp, keep))
    return _or_everyone(_zip(comp, keep, lambda c, k: _num(k & (c > 0) & (c == top))), keep)


def by_hits(comp, keep):
    return _or_everyone(_unpruned(comp, keep), keep)


def sizes_of(size: int, accurate: float = SHARE_ACCURATE, diverse: float = SHARE_DIVERSE) -> tuple[int, int]:
    """(number kept by accuracy, number kept by diversity)."""
    return int(size * accurate), math.ceil(size * diverse)


def accurate_then_diverse(comp, keep, accurate: float = SHARE_ACCURATE, diverse: float = SHARE_DIVERSE):
    """Most accurate share of the pool, then the members that share the fewest errors."""
    size = F.size(keep)
    n = F.greatest(F.floor(size * F.lit(accurate)).cast("int"), F.lit(1))
    m = F.ceil(size * F.lit(diverse)).cast("int")
    rows = F.transform(comp, lambda c, j: F.struct((-c["a"]).alias("a"), j.alias("j"), c["e"].alias("e"), F.get(keep, j).alias("k")))
    top = F.slice(F.array_sort(F.filter(rows, lambda r: r["k"])), 1, n)
    spread = F.array_sort(F.transform(top, lambda r: F.struct(r["e"].alias("e"), r["j"].alias("j"))))
    chosen = F.transform(F.slice(spread, 1, m), lambda r: r["j"])
    return F.transform(keep, lambda k, j: _num(F.array_contains(chosen, j)))


# Selector: (region kind, pruning, competence, selection).
SELECTORS = {
    "OLA": ("even", True, ola, select_best),
    "LCA": ("even", True, lca, select_best),
    "MLA": ("even", True, mla, select_best),
    "APriori": ("even", True, apriori, select_best),
    "APosteriori": ("even", True, aposteriori, select_best),
    "KNORAE": ("even", True, leading_run, longest_run),
    "KNORAU": ("even", True, hits, by_hits),
    "DESP": ("even", True, ola, _above(0.5)),
    "DESKNN": ("even", True, accuracy_and_errors, accurate_then_diverse),
    "KNOP": ("profile", True, hits, by_hits),
    "RRC": ("plain", True, rrc, _above(0.5)),
    "DESKL": ("plain", False, deskl, _above(0.0)),
    "Exponential": ("plain", True, exponential, _above(0.0)),
    "Logarithmic": ("plain", True, logarithmic, _above(0.0)),
}
REGION_SELECTORS = list(SELECTORS)


def dynamic_vote(weights: Column) -> Column:
    """Weighted mean of the selected classifiers' scores."""
    pairs = _zip(weights, F.col("p"), lambda w, p: w * p)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


# --- regions -----------------------------------------------------------------------------------

def with_regions(q: DataFrame, dsel: DataFrame, features: list[str], k: int = REGION_SIZE,
                 label: str = "Class", classes: tuple = (0, 1), p: int = 2, even: bool = True,
                 plain: bool = True, **limits) -> DataFrame:
    """Add ``even`` (k split over the classes) and ``plain`` (k nearest) regions from one search per class."""
    data = dsel.withColumn("y", F.col(label).cast("int"))
    each = k if plain else -(-k // len(classes))
    near = with_class_neighbours(q, data, each, features, "y", payload=["p"], classes=classes, p=p, **limits)
    if plain:
        near = near.withColumn("plain", merged([F.col(f"near_{c}") for c in classes], k))
    if even:
        near = near.withColumn("even", even_region(k, classes))
    return near.drop(*[f"near_{c}" for c in classes])


def with_profile_region(q: DataFrame, dsel: DataFrame, size: int, k: int = REGION_SIZE, label: str = "Class",
                        classes: tuple = (0, 1), **limits) -> DataFrame:
    """Add ``profile``: the region in decision space, where a row's coordinates are the pool's scores."""
    axes = [f"_p{j}" for j in range(size)]
    spread = lambda d, *more: d.select("row_id", label, "p", *more, *[F.col("p")[j].alias(a) for j, a in enumerate(axes)])
    # The search needs a column "even"; the caller's own regions step aside.
    other = [c for c in q.columns if c not in ("row_id", label, "p")]
    held = spread(q, *[F.struct(*other).alias("_held")] * bool(other))  # a struct without fields cannot be written
    found = with_regions(held, spread(dsel), axes, k, label, classes, plain=False, **limits)
    return found.select("row_id", label, "p", *[F.col(f"_held.{c}") for c in other], F.col("even").alias("profile"))


def with_weights(q: DataFrame, names: list[str]) -> DataFrame:
    """Add ``weights_<name>``, the vote weights of each selector.

    Regions, pruning flags and competences are columns of their own, one projection after the
    other, so that each is computed once per row.
    """
    unknown = [n for n in names if n not in SELECTORS]
    if unknown:
        raise ValueError(f"no dynamic selector is called {' or '.join(unknown)}")
    kinds = sorted({SELECTORS[n][0] for n in names})
    q = q.withColumns({f"_r_{k}": described(k) for k in kinds})
    q = q.withColumns({f"_k_{k}": frienemy_keep(F.col(f"_r_{k}")) for k in kinds})
    q = q.withColumns({f"_c_{n}": SELECTORS[n][2](F.col(f"_r_{SELECTORS[n][0]}")) for n in names})
    weights = {}
    for n in names:
        kind, prune, _, select = SELECTORS[n]
        keep = F.col(f"_k_{kind}") if prune else F.transform("p", lambda x: F.lit(True))
        weights[f"weights_{n}"] = select(F.col(f"_c_{n}"), keep)
    q = q.withColumns(weights)
    return q.drop(*[f"_r_{k}" for k in kinds], *[f"_k_{k}" for k in kinds], *[f"_c_{n}" for n in names])


def select_scores(q: DataFrame, names: list[str]) -> DataFrame:
    """Long table (id columns, model, p1, pred): every selector's answer for every row with regions."""
    weighted = with_weights(q, names)
    answers = [F.struct(F.lit(n).alias("model"), dynamic_vote(F.col(f"weights_{n}")).alias("p1")) for n in names]
    kept = [c for c in q.columns if c not in ("p", "even", "plain", "profile")]
    out = weighted.select(*kept, F.explode(F.array(*answers)).alias("_a")).select(*kept, "_a.model", "_a.p1")
    return decide(out)


def hardness_gate(q: DataFrame, name: str, rate: float, region: str = "even") -> DataFrame:
    """Optional gate: an easy region (rarer class below ``rate``) is answered by its neighbours' majority."""
    ones = _safe(F.size(F.filter(region, lambda n: n["y"] == 1)).cast("double"), F.size(region))
    easy = minority_share(F.col(region)) < F.lit(rate)
    voted = dynamic_vote(F.col(f"weights_{name}"))
    return decide(with_weights(q, [name]).withColumn("p1", F.when(easy, ones).otherwise(voted)))


def dynamic_select(q: DataFrame, dsel: DataFrame, names: list[str], size: int, features: list[str],
                   k: int = REGION_SIZE, label: str = "Class", **limits) -> DataFrame:
    """Answers of several selectors. Regions are searched only for rows on which the pool disagrees."""
    kinds = {SELECTORS[n][0] for n in names if n in SELECTORS}
    easy, hard = split_agreement(q)
    rows = hard
    if kinds & {"even", "plain"}:
        hard = with_regions(rows, dsel, features, k, label, even="even" in kinds, plain="plain" in kinds, **limits)
    if "profile" in kinds:
        # searched from the rows themselves, not on top of the other search
        own = with_profile_region(rows.select("row_id", label, "p"), dsel, size, k, label, **limits)
        hard = hard.join(own.select("row_id", "profile"), "row_id") if kinds & {"even", "plain"} else own
    base = ["row_id", label]
    hard = select_scores(hard.select(*base, "p", *sorted(kinds)), names)
    models = F.explode(F.lit(list(names)))
    easy = easy.select(*base, models.alias("model"), "p1", "pred")
    return easy.unionByName(hard.select(*base, "model", "p1", "pred"))


# --- cluster regions -----------------------------------------------------------------------------

def cluster_selection(dsel: DataFrame, size: int, cluster: str = "cluster", label: str = "Class",
                      accurate: float = SHARE_ACCURATE, diverse: float = SHARE_DIVERSE) -> DataFrame:
    """Vote weights per cluster of the selection set: one aggregate, one row per cluster."""
    flags = dsel.select(cluster, *[((F.col("p")[j] > 0.5) != (F.col(label) == 1)).cast("int").alias(f"_w{j}")
                                   for j in range(size)])
    wrong = sum((F.col(f"_w{j}") for j in range(size)), F.lit(0))
    agg = flags.withColumn("_wrong", wrong).groupBy(cluster).agg(
        *[F.avg(F.lit(1.0) - F.col(f"_w{j}")).alias(f"_a{j}") for j in range(size)],
        *[F.sum(F.col(f"_w{j}") * (F.col("_wrong") - 1)).cast("double").alias(f"_e{j}") for j in range(size)])
    comp = _per(size, lambda j: F.struct(F.col(f"_a{j}").alias("a"), F.col(f"_e{j}").alias("e")))
    weights = accurate_then_diverse(comp, _per(size, lambda j: F.lit(True)), accurate, diverse)
    return agg.select(cluster, weights.alias("weights"))


def desclustering(q: DataFrame, dsel: DataFrame, centroids: DataFrame, features: list[str], size: int,
                  label: str = "Class", **limits) -> DataFrame:
    """Answer each query with the classifiers chosen for the cluster of its nearest centroid."""
    chosen = cluster_selection(assign_cluster(dsel, centroids, features, **limits), size, label=label)
    easy, hard = split_agreement(q)
    # One row per cluster (five by default).
    placed = assign_cluster(hard, centroids, features, **limits).join(F.broadcast(chosen), "cluster", "left")
    everyone = _per(size, lambda j: F.lit(1.0))
    hard = decide(placed.withColumn("p1", dynamic_vote(F.coalesce("weights", everyone))))
    cols = ["row_id", label, "p1", "pred"]
    return easy.select(*cols).unionByName(hard.select(*cols))


# --- meta-learning ---------------------------------------------------------------------------------

def _meta_features() -> Column:
    """Per classifier: hits and supports on the region, local accuracy, hits in decision space, confidence."""
    region, profile = F.col("_r"), F.col("_o")
    local = ola(region)
    return F.transform("p", lambda p, j: F.struct(j.alias("j"), F.concat(
        F.transform(region, lambda n: F.get(n["c"], j)), F.transform(region, lambda n: F.get(n["s"], j)),
        F.array(F.get(local, j)), F.transform(profile, lambda n: F.get(n["c"], j)),
        F.array(F.greatest(p, F.lit(1.0) - p))).alias("x")))


def metades(q: DataFrame, dsel: DataFrame, size: int, features: list[str], k: int = REGION_SIZE,
            profile_k: int = 6, label: str = "Class", **limits) -> DataFrame:
    """Naive Bayes over meta-features decides which classifiers are competent for a query.

    The meta-model is trained on the selection-set rows on which the pool disagrees, with the row
    itself left out of its regions.
    """
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def with_meta(rows, own):
        r = with_regions(rows, dsel, features, k, label, plain=False, exclude_self=own, **limits)
        r = with_profile_region(r, dsel, size, profile_k, label, exclude_self=own, **limits)
        # A region can be short of rows of a class; such rows have no fixed-length description.
        full = (F.size("even") == k) & (F.size("profile") == profile_k)
        r = r.withColumns({"_r": described("even"), "_o": described("profile")})
        return r.withColumn("_m", F.when(full, _meta_features())).drop("_r", "_o")

    train = with_meta(dsel.where(~agreed()), True).where(F.col("_m").isNotNull())
    train = train.select(label, "p", F.explode("_m").alias("_e")).select(
        array_to_vector("_e.x").alias("_x"),
        _num((F.get("p", F.col("_e.j")) > 0.5) == (F.col(label) == 1)).alias("_y"))
    easy, hard = split_agreement(q)
    rows = with_meta(hard, False).select("row_id", label, "p", F.explode_outer("_m").alias("_e"))
    model = NaiveBayes(modelType="gaussian", featuresCol="_x", labelCol="_y", probabilityCol="_prob",
                       rawPredictionCol="_raw", predictionCol="_pr").fit(train)
    scored = model.transform(rows.where(F.col("_e").isNotNull()).withColumn("_x", array_to_vector("_e.x")))
    chosen = scored.groupBy("row_id").agg(F.collect_list(F.when(
        vector_to_array("_prob")[1] > 0.5, F.col("_e.j"))).alias("_j"))
    out = hard.select("row_id", label, "p").join(chosen, "row_id", "left")
    picked = _per(size, lambda j: _num(F.coalesce(F.array_contains("_j", j), F.lit(False))))
    weights = F.when(F.exists(picked, lambda w: w > 0), picked).otherwise(_per(size, lambda j: F.lit(1.0)))
    out = decide(out.withColumn("p1", dynamic_vote(weights)))
    cols = ["row_id", label, "p1", "pred"]
    return easy.select(*cols).unionByName(out.select(*cols))
