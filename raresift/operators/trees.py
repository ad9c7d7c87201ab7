"""Batched histogram training of trees: all candidates of a search, all trees of a forest and all folds of a benchmark grow together.

Rows are cut into bins once and written in blocks, so that a pass reads arrays. A level of all open trees is one Spark job: every task sends, per tree, sums by (node, feature, bin) of its rows,
the sums meet per tree, and where they meet the best splits are chosen, so only splits reach the driver. A row's draw for a tree (bootstrap, class
balance, subsample) is a hash of row and tree, so nothing is copied and no task keeps state. Boosted models grow one tree a round each, in step; the
margin of every row and model is written with the rows every few rounds, so a round costs the same however many came before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.functions.hashing import unit64
from raresift.sources.storage import materialize

BINS = 64
CELLS = 1 << 21  # sums a task holds at once: some 50 MB
BLOCK = 8192  # rows handled together; one row of the written table
TASK_ROWS = 1 << 17  # a task reads at least as many rows where there are several
FILE_ROWS = 1 << 20  # and hardly more than these
PAIRS = 1 << 17  # (tree, row) pairs handled together: arrays of a megabyte, which stay in the caches
SAVE = 16  # rounds after which margins are written
PATIENCE = 10
WATCHED = 0.1  # share of the rows that a job with patience does not learn from but watches
DIRECT = 16 << 20  # bytes of sums that may reach the driver in one pass; more meet in a shuffle
ARROW_BYTES = 4 << 20  # of blocks that a task sends to Python at once, outside the heap
CHANNELS = 5  # two weights or gradients, rows; and for boosted stumps the two weights of all rows


@dataclass
class Tree:
    """Nodes by number; feature -1 is a leaf. Rows with bin <= cut go left. ``stats`` are the sums of the rows that met in a node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    stats: list[tuple] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, left: tuple, right: tuple) -> tuple[int, int]:
        new = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, new, new + 1
        for stats in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.depth.append(self.depth[node] + 1)
            self.stats.append(stats)
            self.value.append(0.0)
        return new, new + 1

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


@dataclass
class Job:
    """A model to train on the rows of ``group``.

    kind: forest (Gini), logistic (Friedman's gain, Newton leaves), penalised (second-order gain with penalties) or stumps.
    draw: all, bootstrap (Poisson with ``rate``), balanced (Poisson, every class expects the smallest one's rows), under (the larger class by the share
    that leaves it as large as the smaller) or share (``rate`` of the rows). All but balanced use the rows' weights in a forest.
    With ``patience`` a tenth of the rows, by hash, is only watched; after ``PATIENCE`` rounds without a lower log-loss there the model is cut at its best round.
    """

    kind: str
    trees: int
    group: int = 0
    depth: int = 5
    seed: int = 42
    draw: str = "all"
    rate: float = 1.0
    features: str | float = "all"
    min_leaf: int = 1
    min_split: int = 2
    max_leaves: int | None = None
    min_gain: float = 0.0
    prune: float = 0.0
    random_cuts: bool = False
    learning_rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    min_child_weight: float = 0.0
    max_step: float = 0.0
    tree_features: float = 1.0
    allowed: list[int] | None = None
    patience: bool = False
    positive_weight: float = 1.0
    # what training leaves
    grown: list[Tree] = field(default_factory=list)
    alphas: list[float] = field(default_factory=list)
    start: float = 0.0
    losses: list[float] = field(default_factory=list)
    done: bool = False


# --- rows -----------------------------------------------------------------------------------------


def cut_points(df: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 ascending cut points per entry of ``features``: quantiles, so every value of a feature with few of them."""
    x = vector_to_array("features")
    wide = df.select(*[x[i].alias(f"f{i}") for i in range(width)])
    # the last quantile is the largest value
    found = wide.approxQuantile(wide.columns, [i / bins for i in range(1, bins + 1)], 0.1 / bins) if width else []
    return [sorted({float(v) for v in f if v < f[-1]}) for f in found]


_BLOCK_SCHEMA = "g int, n int, key binary, y binary, w binary, held binary, x binary, m binary"
_KINDS = {"key": np.uint64, "y": np.int32, "w": np.float64, "held": np.bool_}


def binned(df: DataFrame, cuts: list[list[float]], label: str, row_id: str, weight: Column | None = None, group: Column | None = None,
           held: Column | None = None, pairs: int | None = None, name: str = "binned", count: int | None = None) -> DataFrame:
    """Blocks of rows of one group (g, n, key, y, w, held, x, m): hash of the row id, label, weight, whether the row is only watched, a byte per feature, margins.

    A column of a block is one array. ``pairs`` is about how many (tree, row) pairs a pass looks at: few of them are left to few tasks, as the rows are read once a level.
    Rows are cut into bins where they stand, and blocks are dealt out: smaller ones where a table of about ``count`` rows would leave some tasks without.
    """
    rows = df.select((group if group is not None else F.lit(0)).cast("int").alias("g"), F.xxhash64(F.col(row_id).cast("string")).alias("key"),
                     F.col(label).cast("int").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"),
                     (held if held is not None else F.lit(False)).alias("held"), vector_to_array("features").alias("f"))

    session = df.sparkSession
    parts, cores = int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism
    if pairs is not None:
        parts = max(1, -(-pairs // TASK_ROWS))
        if parts > cores:  # whole waves of tasks, each file small enough
            parts = cores * max(1, min(-(-parts // cores), max(2, -(-pairs // (cores * FILE_ROWS)))))
    size = BLOCK if count is None else max(256, min(BLOCK, count // (8 * parts)))

    def run(batches):
        waiting: dict[int, list] = {}  # a group's rows until they make a block
        for b in batches:
            columns = [b.column("key").to_numpy().view(np.uint64), b.column("y").to_numpy().astype(np.int32), b.column("w").to_numpy(),
                       b.column("held").to_numpy(zero_copy_only=False), _codes(_matrix(b.column("f"), len(cuts)), cuts)]
            g = b.column("g").to_numpy()
            for value in np.unique(g).tolist():
                own = g == value
                parts = waiting.pop(value, []) + [[c if own.all() else c[own] for c in columns]]
                if sum(len(p[0]) for p in parts) >= size:
                    whole = [np.concatenate(c) for c in zip(*parts)]
                    full = len(whole[0]) // size * size
                    for i in range(0, full, size):
                        yield _packed_block(value, *(c[i:i + size] for c in whole))
                    parts = [[c[full:] for c in whole]] if full < len(whole[0]) else []
                if parts:
                    waiting[value] = parts
            if sum(len(p[0]) for parts in waiting.values() for p in parts) > 64 * BLOCK:  # many groups
                for value, parts in waiting.items():
                    yield _packed_block(value, *(np.concatenate(c) for c in zip(*parts)))
                waiting = {}
        for value, parts in waiting.items():
            yield _packed_block(value, *(np.concatenate(c) for c in zip(*parts)))

    return _few_at_once(materialize(rows.mapInArrow(run, _BLOCK_SCHEMA).repartition(parts), name))


def _packed_block(g: int, key, y, w, held, x, m=None) -> pa.RecordBatch:
    """A block as a batch of one row; features and margins are kept column by column."""
    arrays = [np.ascontiguousarray(a).tobytes() for a in (key, y, w, held, x.T)]
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([len(key)], pa.int32()), *(pa.array([a], pa.binary()) for a in arrays),
                                       pa.array([b"" if m is None else np.ascontiguousarray(m).tobytes()], pa.binary())],
                                      names=["g", "n", "key", "y", "w", "held", "x", "m"])


def _few_at_once(rows: DataFrame) -> DataFrame:
    """The blocks, read in Arrow batches of at most ARROW_BYTES: by default a task would hold a whole file of them outside the heap, several times over.

    The session keeps the setting, as what reads the blocks is lazy.
    """
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    return rows


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if width else np.zeros((len(column), 0))


def _codes(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(c), x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) \
        if cuts else np.zeros((len(x), 0), np.uint8)


def _blocks(batches):
    """(g, key, y, w, held, x, m) of the rows of one block; x has features as rows, m models."""
    for b in batches:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            cells = {c: np.frombuffer(b.column(c)[i].as_buffer(), kind) for c, kind in _KINDS.items()}
            x = np.frombuffer(b.column("x")[i].as_buffer(), np.uint8).reshape(-1, n)
            m = np.frombuffer(b.column("m")[i].as_buffer(), np.float64).reshape(-1, n)
            yield b.column("g")[i].as_py(), *cells.values(), x, m


# --- trees as arrays ------------------------------------------------------------------------------


_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACE_OF_BIT = ((np.uint64(1) << np.arange(64, dtype=np.uint64)) * _DEBRUIJN) >> np.uint64(58)
MASKED_TREES = 512  # more trees are walked


@dataclass
class Packed:
    """Several trees as padded arrays (trees x nodes); x has features as rows.

    Trees over bins with at most 64 leaves also have, for every feature they use, the leaves that each bin leaves open: a row's leaf is the
    leftmost one open by all its features.
    """

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    masks: list | None = None

    @classmethod
    def of(cls, trees: list[Tree], bins: int = 0) -> Packed:
        width = max((len(t.feature) for t in trees), default=1)
        feature, child = np.zeros((len(trees), width), np.intp), np.zeros((len(trees), width, 2), np.intp)
        cut, value = np.zeros((len(trees), width)), np.zeros((len(trees), width))
        for i, t in enumerate(trees):
            n, at = len(t.feature), np.arange(len(t.feature))
            f = np.array(t.feature)
            feature[i, :n], cut[i, :n], value[i, :n] = np.maximum(f, 0), t.cut, t.value
            child[i, :n] = np.where((f >= 0)[:, None], np.stack([t.left, t.right], axis=1), at[:, None])  # a leaf leads to itself
        masks = None
        if bins and len(trees) <= MASKED_TREES and all(t.leaves() <= 64 for t in trees):
            masks = [_masks(t, bins) for t in trees]
        return cls(feature, cut, child, value, max((max(t.depth) for t in trees), default=0), masks)

    def nodes(self, x: np.ndarray, some: slice = slice(None), table: np.ndarray | None = None) -> np.ndarray:
        """Leaf of every tree (rows) and row of x (columns), or what ``table`` (trees x nodes) says of it."""
        if self.masks is not None:
            out = np.empty((len(self.feature[some]), x.shape[1]), np.intp if table is None else table.dtype)
            codes: dict = {}
            for i, (used, open_, leaves) in enumerate(self.masks[some]):
                own = leaves if table is None else table[some][i][leaves]
                if not used:
                    out[i] = own[_PLACE_OF_BIT[0]]
                    continue
                left = None
                for f, o in zip(used, open_):
                    if f not in codes:
                        codes[f] = x[f].astype(np.intp)
                    found = o.take(codes[f])
                    left = found if left is None else np.bitwise_and(left, found, out=left)
                left &= (~left) + np.uint64(1)
                left *= _DEBRUIJN
                left >>= np.uint64(58)
                out[i] = own.take(left.view(np.intp))
            return out
        feature, cut, child = self.feature[some], self.cut[some], self.child[some]
        trees, width, n = len(feature), feature.shape[1], x.shape[1]
        if n == 0 or trees == 0:
            return np.zeros((trees, n), np.intp if table is None else table.dtype)
        base = (np.arange(trees, dtype=np.intp) * width)[:, None]
        at = np.repeat(base, n, axis=1)
        rows, flat = np.arange(n, dtype=np.intp)[None, :], x.ravel()
        feature, cut, child = feature.ravel() * n, cut.ravel(), child.reshape(-1)
        for _ in range(self.depth):
            low = flat.take(feature.take(at) + rows) <= cut.take(at)
            at = child.take(2 * at + ~low) + base
        return at - base if table is None else table[some].ravel().take(at)

    def values(self, x: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        return self.nodes(x, some, self.value)


def _masks(tree: Tree, bins: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(features used, leaves left open by each of their bins, node of each leaf by the place of its bit)."""
    leaves, under = np.zeros(64, np.intp), {}
    count, stack = 0, [(0, False)]
    while stack:  # leaves from left to right; a node's leaves are numbered one after the other
        node, back = stack.pop()
        if back:
            under[node] = (under[node], count)
        elif tree.feature[node] < 0:
            leaves[_PLACE_OF_BIT[count]] = node
            under[node] = (count, count + 1)
            count += 1
        else:
            under[node] = count
            stack += [(node, True), (tree.right[node], False), (tree.left[node], False)]
    used = sorted({f for f in tree.feature if f >= 0})
    open_ = np.full((len(used), bins), ~np.uint64(0))
    for node, f in enumerate(tree.feature):
        if f >= 0 and node in under:
            lo, hi = under[tree.left[node]]
            gone = np.uint64(((1 << hi) - (1 << lo)))
            open_[used.index(f), int(tree.cut[node]) + 1:] &= ~gone
    return used, open_, leaves


LANE = 8  # leaves of a tree that shares its masks with others


@dataclass
class Lanes:
    """Up to eight trees of at most eight leaves each, given as (model, masks, node values): a byte of a mask is what a tree's features leave open.

    Bins are looked up once for all of them; a byte then names the value of its leftmost open leaf.
    """

    places: list[int]
    used: list[int]
    open_: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, some: list[tuple], bins: int) -> Lanes:
        used = sorted({f for _, (features, _, _), _ in some for f in features})
        open_, values = np.full((len(used), bins), ~np.uint64(0)), np.zeros((len(some), 256))
        lowest = np.array([max((b & -b).bit_length() - 1, 0) for b in range(256)])
        for i, (_, (features, own, leaves), value) in enumerate(some):
            for f, o in zip(features, own):
                open_[used.index(f)] &= ~((~o & np.uint64(255)) << np.uint64(8 * i))
            values[i] = np.array(value)[leaves[_PLACE_OF_BIT[lowest]]]
        return cls([p for p, _, _ in some], used, open_, values)

    def add(self, margins: np.ndarray, codes: dict) -> None:
        left = np.full(margins.shape[1], ~np.uint64(0))
        for f, o in zip(self.used, self.open_):
            left &= o.take(codes[f])
        lanes = left.astype("<u8").view(np.uint8).reshape(-1, 8)
        for i, p in enumerate(self.places):
            margins[p] += self.values[i].take(lanes[:, i])


def _rounds(pending: list[tuple], bins: int) -> list:
    """Rounds of (models, trees) in the form that adds them fastest; every model's trees stay in order."""
    if all(t.leaves() <= LANE for _, some in pending for t in some):
        flat = [(p, _masks(t, bins), t.value) for places, some in pending for p, t in zip(places, some)]
        return [Lanes.of(flat[i:i + 8], bins) for i in range(0, len(flat), 8)]
    return [(np.array(places), Packed.of(some, bins)) for places, some in pending]


def _poisson(u: np.ndarray, rate) -> np.ndarray:
    """Poisson counts by inversion of uniform numbers; at most 12."""
    mass = np.exp(-np.asarray(rate, float))
    total, counts = mass.copy(), np.zeros(u.shape, np.int8)
    for i in range(12):
        more = u >= total
        if not more.any():
            break
        counts += more
        mass = mass * rate / (i + 1)
        total = total + mass
    return counts


# --- one level ------------------------------------------------------------------------------------


@dataclass
class Open:
    """A tree with its open nodes and the features each looks at."""

    job: int
    tree: int
    number: int
    nodes: list[int]
    subset: np.ndarray  # open nodes x features


def _channels(job_list, js, trees_no, key, y, w, margin, classes, watched):
    """(channels x trees x rows, drawn): what is summed, and which rows a tree draws."""
    jobs = [job_list[j] for j in js]
    seeds = np.array([hash((j.seed, t)) & ((1 << 63) - 1) for j, t in zip(jobs, trees_no)], np.uint64)
    kind, draw = jobs[0].kind, jobs[0].draw
    n = len(y)
    one = np.ones((len(jobs), n))
    counts = one
    if draw == "bootstrap":
        counts = _poisson(unit64(key, seeds), np.array([j.rate for j in jobs])[:, None]).astype(float)
    elif draw == "balanced":
        low = min(classes.values()) if classes else 0
        rate = np.where(y == 1, low / max(classes.get(1, 1), 1), low / max(classes.get(0, 1), 1))
        counts = _poisson(unit64(key, seeds), rate[None, :]).astype(float)
    elif draw == "share":
        counts = (unit64(key, seeds) < np.array([j.rate for j in jobs])[:, None]).astype(float)
    elif draw == "under":  # the larger class by the share that leaves it as large as the smaller
        big, small = (0, 1) if classes.get(0, 0) >= classes.get(1, 0) else (1, 0)
        share = classes.get(small, 0) / max(classes.get(big, 1), 1)
        counts = ((y == small)[None, :] | (unit64(key, seeds) < share)).astype(float)
    if kind == "forest":
        w = np.ones(n) if draw == "balanced" else w
        a, b = counts * (w * (y == 0)), counts * (w * (y == 1))
        return [a, b, (counts > 0).astype(float)], counts > 0
    if kind == "stumps":
        sign = np.where(y == 1, 1.0, -1.0)
        weight = np.exp(-sign * margin)
        a, b = weight * (y == 0), weight * (y == 1)
        return [a * counts, b * counts, counts, a, b], (counts >= 0)
    if jobs[0].patience:
        counts = counts * ~watched
    p = 1 / (1 + np.exp(-margin))
    scale = np.where(y == 1, np.array([j.positive_weight for j in jobs])[:, None], 1.0)
    g, h = (y - p) * scale, p * (1 - p) * scale
    return [g * counts, h * counts, counts], counts > 0


def _summed(kind: str, values: list[np.ndarray]) -> list[tuple]:
    """(rows or None for all, numbers or None for ones) that give every channel's sums: rows that add 0 are left out where they are most, rows drawn are counted."""
    out = []
    for c, v in enumerate(values):
        if c == 2 and kind != "stumps":  # only drawn rows are here, and each counts once
            out.append((None, None))
            continue
        some = np.flatnonzero(v) if kind in ("forest", "stumps") else None
        out.append((None, v) if some is None or 2 * len(some) > len(v) else (some, v[some]))
    return out


def _pass(rows: DataFrame, jobs: list[Job], opened: list[Open], bins: int, width: int, classes: dict, recent: dict, watch: bool) -> list:
    """Best split of every open node, and the sums of the node, of one pass: one Spark job.

    ``recent``: for each group the models' numbers, their start, and the trees grown since margins were written. With ``watch`` also the log-loss over held rows.
    """
    spark = rows.sparkSession
    lookup: dict[int, dict] = {}
    for o in opened:  # trees of one group, kind and draw are handled together
        j = jobs[o.job]
        lookup.setdefault(j.group, {}).setdefault((j.kind, j.draw, j.patience, len(o.nodes), o.subset.shape[1]), []).append(o)
    packs = {g: [(key, [(o.job, o.tree, o.number) for o in some], Packed.of([jobs[o.job].grown[o.tree] for o in some], bins),
                  _frontier(some, jobs), np.stack([o.subset for o in some])) for key, some in kinds.items()] for g, kinds in lookup.items()}
    slim = [Job(**{**vars(j), "grown": [], "alphas": [], "losses": []}) for j in jobs]
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((packs, slim, classes, recent)))
    chooser = spark.sparkContext.broadcast(cloudpickle.dumps({o.number: (slim[o.job], o.tree, o.subset, o.nodes) for o in opened}))

    def run(batches):
        import pickle

        held_packs, models, by_class, later = pickle.loads(shared.value)
        sums: dict = {}
        losses: dict[int, list] = {}
        patient = any(j.patience for j in models)
        for g, key, y, w, held, x, m in _blocks(batches):
            margins = _margins(later.get(g), m, x)
            watched = unit64(key, np.array([1], np.uint64))[0] < WATCHED if patient else np.zeros(len(key), bool)
            seen = watched & ~held
            if watch and margins is not None and seen.any():
                p = np.clip(1 / (1 + np.exp(-margins[:, seen])), 1e-15, 1 - 1e-15)
                loss = -np.where(y[seen] == 1, np.log(p), np.log(1 - p)).sum(axis=1)
                for j, v in zip(later[g][0], loss.tolist()):
                    t = losses.setdefault(j, [0.0, 0])
                    t[0], t[1] = t[0] + v, t[1] + int(seen.sum())
            fit = ~held
            if not fit.any():
                continue
            if not fit.all():
                key, y, w, x, watched = key[fit], y[fit], w[fit], np.ascontiguousarray(x[:, fit]), watched[fit]
                margins = margins[:, fit] if margins is not None else None
            codes, n = x.astype(np.intp), len(y)
            places = {j: i for i, j in enumerate(later[g][0])} if g in later else {}
            for number, (_, names, packed, frontier, subset) in enumerate(held_packs.get(g, [])):
                step = max(1, PAIRS // len(y))
                for a in range(0, len(names), step):
                    b = min(a + step, len(names))
                    js = [n[0] for n in names[a:b]]
                    own = margins[[places[j] for j in js]] if margins is not None else None
                    channels, drawn = _channels(models, js, [n[1] for n in names[a:b]], key, y, w, own, by_class.get(g, {}), watched)
                    at = packed.nodes(x, slice(a, b), frontier)
                    t, r = np.nonzero((at >= 0) & drawn)
                    cells = t * n + r
                    whole = len(cells) == at.size
                    if b - a == 1:
                        t = 0
                    fr = at.ravel() if whole else at.ravel().take(cells)
                    _, f, s = subset.shape
                    if (g, number) not in sums:
                        sums[g, number] = np.zeros((len(names), len(channels), f, s, bins))
                    total = sums[g, number][a:b]
                    values = _summed(models[js[0]].kind, [c.ravel() if whole else c.ravel().take(cells) for c in channels])
                    node = t * f + fr
                    place = node * bins
                    same = (subset[a:b] == subset[a, :1]).all()  # all nodes look at the same features
                    for k in range(s):
                        if same:
                            bin_ = codes[subset[a, 0, k]]
                            bin_ = bin_ if whole and b - a == 1 else bin_.take(r)
                        else:
                            bin_ = codes.ravel().take(subset[a:b, :, k].ravel().take(node) * n + r)
                        cell = place + bin_
                        for c, (some, v) in enumerate(values):
                            total[:, c, :, k, :] += np.bincount(cell if some is None else cell[some], v, (b - a) * f * bins).reshape(b - a, f, bins)
        for (g, number), total in sums.items():
            names = held_packs[g][number][1]
            for i in range(0, len(names), 256):
                part = total[i:i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([n[2] for n in names[i:i + 256]], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())],
                                                 names=["tree", "sums"])
        if losses:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - j for j in losses], pa.int64()), pa.array([np.array(v, float).tobytes() for v in losses.values()], pa.binary())],
                                             names=["tree", "sums"])

    def choose(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        import pickle

        total = sum(np.frombuffer(b, np.float64) for b in df["sums"])
        names = ["tree", "node", "feature", "cut", "gain", "total", "left", "right"]
        if key[0] < 0:
            return pd.DataFrame([(key[0], 0, -1, 0, 0.0, total.tolist(), [], [])], columns=names)
        job, tree, subset, nodes = pickle.loads(chooser.value)[int(key[0])]
        f, s = subset.shape
        return pd.DataFrame([(key[0], n, *best_split(job, total.reshape(-1, f, s, bins)[:, i], subset[i], (job.seed, tree, n))) for i, n in enumerate(nodes)],
                            columns=names)

    sent = rows.mapInArrow(run, "tree long, sums binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # about as many files as ``binned`` wrote
    if 8 * CHANNELS * bins * sum(o.subset.size for o in opened) * parts <= DIRECT:
        table = sent.toPandas()
        chooser_of = {int(t): df for t, df in table.groupby("tree")}
        found = [r for t, df in chooser_of.items() for r in choose((t,), df).itertuples(index=False)]
    else:
        found = sent.groupBy("tree").applyInPandas(
            choose, "tree long, node int, feature int, cut int, gain double, total array<double>, left array<double>, right array<double>").collect()
    shared.unpersist()
    chooser.unpersist()
    return found


def _frontier(some: list[Open], jobs: list[Job]) -> np.ndarray:
    """Number of the open node for every node of the trees, -1 for others."""
    width = max(len(jobs[o.job].grown[o.tree].feature) for o in some)
    out = np.full((len(some), width), -1, np.intp)
    for i, o in enumerate(some):
        out[i, o.nodes] = np.arange(len(o.nodes))
    return out


def _margins(later, saved: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Margins (models x rows): those written with the rows, or the start, and the trees since."""
    if later is None:
        return None
    models, start, rounds = later
    out = saved.copy() if len(saved) else np.repeat(np.array(start)[:, None], x.shape[1], axis=1)
    codes = {f: x[f].astype(np.intp) for f in {f for r in rounds if isinstance(r, Lanes) for f in r.used}}
    for r in rounds:
        if isinstance(r, Lanes):
            r.add(out, codes)
        else:
            out[r[0]] += r[1].values(x)
    return out


def best_split(job: Job, sums: np.ndarray, subset: np.ndarray, seed: tuple) -> tuple:
    """(feature, cut, gain, total, left, right) of a node from its sums (channels x features x bins); feature -1 without a split.

    Ties go to the feature that comes first in the node's list, then to the lowest cut.
    """
    total = sums[:, 0].sum(axis=1)
    none = (-1, 0, 0.0, total.tolist(), [], [])
    if total[2] < max(job.min_split, 2 * job.min_leaf):
        return none
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    ok = (left[2] >= job.min_leaf) & (right[2] >= job.min_leaf)
    with np.errstate(all="ignore"):
        if job.kind in ("forest", "stumps"):
            def impurity(a):  # weight times Gini
                n = a[0] + a[1]
                return np.where(n > 0, 2 * a[0] * a[1] / n, 0.0)

            gain = impurity(total) - impurity(left) - impurity(right)
        elif job.kind == "logistic":
            gain = left[2] * right[2] / total[2] * (left[0] / left[2] - right[0] / right[2]) ** 2
        else:
            ok &= (left[1] >= job.min_child_weight) & (right[1] >= job.min_child_weight)

            def quality(a):
                g = np.sign(a[0]) * np.maximum(np.abs(a[0]) - job.l1, 0.0)
                return g * g / (a[1] + job.l2)

            gain = (quality(left) + quality(right) - quality(total)) / 2
    gain = np.where(ok & np.isfinite(gain), gain, -1.0)
    if job.random_cuts:  # one cut a feature, between its least and largest value in the node
        rng = np.random.default_rng(abs(hash(seed)))
        some = np.zeros(gain.shape, bool)
        for k in range(gain.shape[0]):
            at = np.flatnonzero(sums[2, k] > 0)
            if len(at) > 1:
                some[k, int(rng.integers(at[0], at[-1]))] = True
        gain = np.where(some, gain, -1.0)
    k, c = divmod(int(np.argmax(gain)), gain.shape[1])
    if gain[k, c] <= 1e-12:
        return none
    return (int(subset[k]), c, float(gain[k, c]), total.tolist(), left[:, k, c].tolist(), right[:, k, c].tolist())


# --- growing --------------------------------------------------------------------------------------


def features_of(value: str | float | None, width: int) -> int:
    if value in (None, "all"):
        return width
    if value == "sqrt":
        return max(1, int(math.sqrt(width)))
    if value == "log2":
        return max(1, int(math.log2(width)))
    if value == "onethird":
        return max(1, math.ceil(width / 3))
    return max(1, int(float(value) * width)) if float(value) <= 1 else min(width, int(value))


def _subsets(job: Job, tree: int, nodes: list[int], width: int) -> np.ndarray:
    """Features that each node looks at: drawn per node, among those drawn for the tree."""
    pool = np.arange(width) if job.allowed is None else np.array(job.allowed)
    own = len(pool)
    if job.tree_features < 1:
        rng = np.random.default_rng(abs(hash((job.seed, tree))))
        pool = np.sort(rng.permutation(pool)[:max(1, int(round(job.tree_features * own)))])
    n = min(features_of(job.features, own), len(pool))
    if n == len(pool):
        return np.tile(pool, (len(nodes), 1))
    return np.stack([np.sort(np.random.default_rng(abs(hash((job.seed, tree, node, 1)))).permutation(pool)[:n]) for node in nodes])


def _grow(rows: DataFrame, jobs: list[Job], which: list[tuple[int, int]], bins: int, width: int, classes: dict, recent: dict, watch: bool = False) -> dict[int, tuple]:
    """Grows the given trees (job, tree) to the end, a level of all of them at a time. Returns the watched losses by job."""
    open_nodes = {jt: [0] for jt in which}
    losses: dict[int, tuple] = {}
    weight_of: dict[tuple[int, int], float] = {}
    while open_nodes:
        waiting, found = [], []
        numbers = {}
        for (j, t), nodes in open_nodes.items():
            subset = _subsets(jobs[j], t, nodes, width)
            # a tree with very many open nodes looks at them in several passes
            step = max(1, CELLS // (subset.shape[1] * bins * CHANNELS))
            for a in range(0, len(nodes), step):
                o = Open(j, t, len(numbers), nodes[a:a + step], subset[a:a + step])
                numbers[o.number] = (j, t)
                waiting.append(o)
        while waiting:
            some, cells = [], 0
            while waiting and (not some or cells + waiting[0].subset.size * bins * CHANNELS <= CELLS):
                cells += waiting[0].subset.size * bins * CHANNELS
                some.append(waiting.pop(0))
            found += _pass(rows, jobs, some, bins, width, classes, recent, watch)
            watch = False
        splits: dict[tuple[int, int], list] = {}
        for r in found:
            if r.tree < 0:
                losses[-1 - r.tree] = tuple(r.total)
                continue
            j, t = numbers[r.tree]
            tree = jobs[j].grown[t]
            tree.stats[r.node] = tuple(r.total)
            if r.node == 0:
                weight_of[j, t] = r.total[0] + r.total[1]
            scale = weight_of[j, t] if jobs[j].kind == "forest" else 1.0  # the least decrease is a share of the whole weight
            if r.feature >= 0 and r.gain >= jobs[j].min_gain * scale:
                splits.setdefault((j, t), []).append(r)
        open_nodes = {}
        for (j, t), rows_of in splits.items():
            job, tree = jobs[j], jobs[j].grown[t]
            left_over = (job.max_leaves or 1 << 30) - tree.leaves()
            for r in sorted(rows_of, key=lambda r: (-r.gain, r.node))[:max(left_over, 0)]:
                children = tree.split(r.node, r.feature, r.cut, tuple(r.left), tuple(r.right))
                if tree.depth[children[0]] < job.depth:
                    open_nodes.setdefault((j, t), []).extend(children)
    return losses


def prune(tree: Tree, alpha: float) -> None:
    """Minimal cost-complexity pruning: the weakest link goes as long as its cost per leaf is at most ``alpha`` (costs as shares of the root's weight)."""
    total = tree.stats[0][0] + tree.stats[0][1]
    if alpha <= 0 or total <= 0:
        return
    cost = [2 * s[0] * s[1] / (s[0] + s[1]) / total if s[0] + s[1] > 0 else 0.0 for s in tree.stats]
    while tree.feature[0] >= 0:
        below = {}
        for n in reversed(range(len(tree.feature))):  # children have larger numbers
            below[n] = (cost[n], 1) if tree.feature[n] < 0 else tuple(a + b for a, b in zip(below[tree.left[n]], below[tree.right[n]]))
        reach, stack = [], [0]
        while stack:
            n = stack.pop()
            if tree.feature[n] >= 0:
                reach.append(n)
                stack += [tree.left[n], tree.right[n]]
        link, node = min(((cost[n] - below[n][0]) / (below[n][1] - 1), n) for n in reach)
        if link > alpha:
            return
        tree.feature[node] = -1


def _class_sizes(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Rows to learn from, by group and class, and the number of features under -1."""
    def run(batches):
        found: dict = {}
        for g, _, y, _, held, x, _ in _blocks(batches):
            for value, n in zip(*np.unique(y[~held], return_counts=True)):
                found[g, int(value), len(x)] = found.get((g, int(value), len(x)), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()),
                                          pa.array([k[2] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["g", "y", "width", "n"])

    sizes: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(run, "g int, y int, width int, n long").groupBy("g", "y", "width").agg(F.sum("n").alias("n")).collect():
        sizes.setdefault(r.g, {})[r.y] = r.n
        sizes[-1] = {0: r.width}
    return sizes


def train(rows: DataFrame, jobs: list[Job], bins: int = BINS) -> list[Job]:
    """Trains all jobs on a table of ``binned``; the same rows give the same trees whatever the partitioning, up to the rounding of sums."""
    classes = _class_sizes(rows)
    width = classes.pop(-1, {0: 0})[0]
    for j in jobs:
        if not classes.get(j.group):
            raise ValueError("there are no rows to train on")
    forests = [i for i, j in enumerate(jobs) if j.kind == "forest"]
    for i in forests:
        jobs[i].grown = [Tree() for _ in range(jobs[i].trees)]
    if forests:
        _grow(rows, jobs, [(i, t) for i in forests for t in range(jobs[i].trees)], bins, width, classes, {})
        for i in forests:
            for tree in jobs[i].grown:
                prune(tree, jobs[i].prune)
                tree.value = [s[1] / (s[0] + s[1]) if s[0] + s[1] > 0 else 0.5 for s in tree.stats]
    boosted = [i for i, j in enumerate(jobs) if j.kind != "forest"]
    if boosted:
        _boost(rows, jobs, boosted, bins, width, classes)
    return jobs


def _boost(rows: DataFrame, jobs: list[Job], boosted: list[int], bins: int, width: int, classes: dict) -> None:
    for i in boosted:
        n = classes[jobs[i].group]
        jobs[i].start = math.log((n.get(1, 0) + 1e-9) / (n.get(0, 0) + 1e-9)) if jobs[i].kind == "logistic" else 0.0
    members = {g: [i for i in boosted if jobs[i].group == g] for g in {jobs[i].group for i in boosted}}
    place = {i: k for some in members.values() for k, i in enumerate(some)}
    pending: dict[int, list] = {g: [] for g in members}  # rounds since margins were written
    rounds, watch = 0, any(jobs[i].patience for i in boosted)

    def later():
        return {g: (some, [jobs[i].start for i in some], _rounds(pending[g], bins)) for g, some in members.items()}

    while True:
        active = [i for i in boosted if not jobs[i].done and len(jobs[i].grown) < jobs[i].trees]
        if not active:
            break
        for i in active:
            jobs[i].grown.append(Tree())
        losses = _grow(rows, jobs, [(i, len(jobs[i].grown) - 1) for i in active], bins, width, classes, later(), watch)
        fresh: dict[int, list[int]] = {}
        for i in active:
            job, tree = jobs[i], jobs[i].grown[-1]
            if job.patience and i in losses and losses[i][1]:
                job.losses.append(losses[i][0] / losses[i][1])  # after the rounds before this one
                best = int(np.argmin(job.losses))
                if len(job.losses) - 1 - best >= PATIENCE:
                    job.grown, job.done = job.grown[:best], True  # losses[k] is that of k trees
                    continue
            if _finish(job, tree):
                fresh.setdefault(job.group, []).append(i)
            else:
                job.done = True
        for g, some in fresh.items():
            pending[g].append(([place[i] for i in some], [jobs[i].grown[-1] for i in some]))
        rounds += 1
        if rounds % SAVE == 0:
            rows = _saved(rows, later())
            pending = {g: [] for g in members}


def _finish(job: Job, tree: Tree) -> bool:
    """Leaf values of a grown tree; False where the model ends, without the tree if it is of no use."""
    if job.kind == "stumps":
        _, _, _, a, b = (sum(s[c] for n, s in enumerate(tree.stats) if tree.feature[n] < 0) for c in range(5))
        votes = [1.0 if s[1] > s[0] else -1.0 for s in tree.stats]
        wrong = sum(s[3] if v > 0 else s[4] for n, (s, v) in enumerate(zip(tree.stats, votes)) if tree.feature[n] < 0)
        error = wrong / (a + b) if a + b > 0 else 0.5
        if error >= 0.5:
            job.grown.pop()
            return False
        alpha = 0.5 * job.learning_rate * math.log((1 - max(error, 1e-10)) / max(error, 1e-10))
        job.alphas.append(alpha)
        tree.value = [alpha * v for v in votes]
        return error > 0
    for n, s in enumerate(tree.stats):
        if job.kind == "logistic":
            step = s[0] / s[1] if s[1] > 1e-150 else 0.0
        else:
            g = math.copysign(max(abs(s[0]) - job.l1, 0.0), s[0])
            step = g / (s[1] + job.l2) if s[1] + job.l2 > 0 else 0.0
            if job.max_step > 0:
                step = min(max(step, -job.max_step), job.max_step)
        tree.value[n] = job.learning_rate * step
    # without a split a further round over the same rows and features finds none either
    return tree.feature[0] >= 0 or job.draw != "all" or job.tree_features < 1 or job.features != "all" or job.patience


def _saved(rows: DataFrame, later: dict) -> DataFrame:
    """The rows with their margins up to now; the trees so far need not be walked again."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(later))

    def run(batches):
        import pickle

        held = pickle.loads(shared.value)
        for g, key, y, w, seen, x, m in _blocks(batches):
            margins = _margins(held.get(g), m, x)
            yield _packed_block(g, key, y, w, seen, x.T, margins if margins is not None else m)

    return materialize(rows.mapInArrow(run, rows.schema), "margins")


# --- scoring --------------------------------------------------------------------------------------


@dataclass
class TreesScorer:
    """A trained job on raw features: ``trees`` have cut values in place of bins. ``score`` adds p1."""

    kind: str
    trees: list[Tree]
    start: float = 0.0
    scale: float = 1.0

    @classmethod
    def of(cls, job: Job, cuts: list[list[float]]) -> TreesScorer:
        trees = []
        for t in job.grown:
            raw = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut)]
            trees.append(Tree(list(t.feature), raw, list(t.left), list(t.right), list(t.depth), [], list(t.value)))
        scale = float(max(len(trees), 1)) if job.kind == "forest" else (sum(job.alphas) or 1.0) if job.kind == "stumps" else 1.0
        return cls(job.kind, trees, job.start, scale)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.kind, self.trees, self.start, self.scale, np.ascontiguousarray(x.T))

    def score(self, df: DataFrame, output: str = "p1") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((self.kind, self.trees, self.start, self.scale)))

        @F.pandas_udf("double")
        def run(features: pd.Series) -> pd.Series:
            import pickle

            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, 1))
            return pd.Series(probabilities(*pickle.loads(shared.value), np.ascontiguousarray(x.T)))

        return df.withColumn(output, run(vector_to_array("features")))


def probabilities(kind: str, trees: list[Tree], start: float, scale: float, x: np.ndarray, bins: int = 0) -> np.ndarray:
    """Scores of the columns of x; ``bins`` where x holds bins."""
    total = np.full(x.shape[1], start)
    packed = Packed.of(trees, bins)
    for a in range(0, x.shape[1], BLOCK):
        part = np.ascontiguousarray(x[:, a:a + BLOCK])
        step = max(1, PAIRS // max(part.shape[1], 1))
        for b in range(0, len(trees), step):
            total[a:a + BLOCK] += packed.values(part, slice(b, b + step)).sum(axis=0)
    if kind == "forest":
        return total / scale if trees else np.full(x.shape[1], 0.5)
    return 1 / (1 + np.exp(-total / scale))


def score_rows(rows: DataFrame, jobs: list[Job], groups: list[int] | None = None, counted: bool = False) -> DataFrame:
    """(candidate, side, y, p1) of all rows of ``binned`` under all jobs of their group, in one pass; ``groups`` names others to score than those trained on.

    With ``counted`` the rows of a task are counted instead: (candidate, side, y, pred, n).
    """
    slim = [(j.group if groups is None else groups[i], j.kind, j.grown, j.start, float(max(len(j.grown), 1)) if j.kind == "forest" else (sum(j.alphas) or 1.0) if j.kind == "stumps" else 1.0)
            for i, j in enumerate(jobs)]
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(slim))

    def run(batches):
        import pickle

        models = pickle.loads(shared.value)
        counts = np.zeros((len(models), 2, 2, 2), np.int64)
        for g, _, y, _, held, x, _ in _blocks(batches):
            for i, (group, kind, trees, start, scale) in enumerate(models):
                if group == g and counted:
                    pred = probabilities(kind, trees, start, scale, x, BINS) > 0.5
                    known = (y == 0) | (y == 1)
                    counts[i] += np.bincount((held * 4 + y * 2 + pred)[known], minlength=8).reshape(2, 2, 2)
                elif group == g:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), i, np.int32)), pa.array(held), pa.array(y.astype(np.int32)),
                                                      pa.array(probabilities(kind, trees, start, scale, x, BINS))], names=["candidate", "held", "y", "p1"])

        if counted:
            at = np.argwhere(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1] > 0), pa.array(at[:, 2].astype(np.int32)),
                                              pa.array(at[:, 3].astype(np.int32)), pa.array(counts[counts != 0])], names=["candidate", "held", "y", "pred", "n"])

    out = rows.mapInArrow(run, "candidate int, held boolean, y int, " + ("pred int, n long" if counted else "p1 double"))
    return out.withColumn("side", F.when(F.col("held"), "val").otherwise("train")).drop("held")
