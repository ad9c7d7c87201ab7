"""The batched tree trainer against plain Python: splits, draws, boosting rounds, early stop, pruning."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from raresift.operators import models, trees
from raresift.sources.storage import materialize

WIDTH = 4


@pytest.fixture(scope="module")
def data(spark):
    """Few values a feature, so that every value is a cut; labels with noise; unequal classes."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 7, (400, WIDTH)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 8) ^ (rng.random(400) < 0.1)).astype(int)
    rows = [(f"r{i}", *x[i].tolist(), int(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double, d double, Class int").repartition(3)
    return x, y, materialize(VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).select("row_id", "features", "Class"))


def table(df, held=None):
    cuts = trees.cut_points(df, WIDTH)
    return cuts, trees.binned(df, cuts, "Class", "row_id", held=held)


def gini(w0, w1):
    return 2 * w0 * w1 / (w0 + w1) if w0 + w1 else 0.0


def best_by_trial(x, y, w, at, min_leaf=1):
    """Largest decrease over all features and values, first feature and lowest cut among equals."""
    best = (1e-12, None, None)
    sums = lambda m: (w[m & (y == 0)].sum(), w[m & (y == 1)].sum())
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            low = at & (x[:, f] <= c)
            high = at & (x[:, f] > c)
            if low.sum() < min_leaf or high.sum() < min_leaf:
                continue
            gain = gini(*sums(at)) - gini(*sums(low)) - gini(*sums(high))
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    return best


def walk(tree, cuts, x, node=0, at=None):
    at = np.ones(len(x), bool) if at is None else at
    yield node, at
    if tree.feature[node] >= 0:
        low = x[:, tree.feature[node]] <= cuts[tree.feature[node]][tree.cut[node]]
        yield from walk(tree, cuts, x, tree.left[node], at & low)
        yield from walk(tree, cuts, x, tree.right[node], at & ~low)


def test_every_value_is_a_cut(data):
    x, _, df = data
    assert trees.cut_points(df, WIDTH) == [[float(v) for v in range(6)]] * WIDTH


@pytest.mark.parametrize("min_leaf,depth", [(1, 3), (25, 6)])
def test_tree_takes_the_best_splits(data, min_leaf, depth):
    x, y, df = data
    cuts, rows = table(df)
    job, = trees.train(rows, [trees.Job("forest", 1, depth=depth, min_leaf=min_leaf)])
    tree, w = job.grown[0], np.ones(len(y))
    inner = 0
    for node, at in walk(tree, cuts, x):
        assert tree.stats[node][:3] == (float((at & (y == 0)).sum()), float((at & (y == 1)).sum()), float(at.sum()))
        gain, f, c = best_by_trial(x, y, w, at, min_leaf)
        if tree.depth[node] == depth:
            assert tree.feature[node] < 0
        elif f is None:
            assert tree.feature[node] < 0
        else:
            inner += 1
            low = x[:, tree.feature[node]] <= cuts[tree.feature[node]][tree.cut[node]]
            own = gini(*tree.stats[node][:2]) - sum(gini((at & s & (y == 0)).sum(), (at & s & (y == 1)).sum()) for s in (low, ~low))
            assert own == pytest.approx(gain)
    assert inner > 3


def test_leaf_budget_and_least_gain(data):
    _, _, df = data
    _, rows = table(df)
    jobs = trees.train(rows, [trees.Job("forest", 1, depth=8, max_leaves=n) for n in (2, 5, 9)] + [trees.Job("forest", 1, depth=8, min_gain=0.05)])
    assert [j.grown[0].leaves() for j in jobs[:3]] == [2, 5, 9] and jobs[3].grown[0].leaves() < 9


def test_pruning_takes_the_weakest_link(data):
    _, _, df = data
    _, rows = table(df)
    whole, some, none = (j.grown[0] for j in trees.train(rows, [trees.Job("forest", 1, depth=4, prune=a) for a in (0.0, 0.005, 10.0)]))

    def cost(tree):
        reach, stack, total = 0, [0], 0.0
        while stack:
            n = stack.pop()
            if tree.feature[n] >= 0:
                stack += [tree.left[n], tree.right[n]]
            else:
                reach, total = reach + 1, total + gini(*tree.stats[n][:2]) / 400
        return reach, total

    (a, u), (b, v), (c, _) = cost(whole), cost(some), cost(none)
    assert a > b > c == 1 and v + 0.005 * b <= u + 0.005 * a + 1e-12  # the pruned tree is the cheaper one


def test_trees_differ_in_sample_cuts_and_features(data):
    _, _, df = data
    _, rows = table(df)
    boot, extra, even, one = trees.train(rows, [
        trees.Job("forest", 8, draw="bootstrap", features="sqrt"), trees.Job("forest", 8, random_cuts=True), trees.Job("forest", 8, draw="balanced"),
        trees.Job("forest", 3)])
    roots = lambda j: [t.stats[0] for t in j.grown]
    assert len(set(roots(boot))) > 5 and all(abs(s[0] + s[1] - 400) < 100 for s in roots(boot))
    assert len(set(roots(extra))) == 1 and len({(t.feature[0], t.cut[0]) for t in extra.grown}) > 3
    rare = min(roots(one)[0][:2])
    assert len(set(roots(even))) > 5 and all(abs(s[0] - rare) < 50 and abs(s[1] - rare) < 50 for s in roots(even))
    assert len({(tuple(t.feature), tuple(t.cut)) for t in one.grown}) == 1
    again, = trees.train(rows.repartition(5), [trees.Job("forest", 8, draw="bootstrap", features="sqrt")])
    assert [(t.feature, t.cut) for t in again.grown] == [(t.feature, t.cut) for t in boot.grown]  # partitioning is of no matter


@pytest.mark.parametrize("direct", [1 << 24, 0])
def test_boosted_stumps_as_by_hand(data, direct, monkeypatch):
    monkeypatch.setattr(trees, "DIRECT", direct)
    monkeypatch.setattr(trees, "SAVE", 2)
    x, y, df = data
    cuts, rows = table(df)
    job, = trees.train(rows, [trees.Job("stumps", 5, depth=1, learning_rate=0.7)])
    sign, margin = np.where(y == 1, 1.0, -1.0), np.zeros(len(y))
    for tree, alpha in zip(job.grown, job.alphas, strict=True):
        w = np.exp(-sign * margin)
        gain, f, c = best_by_trial(x, y, w, np.ones(len(y), bool))
        assert (tree.feature[0], cuts[f][tree.cut[0]]) == (f, c)
        low = x[:, f] <= c
        vote = np.where(low, np.where(w[low & (y == 1)].sum() > w[low & (y == 0)].sum(), 1.0, -1.0), np.where(w[~low & (y == 1)].sum() > w[~low & (y == 0)].sum(), 1.0, -1.0))
        error = w[vote != sign].sum() / w.sum()
        assert alpha == pytest.approx(0.35 * math.log((1 - error) / error))
        margin += alpha * vote
    p1 = {r.row_id: r.p1 for r in trees.TreesScorer.of(job, cuts).score(df).collect()}
    assert [p1[f"r{i}"] for i in range(400)] == pytest.approx((1 / (1 + np.exp(-margin / sum(job.alphas)))).tolist())


def test_gradient_rounds_as_by_hand(data):
    x, y, df = data
    cuts, rows = table(df)
    lam, lr = 1.5, 0.4
    job, = trees.train(rows, [trees.Job("penalised", 4, depth=1, learning_rate=lr, l2=lam, min_child_weight=2.0)])
    margin = np.zeros(len(y))
    for tree in job.grown:
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        best = (0.0, None, None)
        q = lambda m: g[m].sum() ** 2 / (h[m].sum() + lam)
        for f in range(WIDTH):
            for c in range(6):
                low = x[:, f] <= c
                if min(h[low].sum(), h[~low].sum()) >= 2.0:
                    gain = (q(low) + q(~low) - q(low | ~low)) / 2
                    best = max(best, (gain, f, c), key=lambda b: b[0])
        assert (tree.feature[0], cuts[best[1]][tree.cut[0]]) == best[1:]
        low = x[:, best[1]] <= best[2]
        margin += lr * np.where(low, g[low].sum() / (h[low].sum() + lam), g[~low].sum() / (h[~low].sum() + lam))
    p1 = {r.row_id: r.p1 for r in trees.TreesScorer.of(job, cuts).score(df).collect()}
    assert [p1[f"r{i}"] for i in range(400)] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_patience_cuts_at_the_best_round(spark):
    """Labels without any rule: the watched loss soon turns."""
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", rng.normal(size=5).tolist(), int(rng.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id string, v array<double>, Class int")
    from pyspark.ml.functions import array_to_vector

    df = df.select("row_id", array_to_vector("v").alias("features"), "Class")
    cuts = trees.cut_points(df, 5)
    job, = trees.train(trees.binned(df, cuts, "Class", "row_id"), [trees.Job("logistic", 60, depth=4, learning_rate=0.3, patience=True)])
    best = int(np.argmin(job.losses))
    assert len(job.grown) == best and len(job.losses) == best + 1 + trees.PATIENCE < 60


def test_jobs_of_groups_learn_from_their_rows_only(data):
    x, y, df = data
    cuts = trees.cut_points(df, WIDTH)
    two = df.withColumn("g", F.lit(0)).unionByName(df.where("Class = 1 or xxhash64(row_id) % 2 = 0").withColumn("g", F.lit(1)))
    both = trees.binned(two, cuts, "Class", "row_id", group=F.col("g"))
    a, b, c = trees.train(both, [trees.Job("penalised", 3, g, depth=2, allowed=f) for g, f in ((0, None), (1, None), (1, [2, 3]))])
    alone, = trees.train(table(df)[1], [trees.Job("penalised", 3, depth=2)])
    for t, u in zip(a.grown, alone.grown, strict=True):
        assert (t.feature, t.cut) == (u.feature, u.cut) and t.value == pytest.approx(u.value)
    assert a.grown[0].stats[0][2] == 400 > b.grown[0].stats[0][2] and {f for t in c.grown for f in t.feature} <= {-1, 2, 3}


def test_empty_and_one_class(spark, data):
    _, _, df = data
    with pytest.raises(ValueError, match="no rows"):
        trees.train(trees.binned(df.limit(0), [[0.0]] * WIDTH, "Class", "row_id"), [trees.Job("forest", 1)])
    cuts, rows = table(df.where("Class = 0"))
    jobs = trees.train(rows, [trees.Job("forest", 2), trees.Job("stumps", 3, depth=1), trees.Job("penalised", 3)])
    assert all(j.grown[0].feature == [-1] for j in jobs[:2])
    assert {r.p1 for r in trees.TreesScorer.of(jobs[0], cuts).score(df).collect()} == {0.0}


def test_parameters_reach_the_trainer():
    m = models.make_base_model("XGBClassifier", {"gamma": 1.5, "reg_alpha": 0.2, "reg_lambda": 3.0, "subsample": 0.7, "colsample_bytree": 0.8, "scale_pos_weight": 4.0,
                                                 "min_child_weight": 3, "max_delta_step": 2, "max_depth": 4, "n_estimators": 9, "learning_rate": 0.05})
    j = models.tree_job(m)
    assert (j.min_gain, j.l1, j.l2, j.rate, j.tree_features, j.positive_weight, j.min_child_weight, j.max_step, j.depth, j.trees, j.learning_rate) == \
        (1.5, 0.2, 3.0, 0.7, 0.8, 4.0, 3.0, 2.0, 4, 9, 0.05)
    m = models.make_base_model("RandomForestClassifier", {"max_leaf_nodes": 7, "min_samples_split": 4, "ccp_alpha": 0.01, "max_samples": 0.6, "max_features": "log2"})
    j = models.tree_job(m)
    assert (j.max_leaves, j.min_split, j.prune, j.rate, j.features, j.draw) == (7, 4, 0.01, 0.6, "log2", "bootstrap")
