import random
import zlib

import numpy as np
import pytest

from raresift.llm import quality

SCHEMA = "doc_id long, text string, label string, score double, key string"


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 120))]
        good = i % 4 != 0
        if not good:
            words = [[w + rng.choice(["###", "$$$"]) for w in words], [w.upper() + "!!" for w in words], [w for w in words for _ in range(4)]][i // 4 % 3]
        docs.append((i, " ".join(words), str(good), 0.1, "x"))
        labels.append((i, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    return df, lab, quality.learn(df, lab)


def test_held_out_documents(spark, fitted):
    df, lab, model = fitted
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    truth = dict(corpus()[1])
    unseen = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.3) == bool(truth[i]) for i in unseen])
    assert len(unseen) > 80 and right > 0.97


def test_held_out_labels_are_not_learned(spark, fitted):
    df, lab, model = fitted
    turned = lab.rdd.map(lambda r: (r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality)).toDF("doc_id long, quality int")
    again = quality.learn(df, turned)
    assert np.array_equal(again.gain, model.gain) and again.base == model.base


def test_features():
    f = quality.Features(17)
    texts = ["ab cd", "", "ab  ab\t\tab", "x", " ab cd\n", "ab ab ab", "a" * 70 + " b"]
    found = list(f.of(texts))
    rows, buckets = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    bag = lambda i: sorted(buckets[rows == i].tolist())
    assert bag(0) == bag(4) and bag(2) == bag(5) and bag(1) == []
    # words, pairs, and n-grams of "_ab_": _ab ab_ _ab_
    assert len(bag(0)) == 2 + 1 + 6 and len(bag(3)) == 1 + 1
    alone = [sorted(np.concatenate([b[r == 0] for r, b in f.of([t])] or [np.zeros(0, int)]).tolist()) for t in texts]
    assert alone == [bag(i) for i in range(len(texts))]
    repeated = next(iter({b for b in bag(2)} & {b for b in sorted(np.concatenate([b for _, b in f.of(["zz zz"])]).tolist())}), None)
    assert repeated is not None  # that a word follows itself is one feature


def test_score_is_the_average_through_the_layers():
    """The gains are what the two layers give: a brute-force forward pass agrees."""
    rng = np.random.default_rng(0)
    docs = [(np.unique(rng.integers(0, 64, 9)), None, int(rng.integers(2))) for _ in range(50)]
    docs = [(b, rng.integers(1, 4, len(b)), y) for b, _, y in docs]
    model = quality.train(docs, 6, width=4, epochs=3)
    total = np.array([(model.gain[b] * c).sum() for b, c, _ in docs])
    count = np.array([c.sum() for _, c, _ in docs])
    s = model.score(total, count)
    assert ((0 < s) & (s < 1)).all()
    better = np.mean([(p >= 0.5) == y for p, (_, _, y) in zip(quality.train(docs, 6, width=4, epochs=60).score(
        *map(np.array, zip(*[((quality.train(docs, 6, width=4, epochs=60).gain[b] * c).sum(), c.sum()) for b, c, _ in docs]))), docs)])
    assert better > 0.8


def test_edges(spark, fitted):
    df, lab, model = fitted
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the " * 100_000), (5, "a"), (5, "a"), (None, "then there")]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    s = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and s[1] == s[2] == s[3]
    assert quality.score(df.limit(0), model).collect() == []
    nothing = quality.learn(df, lab.limit(0))
    assert np.allclose(sorted({round(r.score, 1) for r in quality.score(df.limit(5), nothing).collect()}), [0.5])
