import random

import numpy as np
import pytest

from raresift.llm import decontam

DOC, ITEM = "doc_id long, text string, item_id string, score int", "item_id long, text string, doc_id string"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)
    return decontam.leaks(d, b, **more).collect()


def data(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(sentence(rng.randrange(5, 20)) for _ in range(rng.randrange(1, 4)))) for i in range(60)]
    docs = []
    for i in range(250):
        t = " ".join(sentence(rng.randrange(3, 25)) for _ in range(rng.randrange(0, 25)))
        if i % 4 == 0:
            at = rng.randrange(len(t) + 1)
            at = t.rfind(" ", 0, at) + 1
            t = t[:at] + items[rng.randrange(60)][1] + " " + t[at:]
        docs.append((i, t))
    return docs, items


def brute(docs, items, k=5, least=0.8):
    """All (doc, item) with enough shingles of the item anywhere in the document."""
    import re

    cut = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for i, t in items:
        w = cut(t)
        n = min(k, len(w))
        for d, x in docs:
            if len(grams(w, n) & grams(cut(x or ""), n)) >= least * len(grams(w, n)):
                out.add((d, i))
    return out


def test_finds_every_planted_item_and_nothing_else(spark):
    docs, items = data()
    got = {(r.doc_id, r.item_id) for r in run(spark, docs, items)}
    assert got == brute(docs, items) and len(got) >= 60


def test_shards_give_the_same(spark):
    docs, items = data(1)
    one = sorted(map(tuple, run(spark, docs, items)))
    assert one and sorted(map(tuple, run(spark, docs, items, shard_words=300))) == [
        pytest.approx(r) for r in one]


def test_search_is_exact():
    """Block-max bounds lose nothing and scores are the sums of impacts."""
    rng = np.random.default_rng(0)
    docs, items = data(2)
    words = decontam.Words("alnum")
    tokens = decontam._hashed(words, [t for _, t in items])
    df: dict[int, int] = {}
    for t in tokens:
        for x in np.unique(t).view(np.int64).tolist():
            df[x] = df.get(x, 0) + 1
    index = decontam.build(items, df, len(items), np.mean([len(t) for t in tokens]), 60, 5)
    n = len(index.terms)
    passages = [np.unique(rng.integers(0, n, rng.integers(1, 200))) for _ in range(80)] + [np.searchsorted(index.terms, np.unique(t)) for t in tokens]
    passage = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    for alpha in (0.2, 0.5, 0.9, 1.0):
        got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in decontam.search(index, passage, np.concatenate(passages), alpha)))}
        want = {}
        for p, terms in enumerate(passages):
            score = np.zeros(len(index.item_ids))
            for t in terms:
                a, b = index.at[t], index.at[t + 1]
                score[index.posting_item[a:b]] += index.posting_impact[a:b]
            want |= {(p, i): score[i] for i in np.flatnonzero(score >= alpha - 1e-9).tolist()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_question_and_answer(spark):
    assert decontam.parts("What is it? A cow.") == ("What is it?", "A cow.")
    assert decontam.parts("First one. Second two.") == ("First one.", " Second two.")
    assert decontam.parts("only one") == ("only one", "only one")
    question, answer = "what colour has the old barn near the small river in spring after the rain has gone away again?", "Green and yellow."
    items = [(1, f"{question} {answer}")]
    docs = [(1, f"text {question} {answer} more"), (2, f"text {question} Nobody knows."), (3, f"{answer} text"), (4, f"{question} {answer}".upper() + "!")]
    assert {r.doc_id for r in run(spark, docs, items)} == {1, 4}


def test_edges(spark):
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, ""), (3, None), (None, "delta epsilon zeta eta theta"), (4, "solo"),
             (5, " ".join(f"v{i}" for i in range(40)))]
    docs = [(1, None), (2, ""), (3, "x alpha  Beta, GAMMA y"), (3, "x alpha  Beta, GAMMA y"), (None, "alpha beta gamma"), (4, "alpha gamma beta"),
            (5, "delta epsilon zeta eta theta"), (6, "pad " * 50_000 + items[-1][1] + " pad" * 50_000), (7, "solo")]
    got = sorted((r.doc_id or -1, r.item_id) for r in run(spark, docs, items))
    assert got == [(-1, 1), (3, 1), (3, 1), (6, 5), (7, 4)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)
    kept = decontam.without_leaks(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert decontam.without_leaks(d, b.limit(0)).count() == len(docs)
