import random

import pytest

from raresift.llm import licenses as L

SCHEMA = "doc_id long, text string, license string, band int, words string"


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], SCHEMA)
    return L.scan(df, **more).collect()


def brute(docs, least=0.8, k=5):
    """Best share of each template's shingles in any window of its class, at every place."""
    grams = lambda w: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    out = {}
    for name, text in L.TEMPLATES.items():
        want, size = grams(L.template_words(text)), sum(L.window_class(len(L.template_words(text))))
        step = L.window_class(len(L.template_words(text)))[1]
        for d, t in docs:
            w = L.template_words(t or "")
            for at in range(0, max(len(w), 1), step):
                share = len(want & grams(w[at:at + size])) / len(want)
                if share >= least and share > out.get((d, name), (0, 0))[0]:
                    out[(d, name)] = (share, at)
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + "license notice software the of under released following licensed warranty".split() * 3
    names = sorted(L.TEMPLATES)
    docs = []
    for i in range(140):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 300)))
        if i % 2:
            words = L.TEMPLATES[names[i % len(names)]].split()
            if i % 3 == 0 and len(words) > 30:  # a changed word now and then
                words[rng.randrange(len(words))] = "changed"
            if i % 5 == 0:
                words = [x.upper() for x in words]
            t = f"{t}\n{' '.join(words)} {t[:rng.randrange(0, 200)]}"
        docs.append((i, t))
    return docs


def test_as_every_window(spark):
    docs = corpus()
    got = {(r.doc_id, r.license): (pytest.approx(r.containment), r.start_word) for r in run(spark, docs)}
    want = brute(docs)
    assert len(want) >= 60 and want == got


def test_bands_keep_their_promise():
    for text in L.TEMPLATES.values():
        n = len(L.template_words(text))
        assert L.window_class(n)[0] >= n
        assert L.collision_probability(L.least_similarity(n, 5, 0.8), 24, 1) > 0.999


def test_anchors_are_necessary():
    for name, chosen in L.anchors(L.TEMPLATES, 5, 0.8).items():
        w = L.template_words(L.TEMPLATES[name])
        grams = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}
        assert sum(1 for g in grams if not chosen & set(g)) < 0.8 * len(grams)


def test_edges(spark):
    mit = L.TEMPLATES["MIT notice"]
    long = "license " * 5000 + mit + " license" * 5000
    docs = [(1, None), (2, ""), (3, mit), (3, mit), (None, f"x {mit} y {mit}"), (4, "released under the mit"), (5, long), (6, "Released—under  the\n«MIT» License"),
            (7, "... !!!")]
    got = sorted((r.doc_id or -1, r.license, r.start_word) for r in run(spark, docs))
    assert got == [(-1, "MIT notice", 0), (3, "MIT notice", 0), (5, "MIT notice", 4999), (6, "MIT notice", 0)]
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapInArrow"))
