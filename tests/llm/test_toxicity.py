import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from raresift.llm import toxicity
from raresift.llm.automaton import FuzzyLexicon, tolerance

TERMS = ["idiot", "scum", "worthless", "moron", "vequ*", "disgusting", "abab", "idiotic"]


def distance(a, b):
    """Edits with swaps of neighbours, no character edited twice (optimal string alignment)."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def by_trial(word):
    found = [(0 if t.endswith("*") else int(distance(word, t)), i) for i, t in enumerate(TERMS)
             if (word.startswith(t[:-1]) if t.endswith("*") else distance(word, t) <= tolerance(t))]
    return min(found) if found else None


def test_automaton_is_the_edit_distance():
    rng = random.Random(1)
    words = {"", "x", *[t.strip("*") for t in TERMS]}
    for t in TERMS:
        t = t.strip("*") + ("ement" if t.endswith("*") else "")
        for _ in range(400):
            w = list(t)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                kind = rng.randrange(4)
                if kind == 0:
                    w.insert(i, rng.choice("abcdeiostz1é"))
                elif i < len(w) and kind == 1:
                    del w[i]
                elif i < len(w) and kind == 2:
                    w[i] = rng.choice("abcdeiostz1é")
                elif i + 1 < len(w):
                    w[i], w[i + 1] = w[i + 1], w[i]
            words.add("".join(w))
    words = sorted(words)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    where, term, edits = FuzzyLexicon(TERMS).find(chars, end - [len(w) for w in words], end)
    got = {words[w]: (int(e), int(t)) for w, t, e in zip(where, term, edits)}
    assert got == {w: by_trial(w) for w in words if by_trial(w) is not None}
    where, term, _ = FuzzyLexicon(TERMS, frozenset(["idiot"])).find(chars, end - [len(w) for w in words], end)
    assert {words[w] for w, t in zip(where, term) if TERMS[t] == "idiot"} == {"idiot"}


def test_words_and_quotes():
    scan = toxicity.Scanner(FuzzyLexicon(TERMS))
    texts = ['He said "idiot" there', "you idiot!!", "**IDIOT**, idi0t; ıdiot", "«scum» and „moron”", 'an open " idiot', 'idiot "a" b\nx "idiot', "", "...", "vequement x"]
    count, hits = scan.hits(texts)
    assert count.tolist() == [4, 2, 3, 3, 3, 5, 0, 0, 2]
    factors = {}
    for r, w, t, e, f in hits:
        factors.setdefault(r, []).append((w, TERMS[t], e, round(f, 3)))
    q, s, a = toxicity.QUOTED, toxicity.REPORTED, toxicity.ADDRESSED
    assert factors[0] == [("idiot", "idiot", 0, round(q * s, 3))]
    assert factors[1] == [("idiot", "idiot", 0, a)]
    assert [x[:3] for x in factors[2]] == [("idiot", "idiot", 0), ("idi0t", "idiot", 1), ("ıdiot", "idiot", 1)]
    assert [x[3] for x in factors[3]] == [q, q]
    assert factors[4][0][3] == 1 and [x[3] for x in factors[5]] == [1, 1]
    assert factors[8] == [("vequement", "vequ*", 0, 1.0)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(seed=0, n=700):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "th er on an re he in ed nd ha".split() for b in "at en es of or nt ea ti to it".split()]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 150))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(3, 8)):
                bad = rng.choice(["idiot", "worthless", "vequ" + rng.choice(vocabulary)])
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words), str(int(toxic)), 0.5))
        labels.append((i, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, label string, score double"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    return df, lab, toxicity.learn(df, lab)


def test_learns_terms_and_scores_unseen_documents(spark, fitted):
    df, lab, model = fitted
    assert set(model.terms) == {"idiot", "worthless", "vequ*"}
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    assert all((got[i] >= 0.5) == bool(truth[i]) for i in got)
    assert sum(held_out(i) for i in got) > 100
    more = [(1, "you idi0t, you wortless " + "thing " * 10), (2, 'they wrote "idiot" in a letter ' + "than " * 40), (3, "plain text"), (4, ""), (5, None),
            (5, None), (None, "idiot"), (6, "then " * 200_000)]
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(more, "doc_id long, text string"), model).collect()}
    assert s[1] >= 0.5 and max(s[2], s[3], s[4], s[5], s[6]) < 0.5 and 0 <= s[None] <= 1


def test_filter_keeps_columns(spark, fitted):
    df, lab, model = fitted
    kept = toxicity.score(df, model, keep_below=0.5)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, t in corpus()[1] if not t}


def test_held_out_labels_are_not_learned(spark, fitted):
    df, lab, model = fitted
    turned = lab.rdd.map(lambda r: (r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic)).toDF("doc_id long, toxic int")
    assert toxicity.learn(df, turned) == model


def test_no_labels_and_empty(spark, fitted):
    df, lab, model = fitted
    nothing = toxicity.learn(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df.limit(5), nothing).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id long, toxic int")
    assert toxicity.learn(df, nulls).terms == []
    assert toxicity.score(df.limit(0), model).collect() == []
    mild = toxicity.learn(df, lab.filter("doc_id < 40"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, mild).collect())


def test_near_copies_count_once():
    groups = toxicity._groups([(1, [1, 2]), (2, [9, 2]), (3, [9, 8]), (4, [2, 9]), (5, []), (6, [])])
    assert groups[1] == groups[2] == groups[3] and len({groups[i] for i in (1, 4, 5, 6)}) == 4


def test_stems_are_chosen_over_their_words():
    rows = [("vequ*", 300), ("vequat", 80), ("loser", 200), ("lose*", 200), ("vequ", 5), ("clown", 9)]
    assert toxicity._choose(rows, 10) == ["vequ*", "loser", "clown"]
    assert toxicity._choose(rows, 1) == ["vequ*"]


def test_trim_table():
    space, trim = toxicity._tables()
    chars, row, start, end, offsets, low = toxicity.split_chars(["a-b 'c' -- $d", "É"], space, trim)
    assert ["".join(map(chr, chars[a:b])) for a, b in zip(start, end)] == ["a-b", "c", "d", "é"]
    assert row.tolist() == [0, 0, 0, 1] and pa.array(low).to_pylist() == ["a-b 'c' -- $d", "é"]


def test_without_a_term_every_document_stays(spark, fitted, monkeypatch):
    import corpus_pipeline

    df, lab, _ = fitted
    keys = [r.doc_id for r in lab.collect()]
    for rows in ([], [(1, None)], [(i, 1) for i in keys if held_out(i)], [(10**9 + i, 1) for i in range(9)],
                 [(i, 1) for i in keys if not held_out(i)][:5]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: labels)
        assert toxicity.learn(df, labels).terms == []
        kept = corpus_pipeline.drop_toxic(spark, df, "unused")
        assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == sorted(keys)


def test_a_stem_keeps_the_misspellings_of_its_words(spark):
    rng = random.Random(3)
    plain = [a + b for a in "th er on an re he in ed nd ha".split() for b in "at en es of or nt ea ti to it".split()]
    docs = []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(60)]
        for at in (10, 20, 30, 40) if i % 4 == 0 else ():
            words.insert(at, ["idiot", "idiots", "idiotic"][i // 4 % 3])
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    assert {"idio*", "idiot", "idiots", "idiotic"} == set(model.terms)
    unseen = ["idiot", "idiotism", "idoit", "iidiot", "1diot", "idoits", "diotic"]
    rows = [(i, " ".join([w] * 4 + plain[:60])) for i, w in enumerate(unseen)] + [(99, " ".join(plain))]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got.pop(99) < 0.5 and min(got.values()) >= 0.5


def test_every_term_that_passes_is_taken(spark):
    """Over 200 terms, each in its own documents; the last ones count as the first do."""
    rng = random.Random(5)
    plain = [a + b for a in "th er on an re he in ed nd ha".split() for b in "at en es of or nt ea ti to it".split()]
    bad = ["%s%s" % (a, b) for a in "zu wy qo xi vu ky jo gy bu mi lo pe fa du".split() for b in "zax wib qek xoc vum pyl jun gaf byr mox lep piz fod dah sil kur".split()][:216]
    docs = [(i, " ".join(rng.sample(plain, 25) + (rng.sample(bad, 50) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert set(bad) <= set(model.terms) | {t for t in bad if any(t.startswith(m[:-1]) for m in model.terms if m.endswith("*"))}
    assert sum(not m.endswith("*") for m in model.terms) > 200


def test_several_tables_are_one_lexicon(monkeypatch):
    from raresift.llm import automaton

    words = sorted({w for t in TERMS for w in (t.strip("*"), t.strip("*")[1:], t[:2] + "x" + t[2:].strip("*"), t.strip("*") + "s")} | {"", "x"})
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    one = [x.tolist() for x in FuzzyLexicon(TERMS).find(chars, start, end)]
    for size in (1, 3, 200):
        monkeypatch.setattr(automaton, "TABLE", size)
        assert [x.tolist() for x in automaton.Lexicon(TERMS).find(chars, start, end)] == one
    assert all(len(x) == 0 for x in automaton.Lexicon([]).find(chars, start, end))
