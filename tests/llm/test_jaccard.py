import random
import re

import numpy as np
import pyarrow as pa
import pytest

from raresift.llm import jaccard, words

SCHEMA = "doc_id long, text string, n_shingles string, sid int, h string"


def grams(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k=4, num=85, den=100):
    """Component of every row (by place), for rows of distinct non-null ids."""
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def run(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df, **more).collect()}


def noisy(rng, text, rate):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < rate:
            w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, groups=14, size=14, length=120, rate=0.02):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, length)))
        for _ in range(rng.randrange(1, size)):
            t = noisy(rng, base, rng.choice([0, rate, rate, 3 * rate]))
            texts.append(t + (" " + common if rng.random() < 0.4 else ""))
    texts += [common, common.upper(), "", " \t\n\x0b ", None, "one two three", "One  two\tthree", "a b c d", "a b c", "é É", "é é", "x" * 100_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"k": 5, "num": 80}), (3, {"num": 60})])
def test_as_all_pairs(spark, seed, options):
    rows = corpus(seed)
    assert run(spark, rows, **options) == brute(rows, **options)


def test_chain_of_near_copies(spark):
    """Every text links with the next only: components reach through pairs that don't link."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[5 * i:5 * i + 100])) for i in range(20)]
    got = run(spark, rows)
    assert got == brute(rows) and {c for _, c in got.values()} == {0}


def test_large_group_and_frequent_passage(spark):
    rng = random.Random(5)
    base = " ".join(f"b{i}" for i in range(150))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, noisy(rng, base, 0.006)) for i in range(150)] + [(200 + i, base) for i in range(100)]
    rows += [(400 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40 + i % 5))) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_few_entries_per_flush(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ENTRIES", 50)
    monkeypatch.setattr(jaccard, "LISTED", 3)
    rows = corpus(7)
    assert run(spark, rows) == brute(rows)


def test_null_repeated_and_empty(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "A b c D e"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect())
    assert got == [(-1, 2, None), (2, 2, 2), (3, 2, 2), (3, 2, 2), (9, 0, 9)]
    df = spark.createDataFrame([(None, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 3), (9, None, 4), (8, "a b c d e", 5)],
                               "doc_id long, text string, comp int")
    kept = sorted((r.doc_id or -1, r.text) for r in jaccard.first_of_groups(df).collect())
    assert kept == [(-1, "a b c d e"), (3, "a b c d e"), (9, None)] or kept[0][0] == -1 and len(kept) == 3


def test_first_of_groups_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (9, a), (5, b), (2, b), (5, b), (7, c), (7, c + " z"), (8, c), (7, "other words"), (7, "other words"), (7, None), (5, ""), (4, None), (None, a)]
    kept = sorted(((r.doc_id or -1, r.text or "") for r in jaccard.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    third = [x for x in kept if x[1] in (c, c + " z")]
    assert len(third) == 1 and third[0][0] == 7  # one of the near copies of the smallest id
    assert sorted(set(kept) - set(third)) == sorted({(5, a), (2, b), (7, "other words"), (7, ""), (5, ""), (4, ""), (-1, a)}) and len(kept) == 8


def test_word_hashes():
    texts = ["", "a", None, " Ab  aB\tab ", "é É", "x" * 3_000_000 + " y", "a" * 10, " ", "q w"] * 2
    w = words.Words("space")
    row, start, end, data, _ = w.split(pa.array(texts))
    h = w.hashes(start, end, data)
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    want = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))]
    assert row.tolist() == [i for i, _ in want]
    seen = {}
    for (_, x), v in zip(want, h.tolist()):
        assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)
    r, s = words.shingles(row, h, len(texts), 2)
    assert sorted(r.tolist()) == sorted(i for i, t in enumerate(texts) for _ in grams_list(fold(t or ""), 2))
    assert len(np.unique(s)) == len({g for t in texts for g in grams_list(fold(t or ""), 2)})


def grams_list(text, k):
    w = tuple(re.findall(r"[^\x20\x09-\x0D]+", text))
    return [w[i:i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] * bool(w)


def test_null_ids_stay_whether_or_not_an_id_repeats(spark):
    schema = "doc_id long, text string, lang string, sid long, __sid string"
    text = "one two three four five six"
    nulls = [(None, text, "en", 1, "a"), (None, text, "en", 1, "a"), (None, None, "de", 2, "b")]
    for more in ([], [(7, text, "en", 3, "x"), (7, text, "de", 4, "y")]):
        got = jaccard.first_of_groups(spark.createDataFrame(nulls + more, schema)).collect()
        assert sum(r.doc_id is None for r in got) == 3
        assert sum(r.doc_id == 7 for r in got) == (1 if more else 0)
    again = jaccard.first_of_groups(spark.createDataFrame([more[1], more[0], *nulls], schema).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # the same row of an id, however the table lies


def test_hot_grams_of_many_sizes(spark):
    """Sets of many sizes that share their rarest n-grams: long lists cut by size lose no link."""
    rng = np.random.default_rng(8)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(240):
        own = [f"w{i % 120}x{j}" for j in range(int(rng.integers(0, 30)))]
        rows.append((i, " ".join(shared + own)))
    got, want = run(spark, rows), brute(rows)
    assert got == want
