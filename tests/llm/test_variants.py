import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import check as sql
from raresift.llm import variants
from raresift.llm.queries import ORACLES, QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def random_words(rng, n, letters, low, high):
    words = {"".join(rng.choice(list(letters), rng.integers(low, high))) for _ in range(n)}
    for w in list(words)[:n // 3]:  # edited copies
        i = int(rng.integers(0, len(w) + 1))
        words |= {w[:i] + w[i + 1:], w[:i] + letters[0] + w[i:], w[:i] + letters[-1] + w[i + 1:]}
    return sorted(w for w in words if w)


def dictionary(words, often):
    counts = {}
    for w in words:
        marked = (variants.BEGIN, *map(ord, w), variants.END)
        for q in range(variants.SHORT, variants.LONG):
            for i in range(len(marked) - q + 1):
                g = marked[i:i + q]
                counts[g] = counts.get(g, 0) + 1
    return variants.Grams([g for g, n in counts.items() if n > often])


@pytest.mark.parametrize("often", [0, 3, 20, 10**9])
def test_bounds_hold_for_every_edit(often):
    """No single edit takes more grams from a word than its bound says, and the others keep their place or move by one."""
    rng = np.random.default_rng(often % 97)
    words = random_words(rng, 150, "abc", 1, 9)
    grams = dictionary(words, often)

    def tokens(w):
        (_, m), = variants.matrices([w])
        own, code, most = grams.decompose(m)
        return {(int(code[0, p]), int(p)) for p in np.flatnonzero(own[0])}, int(most[0])

    known = {w: tokens(w) for w in words}
    for w in words[:60]:
        had, most = known[w]
        for i in range(len(w) + 1):
            edits = [w[:i] + c + w[i:] for c in "abcz"] + ([w[:i] + w[i + 1:]] + [w[:i] + c + w[i + 1:] for c in "abcz"] if i < len(w) else [])
            for other in edits:
                if other and other != w:
                    has, _ = tokens(other)
                    on = len(other) - len(w)
                    kept = sum((h, p) in has or (h, p + on) in has for h, p in had)
                    assert kept >= len(had) - most, (w, other)


@pytest.mark.parametrize("often,hot,letters,low,high", [(5, 2, "ab", 3, 9), (30, 4, "abcd", 4, 9), (300, 128, "abcdé日", 1, 7), (0, 10**6, "abc", 5, 8)])
def test_near_words_are_all_pairs(spark, often, hot, letters, low, high):
    rng = np.random.default_rng(often + hot)
    words = random_words(rng, 400, letters, low, high)
    df = spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "word string").repartition(3)
    got = sorted(tuple(r) for r in variants.near_words(df, often, hot).collect())
    assert got == sorted((a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b))


def test_counting(spark):
    texts = [(1, "Hello hello HELLO wörld Wörld wörld ÀÉÎÕÜ"), (2, None), (3, ""), (None, "ÀÉÎÕÜ ÀÉÎÕÜ x1hello"), (None, None), (3, "short four " * 100), (3, "short four " * 100)]
    df = spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, word int")
    import re

    counts = {}
    for doc, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in variants.count_words(df).collect()} == want and "short" in want
    # every run loses a letter
    cut = {r.word for r in variants.count_words(df, 4, 1, drop_every=1).collect()}
    assert "hello" not in cut and all(len(w) >= 4 for w in cut)


def test_forms_and_roots(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaabb", 12), ("aabbb", 100), ("zzzzz", 9), ("aaaaaa", 5)], "word string, n long")
    named = variants.forms(words, variants.near_words(words))
    rows = {r.word: r for r in named.collect()}
    assert rows["aaaaa"].form == "aaaab" and rows["aaaaa"].n_near == 3 and rows["aaaaa"].form_n == 6  # a tie goes to the first
    assert rows["aaaab"].form == "aaabb" and rows["zzzzz"].form is None and rows["zzzzz"].n_near == 0
    assert {r.word: r.root for r in variants.roots(named).collect()} == {"aaaaa": "aabbb", "aaaab": "aabbb", "aaabb": "aabbb"}


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(empty).collect() == []
    run = "ab" * 20000
    df = spark.createDataFrame([(i, t) for i, t in enumerate([run, run, run, run + "c", run + "c", run + "c"])], "doc_id long, text string")
    rows = {r.word: r for r in variants.spelling_variants(df, drop_every=None).collect()}
    assert set(rows) == {run, run + "c"} and all(r.n == 3 and r.n_near == 1 and r.form is None for r in rows.values())


def test_query(spark, duck, sf):
    rows, error = sql.compare(spark, duck, sf, QUERIES["op12_spelling_variants"], ORACLES["op12_spelling_variants"])
    assert error is None and rows, error


def test_sql_counts_deletions(spark, sf):
    """The fixture holds words that lost a letter, so that part is compared as well."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with_loss, without = (variants.count_words(docs, least=1, drop_every=x).agg(F.sum("n")).first()[0] for x in (97, None))
    assert 0 < without - with_loss
