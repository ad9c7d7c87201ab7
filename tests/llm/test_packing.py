import itertools
import zlib

import numpy as np
import pytest

from raresift.llm import packing
from raresift.llm.queries import tokenizer_file


def best_by_trial(position, penalty, limit):
    """Cheapest cost over all choices of cuts."""
    n, best = len(position), float("inf")
    for some in itertools.product([0, 1], repeat=n - 2):
        cuts = [0, *[i + 1 for i, x in enumerate(some) if x], n - 1]
        cost = 0
        for a, b in itertools.pairwise(cuts):
            length = position[b] - position[a]
            if length > limit:
                break
            free = length & (length - 1) == 0 and length >= 64
            cost += (0 if free else limit - length) + penalty[b]
        else:
            best = min(best, cost)
    return best


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        steps = rng.integers(1, 128, rng.integers(1, 10))
        position = np.concatenate([[0], np.cumsum(steps)])
        penalty = rng.choice([0.0, 4.0, 12.0], len(position))
        cuts = packing.choose_cuts(position, penalty, 128)
        got, at = 0, 0
        for j in cuts:
            length = position[j] - at
            assert 0 < length <= 128
            got += (0 if length & (length - 1) == 0 and length >= 64 else 128 - length) + penalty[j]
            at = position[j]
        assert at == position[-1]
        assert got == pytest.approx(best_by_trial(position.tolist(), penalty.tolist(), 128))


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [None, "", " ", "a", "<|endoftext|> and <|endoftext|>", "<|endoftext", "\x00�   　x", "é" * 3000, "no stops " * 2000,
       "Ünïcode ​ 🙂🙃 12345 it's we'LL\r\n\r\n  tail  ", "x" * 5000, "!?" * 700]
LONG = [" " * 3000000, "\t" * 3000000, "\n" * 3000000, "a" + " " * 1200000 + "b"]


def check_pieces(rows, texts, limit):
    ids = reference_ids(texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
    return [sum(p.length for p in x) for x in by_sequence.values()]


@pytest.mark.parametrize("limit,block", [(1024, 1 << 18), (64, 500)])
def test_pieces_are_the_documents(spark, limit, block):
    texts = ODD * 4
    df = spark.createDataFrame([(i, x, "other", 1) for i, x in enumerate(texts)], "doc_id long, text string, start string, offset int")
    rows = packing.pack(df.repartition(3), tokenizer_file(), limit=limit, block=block).collect()
    check_pieces(rows, texts, limit)


def test_long_white_space(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    check_pieces(packing.pack(df, tokenizer_file()).collect(), LONG, 1024)


def test_whole_table_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    df = spark.createDataFrame([(i, d.text) for i, d in enumerate(docs)], "doc_id long, text string").coalesce(1)
    lengths = check_pieces(packing.pack(df, tokenizer_file()).collect(), [d.text for d in docs], 1024)
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)
    assert padding < 0.01 * sum(lengths)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, tokenizer_file()).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, tokenizer_file()).collect()
    assert [r.doc_id for r in rows] == [None, None] and len({r.ids_crc32 for r in rows}) == 1
