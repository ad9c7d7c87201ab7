import zlib

import numpy as np
import pyarrow as pa
import pytest

from raresift.llm import idfile
from raresift.llm.queries import QUERIES, tokenizer_file
from raresift.llm.tokens import Encoder

ODD = [None, "", " ", "a", "<|endoftext|> and <|endoftext|>", "<|endoftext", "\x00�   　x", "é" * 3000, "no stops " * 2000,
       "Ünïcode ​ \U0001f642\U0001f643 12345 it's we'LL\r\n\r\n  tail  ", "x" * 5000, "!?" * 700, " " * 1500000, "\t" * 300000, "a\x1c b"]


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.mark.parametrize("bits", [*range(1, 33)])
def test_packing_is_reversible(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = idfile.pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 64) * 8
        assert np.array_equal(idfile.unpack_bits(data, bits, n), ids)
        # the layout is that of one long little-endian number
        number = sum(int(x) << (bits * k) for k, x in enumerate(ids))
        assert int.from_bytes(data, "little") == number
    with pytest.raises(ValueError, match="bits"):
        if bits < 32:
            idfile.pack_bits(np.array([1 << bits], np.uint64), bits)
        else:
            raise ValueError("bits")


def test_fewest_bits():
    assert [idfile.bits_needed(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_encoder_is_the_library():
    with open(tokenizer_file(), encoding="utf-8") as f:
        encode = Encoder(f.read())
    rng = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\t", " ", "　", " ", "\x85", "\x1c", "a", "b", "é", "日", "。", "!", "'s", "'", "1", "<|endoftext|>", "<|endo"]
    texts = ODD + ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(20000)]
    at, ids = encode(pa.array(texts))
    t = plain()
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids, text
    assert encode(pa.array([], pa.string()))[0].tolist() == [0]


def test_random_access(tmp_path):
    rng = np.random.default_rng(5)
    for bits in (7, 16, 17):
        path = str(tmp_path / f"{bits}.ids")
        with open(path, "wb") as sink:
            writer = idfile.IdWriter(sink, bits, block=128)
            docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (5, 0, 700, 1, 128, 64, 300)]
            for i, d in enumerate(docs):
                writer.add(i if i else None, d)
            writer.close()
        stream = np.concatenate(docs)
        with idfile.IdFile(path) as f:
            assert f.null.tolist() == [True] + [False] * 6
            for i, d in enumerate(docs):
                assert np.array_equal(f.document(i), d)
            for _ in range(300):
                a, b = sorted(rng.integers(0, len(stream) + 1, 2).tolist())
                assert np.array_equal(f.ids(a, b), stream[a:b])
        with open(path, "r+b") as sink:
            sink.truncate(100)
        with pytest.raises(ValueError, match="whole file"):
            idfile.IdFile(path)


def expected(rows):
    """Documents in order with their first id, by the library alone."""
    t, at, out = plain(), 0, []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_of_odd_texts(spark):
    rows = [(i, x, "other", 1) for i, x in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_ids int").repartition(3)
    for file_ids in (1 << 27, 3000):
        files = idfile.write_ids(df, tokenizer_file(), block=256, file_ids=file_ids)
        got = sorted(tuple(r) for r in idfile.read_documents(files, read_ids=500).collect())
        assert got == expected([r[:2] for r in rows])
    wanted = spark.createDataFrame([(3,), (9,), (9,), (None,), (77,)], "doc_id long")
    found = {r.doc_id: r.ids for r in idfile.fetch_documents(files, wanted).collect()}
    t = plain()
    assert found == {i: t.encode(ODD[i], add_special_tokens=False).ids + [0] for i in (3, 9)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "b"), (None, None), *[(4, f"text {i % 3}") for i in range(50)], (2, "a"), (9, "z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in idfile.read_documents(idfile.write_ids(df, tokenizer_file())).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 2, *[4] * 50, 9]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    sums = {x[1:] for x in [(0, *r[2:]) for r in expected(rows)]}
    assert {r[2:] for r in got} == sums
    found = idfile.fetch_documents(idfile.write_ids(df, tokenizer_file()), spark.createDataFrame([(4,)], "doc_id long"))
    assert found.count() == 50


def test_empty_table(spark):
    files = idfile.write_ids(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file())
    assert files.count() == 0 and idfile.read_documents(files).collect() == []


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op11_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(docs)
