import gzip
import hashlib
import io
import zipfile

import pytest

from raresift.llm import warc
from raresift.llm.queries import op6_warc

BIG = "<p>é😀" + "x" * 200 + "</p>"
ROWS = [(3, "http://a/\"q\"", BIG), (1, "http://b", BIG), (2, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
        (8, "http://é", "y" * 100), (9, "u", "y" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "WARC/1.1\r\n\r\n" * 50),
        (13, "u", "z" * 3_000_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "page_id long, url string, html string, payload string, n int").repartition(3)
    archives = warc.write_archives(df)
    got = {r.page_id: r for r in warc.read_archives(archives, split=500).collect()}
    assert set(got) == {r[0] for r in ROWS}
    first = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    for page, url, html in ROWS:
        raw, r = (html or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        to = first.get(page, page)
        assert (r.record_type, r.refers_to) == (("revisit", to) if to != page else ("response", None))
        assert r.payload == (raw if to == page else None) and r.url == (url or "")


def test_archives_are_plain_zip_files(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df).first().archive.removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert [(i.filename, i.compress_type) for i in z.infolist()] == [("archive/data.warc.gz", 0), ("indexes/index.cdxj", 0)]
        plain = gzip.decompress(z.read("archive/data.warc.gz"))
    assert plain.count(b"WARC-Type: ") == len(ROWS)
    members = warc.list_members(spark.createDataFrame([(path,)], "archive string")).collect()
    with open(path, "rb") as f:
        for m in members:
            f.seek(m.data_offset)
            data = f.read(m.data_length)
            assert m.method == 0 and (gzip.decompress(data) == plain if m.member.endswith(".gz") else data.startswith(b"{"))


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_other_writers(zip64):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for name in ("archive/a.warc.gz", "indexes/é.cdxj"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(name.encode() * 3)
        z.comment = b"a comment"
    raw = sink.getvalue()
    read = lambda at, n: raw[at:at + n]
    found = warc.directory(read, len(raw))
    assert [(n, m) for n, m, _, _ in found] == [("archive/a.warc.gz", 0), ("indexes/é.cdxj", 0)]
    for name, _, head, packed in found:
        at = warc.data_offset(read, head)
        assert raw[at:at + packed] == name.encode() * 3
    with pytest.raises(ValueError):
        warc.directory(read, 10)


def test_zip64_fields_are_read():
    """The writer leaves every 32-bit size and offset full, so only the ZIP64 fields can tell."""
    sink = io.BytesIO()
    writer = warc.ZipWriter(sink)
    for i in range(70_000 // 1000):
        writer.begin(f"archive/{i}")
        writer.add(b"x" * i)
        writer.end()
    writer.close()
    raw = sink.getvalue()
    found = warc.directory(lambda at, n: raw[at:at + n], len(raw))
    assert [p for *_, p in found] == list(range(70))
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None


def test_empty_null_and_repeated(spark):
    schema = "page_id long, url string, html string"
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], schema))).collect() == []
    df = spark.createDataFrame([(None, "u", BIG), (4, "u", BIG), (4, "u", BIG), (5, "u", BIG)], schema)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got == [(-1, "response", None), (4, "response", None), (4, "response", None), (5, "revisit", 4)]


def test_query(spark, duck, sf):
    import check

    from raresift.llm.queries import ORACLES

    assert check.compare(spark, duck, sf, op6_warc, ORACLES["op6_warc"])[1] is None
