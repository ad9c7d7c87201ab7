"""Web archives packed in ZIP files: writer, and a reader that fetches single records by byte range."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.llm.frames import materialize, spread
from raresift.llm.words import slices
from raresift.sources.storage import work_dir

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
ALL16, ALL32 = 0xFFFF, 0xFFFFFFFF

MEMBERS = "archive string, member string, method int, data_offset long, data_length long"


def open_store(folder: str):
    """(file system, path) of a shared folder given as URI or path."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


class ZipWriter:
    """Stored members, streamed; sizes and offsets always go to ZIP64 fields too, so no limit of 4 GB or 65,535."""

    def __init__(self, sink):
        self.sink, self.at, self.members = sink, 0, []

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.head, self.crc, self.size = name.encode(), self.at, 0, 0
        # sizes follow in a data descriptor (flag 8); names are UTF-8 (flag 0x800)
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 33, 0, ALL32, ALL32, len(self.name), len(extra)))
        self.write(self.name + extra)
        self.data_at = self.at

    def add(self, data: bytes) -> int:
        """Appends to the open member; the position inside it."""
        at = self.at - self.data_at
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self.write(data)
        return at

    def end(self) -> None:
        self.write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.head, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, head, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, head)
            self.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 33, crc, ALL32, ALL32, len(name),
                                   len(extra), 0, 0, 0, 0, ALL32) + name + extra)
        length, n = self.at - start, len(self.members)
        end64 = self.at
        self.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
        self.write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
        self.write(struct.pack("<IHHHHIIH", END, 0, 0, min(n, ALL16), min(n, ALL16), min(length, ALL32), ALL32, 0))


def directory(read, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored length) of every member. ``read(offset, length)`` reads a range;
    only the end records and the central directory are read."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    n, length, start = struct.unpack("<HII", tail[at + 10:at + 20])
    if n == ALL16 or length == ALL32 or start == ALL32:
        mark, _, end64, _ = struct.unpack("<IIQI", read(tail_at + at - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("not a ZIP file: no ZIP64 locator")
        n, length, start = struct.unpack("<QQQ", read(end64, 56)[32:56])
    raw, out, p = read(start, length), [], 0
    while p < len(raw):
        mark, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, head = struct.unpack(
            "<IHHHHHHIIIHHHHHII", raw[p:p + 46])
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = raw[p + 46:p + 46 + n_name].decode()
        extra, e = raw[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, length_ = struct.unpack("<HH", extra[e:e + 4])
            if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                values, v = extra[e + 4:e + 4 + length_], 0
                for field in ("plain", "packed", "head"):
                    if {"plain": plain, "packed": packed, "head": head}[field] == ALL32:
                        (value,) = struct.unpack("<Q", values[v:v + 8])
                        v += 8
                        plain, packed, head = (value if field == "plain" else plain, value if field == "packed" else packed,
                                               value if field == "head" else head)
            e += 4 + length_
        out.append((name, method, head, packed))
        p += 46 + n_name + n_extra + n_note
    if len(out) != n:
        raise ValueError("central directory and its count differ")
    return out


def data_offset(read, head: int) -> int:
    mark, n_name, n_extra = *struct.unpack("<I", (raw := read(head, 30))[:4]), *struct.unpack("<HH", raw[26:30])
    if mark != LOCAL:
        raise ValueError("damaged local header")
    return head + 30 + n_name + n_extra


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member holding a WARC/1.1 record; a revisit has no block."""
    body = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return headers, rest[:n]


def with_revisits(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with payload digest and, for all but the first of equal payloads of at least ``least`` bytes, that first id.

    Only digests that occur twice are joined back; the join may split a hot digest, as both sides are plain shuffles.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    first = (df.filter(F.octet_length("payload") >= least).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return (df.join(first, "payload_digest", "left")
            .withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("first_id"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """One ZIP file per task with the members archive/data.warc.gz (one gzip member per record) and
    indexes/index.cdxj (byte range of every record); the returned table lists the files.

    Files go to ``folder`` or below the shared folder of spark.checkpoint.dir, under a name of the attempt's own; the list is
    written before it is returned, so a task that runs again leaves an unlisted file but never a wrong one.

    Null html is an empty payload; equal payloads under ``least`` bytes are all responses; repeated page ids with equal payloads are
    responses all (none has a smaller id to refer to); a null page_id is written as such and refers to the smallest id
    only if that differs; an empty table gives no file; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        from pyspark import TaskContext

        writer = sink = None
        index = []
        for batch in batches:
            for part in slices(batch.set_column(batch.schema.get_field_index("payload"), "payload",
                                                batch.column("payload").cast(pa.string())), "payload"):
                columns = (part.column(x).to_pylist() for x in ("page_id", "url", "payload", "payload_digest", "refers_to"))
                for page, url, payload, digest, refers in zip(*columns):
                    if writer is None:
                        context = TaskContext.get()
                        store, base = open_store(folder)
                        store.create_dir(base, recursive=True)
                        name = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.wacz"
                        sink = store.open_output_stream(f"{base}/{name}")
                        writer = ZipWriter(sink)
                        writer.begin("archive/data.warc.gz")
                    raw = record("revisit" if refers is not None else "response", page, url, payload.encode(), digest,
                                 refers, stamp)
                    index.append((writer.add(raw), len(raw)))
        if writer is None:
            return
        writer.end()
        writer.begin("indexes/index.cdxj")
        for i in range(0, len(index), 4096):
            writer.add("".join(json.dumps({"filename": "data.warc.gz", "offset": a, "length": n}) + "\n"
                               for a, n in index[i:i + 4096]).encode())
        writer.end()
        writer.close()
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["archive"])

    rows = with_revisits(pages, least, id_col, url_col, html_col)
    return materialize(rows.mapInArrow(run, "archive string"), "warc-files")


def _reader(archive: str):
    folder, _, name = archive.rpartition("/")
    store, base = open_store(folder)
    source = store.open_input_file(f"{base}/{name}")

    def read(offset: int, length: int) -> bytes:
        source.seek(offset)
        return source.read(length)

    return read, source.size(), source


def list_members(archives: DataFrame) -> DataFrame:
    """Members of ZIP files (column archive) from their central directories alone."""
    def run(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                read, size, source = _reader(archive)
                with source:
                    rows = [(archive, name, method, data_offset(read, head), packed)
                            for name, method, head, packed in directory(read, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["archive", "member", "method", "data_offset", "data_length"])

    return archives.select("archive").mapInArrow(run, MEMBERS)


def read_archives(archives: DataFrame, split: int = 1 << 24) -> DataFrame:
    """Records of ZIP-packaged WARC archives (column archive): page_id, payload_bytes, payload_digest, record_type,
    refers_to, and for responses the payload.

    Locates the stored members archive/* and indexes/* in the directory (ZIP64 too), reads the index in ranges of whole lines, and then
    every record by its byte range; nothing is extracted. Index entries are dealt out anew in runs of about ``split``
    archive bytes, so one large archive is read by many tasks. A missing index is an error; an empty table gives no row.
    """
    def index(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                read, size, source = _reader(archive)
                with source:
                    members = {n: (m, h, p) for n, m, h, p in directory(read, size)}
                    names = [n for n in members if n.startswith("indexes/")]
                    if not names:
                        raise ValueError(f"{archive} has no index")
                    starts = {n: data_offset(read, members[n][1]) for n in members if n.startswith("archive/")}
                    for name in names:
                        method, head, packed = members[name]
                        if method != 0:
                            raise ValueError(f"{archive}: {name} is not stored")
                        at, left, rest = data_offset(read, head), packed, b""
                        run_at, run_end, lengths, rows = None, None, [], []
                        while left or rest:
                            got = read(at, min(left, 1 << 20))
                            at, left = at + len(got), left - len(got)
                            *lines, rest = (rest + got).split(b"\n")
                            if not left and rest:
                                lines, rest = [*lines, rest], b""
                            for line in filter(None, lines):
                                x = json.loads(line)
                                a = starts[f"archive/{x['filename']}"] + x["offset"]
                                if lengths and (a != run_end or a - run_at >= split):
                                    rows.append((archive, run_at, lengths))
                                    lengths = []
                                run_at = a if not lengths else run_at
                                lengths.append(x["length"])
                                run_end = a + x["length"]
                        if lengths:
                            rows.append((archive, run_at, lengths))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[i] for r in rows], k)
                             for i, k in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))],
                            names=["archive", "at", "lengths"])

    def records(batches):
        for batch in batches:
            for archive, at, lengths in zip(*(batch.column(x).to_pylist() for x in ("archive", "at", "lengths"))):
                read, _, source = _reader(archive)
                rows, size = [], 0
                with source:
                    for length in lengths:
                        rows.append(_row(*parse_record(read(at, length))))
                        at += length
                        size += rows[-1][1]
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    runs = archives.select("archive").mapInArrow(index, "archive string, at long, lengths array<long>")
    # a fixed number of tasks, which Spark does not merge by size: a row is small but stands for ``split`` bytes of archive
    return runs.repartition(spread(runs), F.col("archive"), F.col("at")).mapInArrow(records, schema)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    def number(name):
        value = headers.get(name, "").rpartition(":")[2].rstrip(">")
        return int(value) if value.lstrip("-").isdigit() else None

    kind = headers["warc-type"]
    digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-bytes"])
    if kind == "response":
        if hashlib.sha256(block).hexdigest() != digest or len(block) != size:
            raise ValueError(f"payload of record {headers['warc-record-id']} is damaged")
    return (number("warc-record-id"), size, digest, kind, number("warc-refers-to"),
            json.loads(f'"{headers["warc-target-uri"]}"'), block if kind == "response" else None)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
