"""Token-id files: ids packed in the vocabulary's fewest bits, with block offsets for random access.

A file is: blocks of packed ids | document ids (int64) | null flags of those (uint8) | first id of every document and the end (int64) |
byte offset of every block and the end (int64) | footer. Within a block, 64 ids fill exactly ``bits`` little-endian 64-bit words, id k from bit
k * bits upwards, so any run of 64 ids begins at a whole word and is unpacked by numpy without looking at what precedes it.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raresift.llm.frames import arrow_rows, materialize, spread
from raresift.llm.tokens import blocks, shared_encoder
from raresift.llm.warc import open_store
from raresift.sources.storage import work_dir

MAGIC = b"RSIDS001"
FOOTER = "<8sIIQQQQ"  # magic, bits, ids of a block, documents, ids, blocks, byte where the tables begin
BLOCK = 1 << 16
FILE_IDS = 1 << 27  # a file is closed after so many ids
FILE_DOCS = 1 << 20  # or documents, as their table is held in memory

FILES = "part long, piece long, path string, n_docs long, n_ids long, first_doc long, last_doc long"


def bits_needed(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``; one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, filled up to a whole 64-bit word. Bits 8, 16 and 32 are the plain integers."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} has more than {bits} bits")
    size = -(-len(ids) * bits // 64) * 8
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes().ljust(size, b"\0")
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[:len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.reshape(groups, 64).T)
    words = np.zeros((bits, groups), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()[:size]


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data that begins at a run of 64."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    groups = -(-n // 64)
    words = np.frombuffer(data.ljust(groups * bits * 8, b"\0"), "<u8", groups * bits)
    words = np.ascontiguousarray(words.reshape(groups, bits).T)
    mask = np.uint64((1 << bits) - 1)
    lanes = np.empty((64, groups), np.uint32)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        x = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        lanes[k] = x & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)[:n]


class IdWriter:
    """Streams documents to one file; memory is a block and the document table."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        if block % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.sink, self.bits, self.block = sink, bits, block
        self.waiting, self.held, self.at, self.ids = [], 0, 0, 0
        self.docs: list[int | None] = []
        self.starts, self.offsets = [0], [0]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, n: int) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, n, self.block):
            data = pack_bits(stream[i:min(i + self.block, n)], self.bits)
            self.sink.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [stream[n:].copy()], self.held - n

    def close(self) -> None:
        self._flush(self.held)
        for table, kind in (([d or 0 for d in self.docs], "<i8"), ([d is None for d in self.docs], "u1"), (self.starts, "<i8"), (self.offsets, "<i8")):
            self.sink.write(np.array(table, kind).tobytes())
        self.sink.write(struct.pack(FOOTER, MAGIC, self.bits, self.block, len(self.docs), self.ids, len(self.offsets) - 1, self.at))
        self.sink.close()


class IdFile:
    """Reads a file by byte ranges: its tables once, then any run of ids."""

    def __init__(self, path: str):
        folder, _, name = path.rpartition("/")
        store, base = open_store(folder)
        self.source = store.open_input_file(f"{base}/{name}")
        size, foot = self.source.size(), struct.calcsize(FOOTER)
        if size < foot:
            raise ValueError(f"{path} is no whole file of token ids")
        magic, self.bits, self.block, docs, self.n_ids, blocks, at = struct.unpack(FOOTER, self._read(size - foot, foot))
        if magic != MAGIC or at + 9 * docs + 8 * (docs + 1) + 8 * (blocks + 1) + foot != size:
            raise ValueError(f"{path} is no whole file of token ids")
        tables = self._read(at, size - foot - at)
        self.docs = np.frombuffer(tables, "<i8", docs)
        self.null = np.frombuffer(tables, "u1", docs, 8 * docs).astype(bool)
        self.starts = np.frombuffer(tables[9 * docs:], "<i8", docs + 1)
        self.offsets = np.frombuffer(tables[9 * docs + 8 * (docs + 1):], "<i8", blocks + 1)

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.source.close()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the file of token ids ends early")
        return data

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (b not included): the bytes of the runs of 64 that hold them are read, of whole blocks between them all."""
        out = []
        while a < b:
            i = a // self.block
            if a % self.block == 0 and b - a >= self.block:  # whole blocks in one request
                j = b // self.block
                data = self._read(int(self.offsets[i]), int(self.offsets[j] - self.offsets[i]))
                for x in range(i, j):
                    out.append(unpack_bits(data[self.offsets[x] - self.offsets[i]:self.offsets[x + 1] - self.offsets[i]], self.bits, self.block))
                a = j * self.block
                continue
            end = min(b, (i + 1) * self.block, self.n_ids)
            first = a - a % 64
            skip = (first - i * self.block) // 64 * self.bits * 8
            n = -(-(end - first) * self.bits // 64) * 8
            out.append(unpack_bits(self._read(int(self.offsets[i]) + skip, n), self.bits, end - first)[a - first:])
            a = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_ids(df: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
              block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every text with the ``tokenizers`` file, appends ``end_id`` and writes files of packed ids in ascending order of the id.

    Returns the written list of files: (part, piece, path, n_docs, n_ids, first_doc, last_doc), ordered by (part, piece). One shuffle of ids
    and texts by ranges of (id, hash of the text, row), so that a repeated id, or a row repeated many times, is dealt to several tasks; a task
    sorts its range (spilling) and streams it to files of at most ``file_ids`` ids. Files carry names of the attempt's own below ``folder`` or the shared
    folder of spark.checkpoint.dir, and only those of finished tasks are in the list, so a task that runs again leaves an unlisted file but never a
    wrong one. The tokenizer's file is read on the driver (some MB) and broadcast.

    Null and empty texts are ``end_id`` alone; null ids come first; rows of one id are ordered by a hash of the text, equal rows stay; texts
    of any length; an empty table gives an empty list; other columns are ignored.
    """
    spark = df.sparkSession
    folder = folder or f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        encode = shared_encoder(spec.value)
        bits = bits_needed(max(encode.size, end_id + 1))
        part, piece = TaskContext.get().partitionId(), 0
        writer = path = None
        store, base = open_store(folder)

        def closed():
            writer.close()
            known = [d for d in writer.docs if d is not None]  # ascending
            row = (part, piece, path, len(writer.docs), writer.ids, known[0] if known else None, known[-1] if known else None)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if i == 2 else pa.int64()) for i, x in enumerate(row)],
                                              names=["part", "piece", "path", "n_docs", "n_ids", "first_doc", "last_doc"])

        for some in blocks(batches, "text"):
            at, ids = encode(some.column("text"))
            for i, doc in enumerate(some.column("doc_id").to_pylist()):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    path = f"{folder}/part-{part:06d}-{piece:04d}-{uuid.uuid4().hex}.ids"
                    writer = IdWriter(store.open_output_stream(f"{base}/{path.rpartition('/')[2]}"), bits, block)
                writer.add(doc, np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)))
                if writer.ids >= file_ids or len(writer.docs) >= FILE_DOCS:
                    yield closed()
                    writer, piece = None, piece + 1
        if writer is not None:
            yield closed()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keys.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    with arrow_rows(spark, 512):
        return materialize(dealt.mapInArrow(run, FILES), "id-files")


def _with_base(files: DataFrame) -> DataFrame:
    """The list of files with ``base``, the ids of all files before. A row a file: a window over all of them stays small."""
    order = Window.orderBy("part", "piece")
    return files.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))


def read_documents(files: DataFrame, read_ids: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a list of files, from the files: ids of all documents before it, number of ids,
    unsigned crc32 of the ids as little-endian 32-bit integers.

    Files are dealt to tasks one by one; a task reads a file in runs of about ``read_ids`` ids and never holds more, nor a long document whole.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with IdFile(path) as f:
                    sums = np.zeros(len(f.docs), np.int64)
                    doc = 0
                    for a in range(0, f.n_ids, read_ids):
                        b = min(a + read_ids, f.n_ids)
                        raw = memoryview(f.ids(a, b).astype("<u4")).cast("B")
                        while doc < len(sums):
                            x, y = max(int(f.starts[doc]), a), min(int(f.starts[doc + 1]), b)
                            sums[doc] = zlib.crc32(raw[4 * (x - a):4 * (y - a)], int(sums[doc]))
                            if f.starts[doc + 1] > b:
                                break  # the document goes on in the next run
                            doc += 1
                            if y == b:
                                break
                    for i in range(0, len(sums), 1 << 16):
                        j = min(i + (1 << 16), len(sums))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f.docs[i:j], mask=f.null[i:j]), pa.array(base + f.starts[i:j]), pa.array(np.diff(f.starts[i:j + 1])), pa.array(sums[i:j])],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a fixed number of tasks, which Spark does not merge by size: a row is small but stands for a file
    listed = _with_base(files).select("path", "base")
    return listed.repartition(spread(files), "path").mapInArrow(run, schema)


def fetch_documents(files: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents by random access: only files whose range of ids holds one are opened, and only the
    blocks with its ids are read.

    Repeated wanted ids count once; an id that several documents have gives each of them; unknown and null ids give nothing.
    """
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct()
    near = ids.join(files.select("path", "first_doc", "last_doc"), F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))

    def run(batches):
        for batch in batches:
            rows = sorted(zip(batch.column("path").to_pylist(), batch.column("doc_id").to_pylist()))
            held, f = None, None
            for path, doc in rows:
                if path != held:
                    if f is not None:
                        f.source.close()
                    f, held = IdFile(path), path
                    first = int(f.null.sum())
                i = first + int(np.searchsorted(f.docs[first:], doc))
                while i < len(f.docs) and f.docs[i] == doc:
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([f.document(i).astype(np.int64)], pa.list_(pa.int64()))],
                                                     names=["doc_id", "ids"])
                    i += 1
            if f is not None:
                f.source.close()

    return near.repartition(spread(files), "path").sortWithinPartitions("path", "doc_id").select("path", "doc_id") \
        .mapInArrow(run, "doc_id long, ids array<long>")
