"""Packing of documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import small_batches
from raresift.llm.tokens import encoding
from raresift.llm.words import slices

WHITE = re.compile(r"\s{100000}")  # the pattern of the quick encoder fails on runs of white space some times as long
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    other = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str) -> tuple[list[tuple[bytes, int]], dict[str, int]]:
    """Byte strings with their ids, and the special tokens, of a byte-level BPE file of ``tokenizers``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = [(bytes(letters[c] for c in t), i) for t, i in spec["model"]["vocab"].items() if t not in special]
    return ranks, special


def encoder(ranks: list[tuple[bytes, int]], special: dict[str, int], pattern: str):
    """Encodes as the ``tokenizers`` file does: the vocabulary's order is the merge order, special strings count."""
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens=special)


def choose_cuts(position: np.ndarray, penalty: np.ndarray, limit: int) -> np.ndarray:
    """Cheapest windows over candidate cuts: indices into ``position`` of the chosen window ends.

    ``position`` ascends from 0, steps are at most ``limit``; ``penalty[j]`` is paid for a cut at j. A window of length
    n costs limit - n for padding, or nothing if n is a power of two. With best[j] the cost up to cut j,

        best[j] = penalty[j] + min(min over i in window of (best[i] + limit - (p[j] - p[i])), min over powers of best[i])

    The first minimum ranges over a sliding window of (best[i] + p[i]) and is kept in a monotone queue; the second
    looks up at most log2(limit) + 1 positions. Linear in the number of cuts.
    """
    n = len(position)
    p, pen = position.tolist(), penalty.tolist()
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << b for b in range(6, limit.bit_length()) if 1 << b <= limit]
    best, back = [0.0] * n, [0] * n
    key = [0.0] * n  # best[i] + p[i]
    queue, head = [0], 0
    for j in range(1, n):
        at = p[j]
        while p[queue[head]] < at - limit:
            head += 1
        i = queue[head]
        cost = key[i] + limit - at
        for w in powers:
            k = index.get(at - w)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best[j], back[j] = cost, i
        value = cost + at
        key[j] = value
        while len(queue) > head and key[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, step: int, inside: float,
               sentence: float) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a token stream and what a cut there costs: 0 at a document's end, ``sentence`` after a
    sentence, ``inside`` at every ``step`` tokens of a longer sentence (so that any text can be cut)."""
    ends = np.flatnonzero(ends_sentence[ids]) + 1
    ends = np.unique(np.concatenate([[0], ends, doc_ends]))
    gap = np.diff(ends)
    extra = (gap - 1) // step
    inner = np.repeat(ends[:-1], extra)
    rank = np.arange(len(inner)) - np.repeat(np.cumsum(extra) - extra, extra)
    inner = inner + (rank + 1) * step
    position = np.concatenate([ends, inner])
    cost = np.concatenate([np.full(len(ends), sentence), np.full(len(inner), inside)])
    order = np.argsort(position, kind="stable")
    position, cost = position[order], cost[order]
    cost[np.searchsorted(position, doc_ends)] = 0.0
    return position, cost


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, step: int = 32,
         inside: float = 12.0, sentence: float = 4.0, block: int = 1 << 18) -> DataFrame:
    """Pieces of documents in sequences of at most ``limit`` tokens, documents in table order.

    Every document is its ids by the byte-level BPE file ``tokenizer`` followed by id 0. Window cuts are chosen by
    ``choose_cuts`` for about ``block`` tokens at a time; the last windows of a block are chosen again with the next
    block, so blocks leave no seam. No shuffle: each input partition is packed on its own and may pad one sequence.
    The file is read once on the driver (some MB) and travels as a broadcast.

    Null and empty texts are the id 0 alone; a null id stays null; repeated rows are packed each; texts of any length
    are cut into as many pieces as needed; an empty table gives no row; other columns are ignored. ``sequence_id`` is
    unique, not gapless: the partition's number times 2**33 plus a counter.
    """
    import public_tokenizers

    small_batches(df.sparkSession)
    ranks, special = read_vocabulary(tokenizer)
    pattern = public_tokenizers.PATTERN
    shared = df.sparkSession.sparkContext.broadcast(
        [(base64.b64encode(b).decode(), i) for b, i in ranks])
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        table = [(base64.b64decode(b), i) for b, i in shared.value]
        enc = encoder(table, special, pattern)
        ends_sentence = np.zeros(max([i for _, i in table] + list(special.values())) + 1, bool)
        for b, i in table:
            ends_sentence[i] = b[-1:] in (b".", b"!", b"?", b"\n")
        ends_sentence[0] = True
        sequence = TaskContext.get().partitionId() << 33
        ids, docs = [], []  # waiting token arrays, (doc_id, first token in the document, tokens, tokens of the document)

        def flush(last: bool):
            nonlocal ids, docs, sequence
            stream = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            if not len(stream):
                return None
            doc_ends = np.cumsum([d[2] for d in docs])
            position, cost = candidates(stream, doc_ends, ends_sentence, step, inside, sentence)
            cuts = position[choose_cuts(position, cost, limit)]
            done = len(cuts) if last else max(len(cuts) - 8, 0)
            cuts = cuts[:done]
            stop = int(cuts[-1]) if done else 0
            # a piece ends where a window or a document ends
            edges = np.unique(np.concatenate([[0], cuts, doc_ends[doc_ends < stop]])) if stop else np.zeros(1, np.int64)
            window_start = np.concatenate([[0], cuts[:-1]]) if stop else cuts
            left, right = edges[:-1], edges[1:]
            which = np.searchsorted(doc_ends, left, side="right")
            window = np.searchsorted(cuts, left, side="right")
            doc_start = doc_ends - np.array([d[2] for d in docs])
            at = [docs[i] for i in which.tolist()]
            raw = memoryview(np.ascontiguousarray(stream, "<u4")).cast("B")
            out = pa.RecordBatch.from_arrays([
                pa.array([d[0] for d in at], pa.int64()),
                pa.array(left - doc_start[which] + np.array([d[1] for d in at], np.int64), pa.int64()),
                pa.array(right - left, pa.int64()),
                pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(left.tolist(), right.tolist())], pa.int64()),
                pa.array([d[3] for d in at], pa.int64()),
                pa.array(sequence + window, pa.int64()),
                pa.array(left - window_start[window] if stop else left, pa.int64()),
            ], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += done
            # what is left starts inside a document
            i = int(np.searchsorted(doc_ends, stop, side="right"))
            rest = docs[i:]
            if rest:
                d, used = rest[0], stop - int(doc_start[i])
                rest = [(d[0], d[1] + used, d[2] - used, d[3]), *rest[1:]]
            ids, docs = ([stream[stop:].copy()] if stop < len(stream) else []), rest
            return out

        waiting = 0
        for batch in batches:
            for part in slices(batch, text_col):
                for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist()):
                    if WHITE.search(text or ""):
                        with encoding(spec.value) as encode:
                            found = encode(pa.array([text]))[1]
                    else:
                        found = enc.encode_to_numpy(text or "", allowed_special="all")
                    found = np.append(found, np.uint32(0)).astype(np.uint32)
                    for a in range(0, len(found), block):  # a giant text enters in blocks too
                        ids.append(found[a:a + block])
                        n = len(ids[-1])
                        docs.append((doc, a, n, len(found)))
                        waiting += n
                        if waiting >= block:
                            out = flush(False)
                            waiting = sum(map(len, ids))
                            if out is not None:
                                yield out
        out = flush(True)
        if out is not None:
            yield out

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, SCHEMA)
