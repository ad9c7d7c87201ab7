"""Token ids of whole text columns by the ``tokenizers`` library, each distinct piece encoded once.

Byte-level BPE files cut a text by a pattern in which no piece goes on from a letter to an ASCII character that is no letter, nor from
a character that is no white space to one that is. A text cut at such places therefore encodes to the ids of its parts, one after
the other. The parts (a word with the white space before it) repeat a lot, so Arrow makes them distinct and only new ones go to the library.
"""

from __future__ import annotations

import contextlib
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from raresift.llm.words import slices, text_buffers

ROOM = 1 << 21  # remembered pieces, at most 40 MB of them
BATCH = 8 << 20  # bytes of text encoded together

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_OTHER = ~_LETTER
_OTHER[128:] = False
# Second-to-last bytes of wide white space in UTF-8, after the lead bytes E1, E2, E3 (other characters among them do no harm).
_WIDE = np.zeros(256, bool)
_WIDE[[0x9A, 0xA0, 0x80, 0x81]] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions where a piece surely ends: after an ASCII letter, before an ASCII character that is none; and at white space after
    a character that surely is none."""
    letter = _LETTER[data]
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1] & _OTHER[data[1:]]
    at = np.flatnonzero(_SPACE[data] & ~after)
    at = at[at > 0]
    before = data[at - 1]
    sure = _PRINTED[before]
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        i = at[wide]
        two, three = data[np.maximum(i - 2, 0)], data[np.maximum(i - 3, 0)]
        narrow = (two == 0xC2) & ((before[wide] == 0x85) | (before[wide] == 0xA0))
        sure[wide] = ~narrow & ~((three >= 0xE1) & (three <= 0xE3) & _WIDE[two])
    after[at[sure]] = True
    return np.flatnonzero(after)


class Encoder:
    """Ids by a ``tokenizers`` file given as text, without added special tokens; special strings in a text count as the file says.

    Memory: the remembered pieces, and some 20 bytes per byte of the column given.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _outside(self, cuts: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The cuts that are in no special string."""
        raw = data.tobytes()
        for token in self.special:
            at, found = raw.find(token), []
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
            if found:
                found = np.array(found)
                i = np.searchsorted(found, cuts) - 1  # the last one that begins before the cut
                cuts = cuts[(i < 0) | (cuts >= found[i] + len(token))]
        return cuts

    def _learn(self, pieces: pa.Array) -> None:
        lengths, flat = [], []
        for i in range(0, len(pieces), 4096):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i:i + 4096].to_pylist(), add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
        self.known = pa.concat_arrays([self.known, pieces])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))])
        self.flat = np.concatenate([self.flat, *flat])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each row and the end, ids) of a string column; a null text has no ids."""
        offsets, data = text_buffers(column)
        if not len(data):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        starts = np.sort(np.concatenate([offsets[:-1], self._outside(_cuts(data), data)]), kind="stable")
        starts = starts[np.append(starts[1:] > starts[:-1], starts[-1] < len(data))]
        ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        parts = pa.LargeStringArray.from_buffers(len(starts), ends, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        if len(self.known) > ROOM or self.known.nbytes > 40 << 20:
            self._forget()
        at = pc.index_in(parts.dictionary, value_set=self.known)
        if at.null_count:
            new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            at = at.fill_null(0).to_numpy().astype(np.int64)
            at[new] = len(self.known) + np.arange(len(new))
            self._learn(parts.dictionary.take(pa.array(new)))
        else:
            at = at.to_numpy()
        which = at[parts.indices.to_numpy()]
        first = self.first[which]
        n = self.first[which + 1] - first
        ends = np.cumsum(n)
        out = self.flat[np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))]
        return np.append(0, ends)[np.searchsorted(starts, offsets)], out


def blocks(batches, text_col: str, limit: int = BATCH):
    """The rows of Arrow batches in parts of about ``limit`` bytes of text: small batches are put together, large ones cut."""
    waiting, size = [], 0
    for batch in batches:
        for part in slices(batch, text_col, limit):
            waiting.append(part)
            size += len(part) + int(text_buffers(part.column(text_col))[0][-1])
            if size >= limit:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
    if size:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def shared_encoder(spec: str) -> Encoder:
    """The encoder of this Python process: tasks that follow each other in a worker share what it has learned."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_raresift", {})
    if spec not in held:
        held.clear()
        held[spec] = Encoder(spec)
    return held[spec]


@contextlib.contextmanager
def encoding(spec: str):
    """An encoder for one task; afterwards the worker holds none of its memory, which the tasks of other stages need."""
    encoder = Encoder(spec)
    try:
        yield encoder
    finally:
        encoder.__dict__.clear()
        pa.default_memory_pool().release_unused()
