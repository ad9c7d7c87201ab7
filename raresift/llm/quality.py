"""Quality classifier: hashed word and character n-gram vectors, averaged per document, trained by numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import share, shared_value
from raresift.llm.toxicity import _sample
from raresift.llm.words import slices

GRAMS = (3, 4, 5)  # lengths of character n-grams; a word's ends count as characters


class Features:
    """Hashed features of texts: every word, every pair of neighbouring words, and every character n-gram inside a word
    with its two ends. That a word follows itself is a feature of its own.

    White space runs become one boundary character. Features are returned as (text of each, bucket of each), text by
    text in no further order.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.space = np.zeros(0x110000, bool)
        self.space[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000, *range(0x2000, 0x200B)]] = True

    def _bucket(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        return (h >> np.uint32(32 - self.bits)).astype(np.int32)

    def of(self, texts: list[str]):
        """Yields (text numbers, buckets) for words and for each n-gram length."""
        # line feeds around every text: texts share no n-gram, and an empty one has none
        joined = "\n" + "\n\n".join(texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 2 for t in texts])
        blank = self.space[chars]
        keep = np.ones(len(chars), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        at = np.flatnonzero(keep)
        c = np.where(blank[at], np.uint32(32), chars[at])
        blank = blank[at]
        row = np.searchsorted(ends, at, side="right").astype(np.int32)
        marks = np.flatnonzero(blank)
        if len(marks) < 2:
            return
        # words: sums of position-weighted hashed characters between two marks
        step = np.uint32(0x01000193)
        mixed = (c ^ (c >> np.uint32(7))) * np.uint32(0x85EBCA6B) + np.uint32(1)
        place = np.arange(len(c), dtype=np.int64) - np.repeat(marks, np.diff(np.append(marks, len(c))))
        place = np.minimum(place, 63)
        powers = np.cumprod(np.append(np.uint32(1), np.full(63, step, np.uint32)), dtype=np.uint32)
        total = np.cumsum(mixed * powers[place], dtype=np.uint32)
        word = total[marks[1:] - 1] - total[marks[:-1]]
        at = row[marks[:-1] + 1]
        yield at, self._bucket(word, 1)
        # pairs of neighbouring words; a word that follows itself is one feature, whatever the word
        if len(word) > 1:
            pair = self._bucket(word[:-1] * step + word[1:], 2)
            pair = np.where(word[:-1] == word[1:], self._bucket(np.zeros(1, np.uint32), 6)[0], pair)
            use = np.flatnonzero(at[:-1] == at[1:])
            yield at[use], pair[use]
        # n-grams: a mark only as first or last character
        inner = np.cumsum(blank)
        h = c.copy()
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1:]
            if n not in GRAMS or not len(h):
                continue
            marks_inside = inner[n - 2:len(c) - 1] - inner[:len(c) - n + 1]
            use = np.flatnonzero(marks_inside == 0)
            yield row[use + 1], self._bucket(h[use], n)


@dataclass
class Model:
    """One number per bucket: what the feature adds to the log odds before averaging; exact, as the output layer and the
    average are linear. ``base`` is the constant."""

    gain: np.ndarray
    base: float
    bits: int

    def score(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = self.base + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(documents: list[tuple[np.ndarray, np.ndarray, int]], bits: int, width: int = 16, epochs: int = 8, rate: float = 0.5,
          seed: int = 3) -> Model:
    """Averages the vectors of a document's features, softmax over two classes, one SGD step per document.

    documents: (distinct buckets, counts, label). The rate falls linearly to zero. The step of a feature's vector is the
    output's gradient times its share of the document times ``boost`` below, as shares are small.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    output, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
    boost, steps, at = np.float32(20.0), max(1, epochs * len(documents)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            buckets, counts, label = documents[i]
            now = np.float32(rate * (1 - at / steps))
            at += 1
            share = (counts / counts.sum()).astype(np.float32) if len(counts) else counts.astype(np.float32)
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(width, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            if len(buckets):
                vectors[buckets] -= (now * boost) * share[:, None] * (output.T @ p)[None, :]
                output -= now * np.outer(p, hidden)
            bias -= np.float32(0.1) * now * p
    gain = (vectors @ (output[1] - output[0])).astype(np.float32)
    return Model(gain, float(bias[1] - bias[0]), bits)


def learn(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = 4_000, bits: int = 17, width: int = 16, epochs: int = 8, seed: int = 3) -> Model:
    """Fits on at most ``fit_rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Tasks hash whole texts; only the hashed, counted features of the sample reach the driver. Without labels every
    score is 0.5.
    """
    sample = _sample(df, labels, label_col, id_col, text_col, fit_rows, seed)

    def run(batches):
        features = Features(bits)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = list(features.of(texts))
                rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int32)
                buckets = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int32)
                key, count = np.unique(rows.astype(np.int64) << bits | buckets, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << bits)
                key = (key & ((1 << bits) - 1)).astype("<u4")
                count = count.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("label"),
                    pa.array([key[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["key", "label", "buckets", "counts"])

    rows = sample.mapInArrow(run, "key long, label int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r.key, r.label, r.buckets))
    documents = [(np.frombuffer(r.buckets, "<u4").astype(np.int64), np.frombuffer(r.counts, "<u4"), r.label) for r in rows]
    return train(documents, bits, width, epochs, seed=seed)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; no shuffle. The model (half a MB at 17 bits) is broadcast.

    Null and empty texts have no feature and get the model's constant; a null id stays null; repeated rows are scored
    each; an empty table gives no row; other columns are never read.
    """
    shared = share(df.sparkSession, model)

    def run(batches):
        fitted = shared_value(shared, Model)
        features = Features(fitted.bits)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                total, count = np.zeros(len(texts)), np.zeros(len(texts))
                for rows, buckets in features.of(texts):
                    total += np.bincount(rows, fitted.gain[buckets], len(texts))
                    count += np.bincount(rows, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fitted.score(total, count))], names=[id_col, "score"])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)) \
        .mapInArrow(run, f"`{id_col}` long, score double")
