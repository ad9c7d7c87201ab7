"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND over training passages, overlap checks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import share, shared_value, small_batches
from raresift.llm.words import Words, shingles, slices

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8  # items of an index block
PART = 1 << 19  # bytes of text searched together
BOUNDS = 1 << 17  # block bounds held together, of one passage at least
SHARD_WORDS = 2_000_000  # words of items in one broadcast index (some 100 MB at most)
LEAKS = "doc_id long, item_id long, start_word long, score double, overlap double, question_overlap double, answer_overlap double"

# Marks that begin an answer.
_ANSWER = re.compile(r"(?:^|\n)\s*(?:answer|a|antwort|réponse|respuesta)\s*[:.)]\s*|\?\s+", re.I)


def parts(text: str) -> tuple[str, str]:
    """(question, answer): split at an answer mark or after the first question mark, else before the last sentence; a
    text of one sentence is both."""
    found = _ANSWER.search(text)
    if found and text[:found.start() + 1].strip() and text[found.end():].strip():
        return text[:found.start() + 1], text[found.end():]
    sentences = [m for m in re.finditer(r"[^.!?\n]+[.!?\n]*", text) if m[0].strip()]
    if len(sentences) < 2:
        return text, text
    return text[:sentences[-1].start()], text[sentences[-1].start():]


@dataclass
class Index:
    """Items of one shard. Impacts are BM25 shares of an item's score against itself, so one threshold serves all items.

    Terms are sorted hashes; postings of term t are posting_item[at[t]:at[t + 1]] with their impacts, in blocks of
    ``BLOCK_ITEMS`` consecutive items: block_of and block_most hold the largest impact of each block (block_at as at), most
    the largest of all.
    """

    item_ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    at: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    block_at: np.ndarray
    block_of: np.ndarray
    block_most: np.ndarray
    most: np.ndarray
    shingles: list[np.ndarray]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int


def _hashed(words: Words, texts: list[str]) -> list[np.ndarray]:
    row, start, end, data, _ = words.split(pa.array(texts, pa.string()))
    h = words.hashes(start, end, data)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(at[:-1], at[1:])]


def build(items: list[tuple[int, str]], df_of: dict[int, int], n_items: int, mean_length: float, stride: int, k: int) -> Index:
    """Index of one shard; document frequencies, item count and mean length are those of the whole benchmark."""
    words = Words("alnum")
    tokens = _hashed(words, [t for _, t in items])
    keep = [i for i, t in enumerate(tokens) if len(t)]
    items, tokens = [items[i] for i in keep], [tokens[i] for i in keep]
    rows = []
    for i, t in enumerate(tokens):
        term, tf = np.unique(t, return_counts=True)
        df = np.array([df_of[int(x.astype(np.int64))] for x in term], float)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean_length))
        rows.append((term, np.full(len(term), i), impact / impact.sum()))
    term, item, impact = (np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, kind) for j, kind in enumerate((np.uint64, np.int64, float)))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    terms, at = np.unique(term, return_index=True)
    at = np.append(at, len(term))
    which = np.searchsorted(terms, term)
    block = item // BLOCK_ITEMS
    new = np.ones(len(term), bool)
    new[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    block_most = np.maximum.reduceat(impact, first) if len(first) else impact
    block_at = np.append(np.searchsorted(which[first], np.arange(len(terms))), len(first))
    most = np.maximum.reduceat(impact, at[:-1]) if len(terms) else impact

    def grams(t):
        return np.unique(shingles(np.zeros(len(t), np.int64), t, 1, min(k, len(t)))[1])

    qa = [parts(t) for _, t in items]
    return Index(np.array([i for i, _ in items], np.int64), np.array([len(t) for t in tokens]), terms, at, item, impact, block_at, block[first],
                 block_most, most, [grams(t) for t in tokens], [np.unique(x) for x in _hashed(words, [q for q, _ in qa])],
                 [np.unique(x) for x in _hashed(words, [a for _, a in qa])], stride)


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, index) for all indices of the ranges."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[which]


def search(index: Index, passage: np.ndarray, term: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all with score >= alpha, for distinct (passage, term) pairs sorted by passage.

    Block-max WAND over many queries at once: a passage goes on if the sum of its terms' largest impacts reaches alpha; then only with the
    blocks of items whose sum of block maxima does; only there postings are read and scored. Bounds are never below
    a score, so nothing is lost.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(passage):
        return nothing
    slack = alpha - 1e-9
    new = np.ones(len(passage), bool)
    new[1:] = passage[1:] != passage[:-1]
    number = np.cumsum(new) - 1
    use = (np.bincount(number, index.most[term]) >= slack)[number]
    passage, term = passage[use], term[use]
    if not len(passage):
        return nothing
    n_blocks = int(index.block_of.max()) + 1
    names, number = np.unique(passage, return_inverse=True)
    found = []
    # passages are taken together as far as their cells and the blocks of their terms are few
    cost = np.cumsum(np.bincount(number, index.block_at[term + 1] - index.block_at[term]).astype(np.int64) + n_blocks)
    begin = np.flatnonzero(np.diff(cost // BOUNDS, prepend=-1))
    cuts = np.append(np.searchsorted(number, begin), len(number))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        own, t = number[a:b], term[a:b]
        base = own[0]
        which, at = _expand(index.block_at[t], index.block_at[t + 1])
        bound = np.bincount((own[which] - base) * n_blocks + index.block_of[at], index.block_most[at], (own[-1] - base + 1) * n_blocks) >= slack
        open_ = bound[(own[which] - base) * n_blocks + index.block_of[at]]
        if not open_.any():
            continue
        # postings of the open blocks only; ``bound`` tells them by (passage, block)
        some = np.unique(which[open_])
        w, p = _expand(index.at[t[some]], index.at[t[some] + 1])
        w = some[w]
        cell = (own[w] - base) * n_blocks + index.posting_item[p] // BLOCK_ITEMS
        sel = bound[cell]
        w, p = w[sel], p[sel]
        key = (own[w] - base) * len(index.item_ids) + index.posting_item[p]
        keys, inverse = np.unique(key, return_inverse=True)
        score = np.bincount(inverse, index.posting_impact[p], len(keys))
        hit = score >= slack
        found.append((names[base + keys[hit] // len(index.item_ids)], keys[hit] % len(index.item_ids), score[hit]))
    if not found:
        return nothing
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


class Detector:
    """Leaks of whole texts. A text's passages are windows of 2 * stride words, one every stride words, with stride the
    length of the longest item, so that every occurrence of an item lies whole in one passage."""

    def __init__(self, index: Index, alpha: float, least: float, k: int):
        self.index, self.alpha, self.least, self.k = index, alpha, least, k
        self.words = Words("alnum")

    def __call__(self, column) -> list[tuple[int, int, int, float, float, float, float]]:
        """(row, item, first word of the passage, score, overlap, question overlap, answer overlap); the best passage of
        each row and item."""
        ix = self.index
        if not len(ix.item_ids):
            return []
        row, start, end, data, _ = self.words.split(column)
        h = self.words.hashes(start, end, data)
        t = np.minimum(np.searchsorted(ix.terms, h), len(ix.terms) - 1)
        hit = np.flatnonzero(ix.terms[t] == h)
        rows = np.arange(len(column) + 1)
        first = np.searchsorted(row, rows)
        place = hit - first[row[hit]]
        # passages are numbered so that those of different rows differ
        n = np.diff(first)
        passages = np.maximum(1, -(-n // ix.stride))
        base = np.cumsum(passages) - passages
        own = place // ix.stride
        p = base[row[hit]] + own
        before = own > 0
        key = np.unique(np.concatenate([p, p[before] - 1]) * len(ix.terms) + np.concatenate([t[hit], t[hit][before]]))
        passage, item, score = search(ix, key // len(ix.terms), key % len(ix.terms), self.alpha)
        best: dict[tuple[int, int], tuple] = {}
        for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist()):
            r = int(np.searchsorted(base, p, side="right")) - 1
            begin = first[r] + (p - base[r]) * ix.stride
            w = h[begin:min(begin + 2 * ix.stride, first[r + 1])]
            size = min(self.k, int(ix.lengths[i]))
            grams = shingles(np.zeros(len(w), np.int64), w, 1, size)[1] if len(w) >= size else np.zeros(0, np.uint64)
            overlap = float(np.isin(ix.shingles[i], grams).mean())
            question, answer = (float(np.isin(x, w).mean()) if len(x) else 1.0 for x in (ix.question[i], ix.answer[i]))
            if min(overlap, question, answer) >= self.least:
                found = (overlap, s, -(p - base[r]) * ix.stride, question, answer)
                if found > best.get((r, i), ()):
                    best[(r, i)] = found
        return [(r, i, int(-b), s, o, q, a) for (r, i), (o, s, b, q, a) in sorted(best.items())]


def _indexes(items: DataFrame, id_col: str, text_col: str, k: int, shard_words: int):
    """Indexes of the whole benchmark, one after the other; each holds about ``shard_words`` words. Yields (shard, broadcast)."""
    spark = items.sparkSession
    small_batches(spark)
    clean = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .filter("item_id is not null").groupBy("item_id", "text").agg(F.lit(1).alias("one")).drop("one")

    def run(batches):
        words = Words("alnum")
        for batch in batches:
            for ids, h in zip(batch.column("item_id").to_pylist(), _hashed(words, batch.column("text").to_pylist())):
                term, tf = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), ids)), pa.array(term.view(np.int64)), pa.array(np.full(len(term), len(h)))],
                                                 names=["item_id", "term", "length"])

    tokens = clean.mapInArrow(run, "item_id long, term long, length long")
    sizes = tokens.groupBy("item_id", "length").count().agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.max("length").alias("longest")).first()
    if not sizes.n:
        return
    shards = sizes.words // shard_words + 1
    frequency = tokens.groupBy("term").agg(F.count("*").alias("df"))
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    for i in range(shards):
        own = clean.filter(shard == i)
        terms = tokens.filter(shard == i).select("term").distinct().join(frequency, "term").collect()  # bounded by the shard
        index = build(sorted((r.item_id, r.text) for r in own.collect()), {r.term: r.df for r in terms}, sizes.n, sizes.words / sizes.n,
                      int(sizes.longest), k)
        yield share(spark, index)


def leaks(df: DataFrame, items: DataFrame, alpha: float = 0.5, least: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, score, overlap, question_overlap, answer_overlap) of every document that holds a test item.

    Every passage of every whole text is a query against the index: all items whose BM25 score reaches ``alpha`` of their
    score against themselves are retrieved, none other. Of those, a leak has ``least`` of the item's k-word shingles in the passage and of
    the words of both its question and its answer. Words are runs of ASCII letters, digits and other bytes over 127, A-Z lower-cased.

    The index is broadcast in shards of bounded size, with frequencies of the whole benchmark; documents are scanned once per shard, without a
    shuffle. Null and empty texts and items without a word leak nothing; items of fewer than k words count as one
    shingle; items with a null id are left out, repeated items count once; a null doc_id stays null; repeated rows are
    reported each; empty tables give no row; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _indexes(items, item_id, item_text, k, shard_words):
        def run(batches, shared=shared):
            index = shared_value(shared, Index)
            detect, ids = Detector(index, alpha, least, k), index.item_ids
            for batch in batches:
                for part in slices(batch, "text", PART):
                    rows = detect(part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([int(ids[r[1]]) for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3, 7))],
                        names=["doc_id", "item_id", "start_word", "score", "overlap", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(run, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], LEAKS)


def without_leaks(df: DataFrame, items: DataFrame, alpha: float = 0.5, least: float = 0.8, k: int = 5, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``df`` that hold no test item, by the rule of ``leaks``; all columns are kept."""
    for shared in _indexes(items, item_id, item_text, k, shard_words):
        def run(batches, shared=shared):
            detect = Detector(shared_value(shared, Index), alpha, least, k)
            for batch in batches:
                for part in slices(batch, text_col, PART):
                    keep = np.ones(len(part), bool)
                    keep[[r[0] for r in detect(part.column(text_col))]] = False
                    yield part.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
