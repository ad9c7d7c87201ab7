"""Spelling variants: words one edit apart, found with grams of variable length from a frequency-pruned dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raresift.llm.frames import materialize, share, shared_value
from raresift.llm.words import mix

SHORT, LONG = 2, 5  # code points of the shortest and longest gram
OFTEN = 300  # a gram that occurs more often is lengthened
DICTIONARY = 1 << 18  # at most so many lengthened grams of each length
HOT = 128  # a list of more words is cut by their halves
BEGIN, END = 0x110000, 0x110001  # signs before and after every word, beyond all code points
STEP = np.uint64(0x9E3779B97F4A7C15)
PLAIN = np.uint64(0x7F4A7C15D1B54A32)  # tells grams of fixed length apart


def matrices(words: list[str]):
    """(positions in the list, code points with BEGIN and END) for each length of words."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        m = np.empty((len(at), n + 2), np.uint64)
        m[:, 0], m[:, -1] = BEGIN, END
        if n:
            m[:, 1:-1] = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), n)
        yield np.array(at), m


def gram_codes(m: np.ndarray, q: int) -> np.ndarray:
    """Hash of the gram of q code points at every position."""
    n = m.shape[1] - q + 1
    h = np.zeros((len(m), max(n, 0)), np.uint64)
    for j in range(q if n > 0 else 0):
        h = mix(h * STEP + m[:, j:j + n] + np.uint64(1))
    return h


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(values.shape, bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Grams:
    """The dictionary: codes of all frequent grams, which are lengthened, and of what may stand at the end of those.

    A gram at a position is the shortest of at least SHORT code points that is not frequent; of LONG at most, or what the word has left.
    """

    def __init__(self, frequent: list[tuple[int, ...]]):
        suffixes = {g[i:] for g in frequent for i in range(1, len(g))}
        self.frequent, self.suffixes = (self._codes(x) for x in (frequent, suffixes))

    @staticmethod
    def _codes(grams) -> np.ndarray:
        by_length: dict[int, list] = {}
        for g in grams:
            by_length.setdefault(len(g), []).append(g)
        return np.sort(np.concatenate([gram_codes(np.array(x, np.uint64), q)[:, 0] for q, x in by_length.items()])) if by_length \
            else np.zeros(0, np.uint64)

    def decompose(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: which positions begin a gram of the word, the codes of those, and how many of them one edit can affect.

        Grams inside an earlier one are left out. An edit affects the grams that hold its place; those to the left from where a frequent gram reaches
        up to it, as they may be lengthened or covered; and those to the right that a gram from the left may come to cover, which ends in
        what a frequent gram ends in. All other grams stay, with the same place or one place on.
        """
        n, w = m.shape
        places = w - SHORT + 1
        codes = {q: gram_codes(m, q) for q in range(1, min(LONG, w) + 1)}
        often = {q: _member(codes[q], self.frequent) for q in range(SHORT, min(LONG - 1, w) + 1)}
        length = np.full((n, places), SHORT)
        code = codes[SHORT].copy()
        for q in range(SHORT, min(LONG, w)):
            k = w - q
            more = often[q][:, :k] & (length[:, :k] == q)
            length[:, :k] += more
            code[:, :k] = np.where(more, codes[q + 1], code[:, :k])
        end = np.arange(places) + length
        own = np.ones((n, places), bool)
        own[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
        left = np.tile(np.arange(w + 1), (n, 1))  # first place from which a frequent gram reaches the boundary
        for q in range(SHORT, min(LONG - 1, w) + 1):
            left[:, q:] = np.where(often[q], np.arange(w + 1 - q), left[:, q:])
        right = np.zeros((n, w + 1), np.int64)  # where a gram across the boundary may end
        for q in range(SHORT, min(LONG - 1, w) + 1):
            after = _member(codes[q - 1][:, :w + 1 - q], self.suffixes)
            right[:, :w + 1 - q] = np.where(after, np.arange(w + 1 - q) + q, right[:, :w + 1 - q])

        def affected(i: np.ndarray, gap: int) -> np.ndarray:
            """Grams affected at the places i: ``gap`` 1 for one replaced or deleted, 0 for one inserted before it."""
            total = np.zeros((n, len(i)), np.int64)
            for d in range(-LONG, LONG + 2):
                p = i + d
                inside = (p >= 0) & (p < places)
                at = np.clip(p, 0, places - 1)
                e = end[:, at]
                holds = (p < i + gap) & (e > i)
                before = (e <= i) & (p >= left[:, i])
                behind = (p >= i + gap) & (e <= right[:, i + gap])
                total += own[:, at] & inside & (holds | before | behind)
            return total.max(axis=1, initial=0)

        most = np.maximum(affected(np.arange(1, w - 1), 1), affected(np.arange(1, w), 0))
        return own, code, most


def _tokens(grams: Grams, words: list[str]):
    """(positions in the list, row, code, place, keep) for the words of each length: a row per gram and how many of the word's rarest matter.

    Words that keep no gram for sure also get their grams of fixed length under codes of their own, of which one edit affects two.
    """
    for at, m in matrices(words):
        own, code, most = grams.decompose(m)
        size = own.sum(axis=1)
        row, place = np.nonzero(own)
        yield at, row, code[row, place], place, np.minimum(most, size) + 1
        weak = np.flatnonzero(size <= most)
        if len(weak):
            plain = mix(gram_codes(m[weak], SHORT) ^ PLAIN)
            row, place = np.nonzero(np.ones(plain.shape, bool))
            yield at[weak], row, plain[row, place], place, np.full(len(weak), 3)
            if m.shape[1] < 4:  # of one code point or none, that may be the one edited: a list for them all
                yield at[weak], np.arange(len(weak)), np.full(len(weak), PLAIN), np.zeros(len(weak), np.int64), np.ones(len(weak), np.int64)


def gram_dictionary(words: DataFrame, often: int = OFTEN, most: int = DICTIONARY) -> Grams:
    """Counts the grams of SHORT to LONG - 1 code points; those that occur more than ``often`` times are lengthened. The number grows with
    the table so that at most ``most`` of a length do: that many reach the driver and are broadcast."""
    def run(batches):
        for batch in batches:
            for _, m in matrices(batch.column("word").to_pylist()):
                for q in range(SHORT, min(LONG, m.shape[1] + 1)):
                    code = gram_codes(m, q)
                    _, first, n = np.unique(code, return_index=True, return_counts=True)
                    row, place = np.divmod(first, code.shape[1])
                    grams = np.stack([m[row, place + j] for j in range(q)], axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.list_(pa.int32())), pa.array(n)], names=["gram", "n"])

    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counts = words.select("word").mapInArrow(run, "gram array<int>, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Grams([tuple(r.gram) for r in counts.filter(F.col("n") > max(often, places // most)).select("gram").collect()])


def _frequent(words: DataFrame, shared, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (sorted) and counts of the grams that hold a ``most``-th of all places and more; all others count as equally rare."""
    def run(batches):
        grams = shared_value(shared, Grams)
        for batch in batches:
            for _, _, h, _, _ in _tokens(grams, batch.column("word").to_pylist()):
                code, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = materialize(words.select("word").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "variant-grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * most > total).toPandas()
    h, n = found["h"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _lists(words: DataFrame, shared, frequent) -> DataFrame:
    """(word, len, h, pos): the lists a word is merged by, those of its rarest grams."""
    def run(batches):
        grams, (codes, counts) = shared_value(shared, Grams), frequent.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            for at, row, h, place, keep in _tokens(grams, words):
                n = np.zeros(len(h), np.int64)
                if len(codes):
                    i = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                    n = np.where(codes[i] == h, counts[i], 0)
                order = np.lexsort((place, h, n, row))
                row, h, place = row[order], h[order], place[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                use = rank < keep[row]
                text = pa.array([words[i] for i in at.tolist()], pa.string()).take(pa.array(row[use]))
                yield pa.RecordBatch.from_arrays([text, pa.array(np.full(len(text), len(words[at[0]]) if len(at) else 0, np.int32)),
                                                  pa.array(h[use].view(np.int64)), pa.array(place[use].astype(np.int32))], names=["word", "len", "h", "pos"])

    return words.select("word").mapInArrow(run, "word string, len int, h long, pos int")


def _keyed(lists: DataFrame, hot: DataFrame, kinds: list[Column]) -> DataFrame:
    """Rows of lists with their keys: one per list, or for a hot one two per kind, made of the halves that words of the kind's length share.

    A kind is the length n of the shorter word of a pair: its first n div 2 code points or its last n - n div 2 are in both words.
    """
    keys = []
    for n in kinds:
        cut = F.floor(n / 2).cast("int")
        keys += [F.xxhash64("h", "pos", "len", n, F.lit(1), F.left("word", cut)), F.xxhash64("h", "pos", "len", n, F.lit(2), F.right("word", n - cut))]
    rows = lists.join(hot, ["h", "pos", "len"], "left")
    own = F.array(F.xxhash64("h", "pos", "len"))
    return rows.withColumn("key", F.explode(F.when(F.col("hot"), F.array(*keys)).otherwise(own)))


def near_words(words: DataFrame, often: int = OFTEN, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct words (column word) that differ by exactly one inserted, deleted or replaced code point.

    1. Every word is cut into grams of the dictionary (``gram_dictionary``); its bound is the number of grams that no single edit can affect.
    2. Two near words have at least the larger of their bounds in common, each at the same place or one on. In the order of frequency each
       has the first common gram among its rarest ``affected + 1``, so only those lists are merged, and of a list only words of the right length and place.
       Words whose bound is 0 also carry grams of fixed length, by which two of them find each other.
    3. A list of more than ``hot`` words is cut by the halves of its words, one of which two near words share, so no long list is compared with
       itself. The join verifies the edit distance and emits near pairs only.

    An empty table gives no pair; null words are left out.
    """
    spark = words.sparkSession
    words = words.select("word").dropna().distinct()
    shared = share(spark, gram_dictionary(words, often))
    frequent = spark.sparkContext.broadcast(_frequent(words, shared, DICTIONARY))
    lists = materialize(_lists(words, shared, frequent), "variant-lists")
    long = materialize(lists.groupBy("h", "pos", "len").count().filter(F.col("count") > hot)
                       .select("h", "pos", "len", F.lit(True).alias("hot")), "variant-hot")
    index = _keyed(lists, long, [F.col("len"), F.col("len") - 1]).select("key", F.col("word").alias("b"), F.col("len").alias("len_b"))
    # a word looks for words of its length at the same place, and for words one longer at the same place or the next
    aims = F.explode(F.array(*[F.struct((F.col("len") + more).alias("len"), (F.col("pos") + on).alias("pos")) for more, on in ((0, 0), (1, 0), (1, 1))]))
    probes = lists.select("word", F.col("len").alias("n"), "h", aims.alias("t")).select("word", "n", "h", "t.pos", "t.len")
    probes = _keyed(probes, long, [F.col("n")]).select("key", F.col("word").alias("a"), F.col("n").alias("len_a"))
    found = probes.join(index, "key").filter(((F.col("len_a") < F.col("len_b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# The letters of a word, and those that are lower-cased.
RUN = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(df: DataFrame, shortest: int = 5, least: int = 3, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = 97) -> DataFrame:
    """(word, n) of the words of whole texts: runs of RUN, A-Z lower-cased, of at least ``shortest`` code points that occur ``least`` times.

    With ``drop_every``, let h be the crc32 of "<id>:<run>"; where it is a multiple, the run's code point h % length is deleted (planted
    misspellings). A null id counts as empty text there. Counts are combined before they are shuffled.
    """
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                     F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("len", F.length("run")).filter(F.col("len") >= shortest)  # a deletion makes none longer
    # lower() is quick on ASCII but would change letters beyond it
    plain = F.octet_length("run") == F.col("len")
    runs = runs.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    if drop_every:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        runs = runs.withColumn("h", h).withColumn("at", F.when(F.col("h") % drop_every == 0, (F.col("h") % F.col("len")).cast("int")))
        cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.col("len")))
        runs = runs.withColumn("run", F.when(F.col("at").isNull(), F.col("run")).otherwise(cut)) \
            .filter(F.col("at").isNull() | (F.col("len") > shortest))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, form, n_near, form_n) of counted words and their near pairs: the near word of largest n, the first in code-point
    order among equals, if it has ``times`` the word's n."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(known, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("low"), "other")).alias("best"))
    out = words.join(best, "word", "left").withColumn("found", (-F.col("best.low")) >= F.col("n") * times)
    return out.select("word", "n", F.when(F.col("found"), F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                      F.when(F.col("found"), -F.col("best.low")).alias("form_n"))


def roots(named: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for the words with a form: the last word reached by following forms. Every round doubles the way a word has gone, and
    counts grow along it, so it ends. Rounds are written to the shared folder; a row at most goes to the driver."""
    now = materialize(named.filter("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not now.join(on, "root", "left_semi").head(1):
            return now
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    raise RuntimeError(f"forms do not end after {rounds} rounds")


def spelling_variants(df: DataFrame, shortest: int = 5, least: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text",
                      drop_every: int | None = 97) -> DataFrame:
    """One row per word of the corpus (``count_words``): word, form, root, n, n_near, form_n.

    Near words are found exactly (``near_words``); form is the near word of largest n, if at least ``times`` the word's own, else null; root
    the end of the chain of forms, the word itself if it has none.

    Null and empty texts have no word; null ids are allowed; repeated rows count each; ties take the first word in code-point order; runs of any
    length are words; an empty table gives no row; other columns are ignored.
    """
    words = materialize(count_words(df, shortest, least, id_col, text_col, drop_every), "variant-words")
    named = materialize(forms(words, near_words(words), times), "variant-forms")
    return named.join(roots(named), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
