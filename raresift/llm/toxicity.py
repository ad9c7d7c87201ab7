"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automata, scores from the words around a hit."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raresift.llm.automaton import FuzzyLexicon, Lexicon, tolerance
from raresift.llm.frames import held_out, materialize, share, shared_value, small_batches
from raresift.llm.words import Words, mix, slices

# Words that report speech or name a word, and words that address somebody, in four languages.
REPORTING = frozenset("""said says say called calls wrote writes quote quoted quotes word words term terms insult slur slurs
sagte sagt nannte schrieb zitat wort begriff dit disait appelé écrit mot terme citation dijo dice llamó escribió palabra
término cita""".split())
ADDRESS = frozenset("you your yourself u ur du dich dir ihr euch tu te toi vous tú usted eres sois".split())

QUOTED, REPORTED, ADDRESSED = 0.2, 0.6, 1.3  # factors of a hit's weight
EDIT_WEIGHT = (1.0, 0.8, 0.6)  # by number of edits
WINDOW = 6  # words on either side
CROWD = 3
PART = 1 << 20  # bytes of text handled together, at some 50 bytes a character


@dataclass
class Model:
    """What scoring needs: terms, those matched exactly only, innocent words close to a term, weights of (1, log abuse, log abuse per 100 words)."""

    terms: list[str] = field(default_factory=list)
    strict: frozenset[str] = frozenset()
    innocent: frozenset[str] = frozenset()
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def score(self, abuse: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = _inputs(abuse, words) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(abuse: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(abuse)), np.log1p(abuse), np.log1p(100 * abuse / np.maximum(words, 1))], axis=1)




def _tables() -> tuple[np.ndarray, np.ndarray]:
    """White space, and what may be trimmed off a word's ends (punctuation and symbols but for letters' stand-ins)."""
    space = np.zeros(0x110000, bool)
    space[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000, *range(0x2000, 0x200B)]] = True
    trim = np.zeros(0x110000, bool)
    trim[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’‚‹›…–—"]] = True
    return space, trim


def split_chars(texts: list[str], space: np.ndarray, trim: np.ndarray):
    """(characters of all lower-cased texts, text of each word, start, end); a line feed stands between texts.

    Words are runs without white space, without punctuation at either end; punctuation alone is no word.
    """
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *[len(t) + 1 for t in low]])
    word = ~space[chars]
    if not len(chars):
        none = np.zeros(0, np.int64)
        return chars, none, none, none, offsets, low
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    solid = word & ~trim[chars]
    n = len(chars)
    at = np.arange(n, dtype=np.int64)
    following = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
    previous = np.maximum.accumulate(np.where(solid, at, -1))
    first, last = following[start], previous[end - 1] + 1
    use = (first < end) & (last > start)
    start, end = first[use], last[use]
    return chars, np.searchsorted(offsets[1:], start, side="right"), start, end, offsets, low


def _quoted(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Positions of straight quotes, of opening and of closing ones, and of line ends."""
    straight, opening, closing, lines = [], [], [], []
    for i, c in enumerate(text):
        if c == '"':
            straight.append(i)
        elif c in "“„«‹":
            opening.append(i)
        elif c in "”»›":
            closing.append(i)
        elif c == "\n":
            lines.append(i)
    return straight, opening, closing, lines


def _inside_quotes(marks, at: int) -> bool:
    """Between quotation marks of its line, the straight ones closed again after it."""
    straight, opening, closing, lines = marks
    i = bisect_right(lines, at)
    begin = lines[i - 1] if i else -1
    stop = lines[i] if i < len(lines) else 1 << 62
    a, b, c = bisect_right(straight, begin), bisect_right(straight, at), bisect_right(straight, stop)
    if (b - a) % 2 and c > b:
        return True
    depth = bisect_right(opening, at) - bisect_right(opening, begin) - bisect_right(closing, at) + bisect_right(closing, begin)
    return depth > 0 and bisect_right(closing, stop) > bisect_right(closing, at)


class Scanner:
    """Hits of whole texts with their context weights."""

    def __init__(self, lexicon: FuzzyLexicon | Lexicon):
        self.lexicon = lexicon
        self.space, self.trim = _tables()

    def hits(self, texts: list[str]):
        """(words per text, [(text number, surface word, term, edits, context factor)])."""
        chars, row, start, end, offsets, low = split_chars(texts, self.space, self.trim)
        count = np.bincount(row, minlength=len(texts))
        where, term, edits = self.lexicon.find(chars, start, end)
        out, marks_of = [], (-1, None)
        for w, t, e in zip(where.tolist(), term.tolist(), edits.tolist()):
            r, base = int(row[w]), int(offsets[row[w]])
            text = low[r]
            surface = text[start[w] - base:end[w] - base]
            if marks_of[0] != r:
                marks_of = (r, _quoted(text))
            factor = QUOTED if _inside_quotes(marks_of[1], int(start[w]) - base) else 1.0
            near = {text[start[i] - base:end[i] - base] for i in range(max(0, w - WINDOW), min(len(row), w + WINDOW + 1))
                    if i != w and row[i] == r and end[i] - start[i] < 20}
            if near & REPORTING:
                factor *= REPORTED
            if near & ADDRESS:
                factor *= ADDRESSED
            out.append((r, surface, t, e, factor))
        return count, out


def _sample(df: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled training documents, chosen by a hash of the id: (id, label, text)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) \
        .groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("key"), F.lit(seed)), "key").limit(rows)
    return df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(chosen), "key")  # at most ``rows`` pairs of numbers


STEMS = (4, 5, 6, 7)  # lengths of stems
PRINTS = 8  # least hashes of a document; near copies share one


def _fingerprints(sample: DataFrame) -> DataFrame:
    """(key, prints) of the sample: least hashes of the words' runs of three under ``PRINTS`` orders."""
    def run(batches):
        hasher = Words()
        for batch in batches:
            for part in slices(batch, "text", PART):
                row, start, end, data, _ = hasher.split(part.column("text"))
                h = hasher.hashes(start, end, data)
                at = np.searchsorted(row, np.arange(len(part) + 1))
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    w = h[a:b]
                    runs = w[:-2] * np.uint64(31) + w[1:-1] * np.uint64(17) + w[2:] if len(w) > 2 else w
                    out.append([int(mix(runs + np.uint64(i * 0x9E3779B1)).min().astype(np.int64)) for i in range(PRINTS)] if len(w) else [])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.list_(pa.int64()))], names=["key", "prints"])

    return sample.select("key", "text").mapInArrow(run, "key long, prints array<long>")


def _groups(prints: list[tuple[int, list[int]]]) -> dict[int, int]:
    """Document -> a number that near copies share; union by common fingerprints. Bounded by the sample."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for key, values in prints:
        for i, v in enumerate(values):
            root[find(("print", i, v))] = find(("doc", key))
    number: dict = {}
    return {key: number.setdefault(find(("doc", key)), len(number)) for key, _ in prints}


def _term_counts(sample: DataFrame, groups: dict[int, int]) -> DataFrame:
    """For every word and stem ("ab*") of the sample: in how many toxic and other documents it is; near copies count once."""
    shared = share(sample.sparkSession, groups)

    def run(batches):
        group = shared_value(shared)
        space, trim = _tables()
        for batch in batches:
            for part in slices(batch, "text", PART):
                texts = [t or "" for t in part.column("text").to_pylist()]
                chars, row, start, end, offsets, low = split_chars(texts, space, trim)
                at = np.searchsorted(row, np.arange(len(texts) + 1))
                out: list[tuple[str, int, int]] = []
                for i, (key, label) in enumerate(zip(part.column("key").to_pylist(), part.column("label").to_pylist())):
                    base = int(offsets[i])
                    spans = zip((start[at[i]:at[i + 1]] - base).tolist(), (end[at[i]:at[i + 1]] - base).tolist())
                    words = {w for w in (low[i][a:b] for a, b in spans) if 2 < len(w) <= 30 and w.isalpha()}
                    words |= {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                    out += [(w, group[key], label) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                                  pa.array([x[2] for x in out], pa.int32())], names=["word", "near", "label"])

    found = sample.mapInArrow(run, "word string, near long, label int")
    return found.distinct().groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))


def _covered(word: str, chosen: Container[str]) -> bool:
    stem = word.removesuffix("*")
    return any(stem[:n] + "*" in chosen for n in range(1, len(stem) + 1))


def _choose(rows: list[tuple[str, int]], most: int | None = None) -> list[str]:
    """Terms from (candidate, toxic documents), surest first: nothing a chosen stem already covers, and no stem that
    finds hardly more than a longer term that is chosen."""
    chosen: dict[str, int] = {}
    longer: dict[str, int] = {}  # beginning -> most documents of a chosen term that begins so
    for word, toxic in rows:
        stem = word.removesuffix("*")
        if _covered(word, chosen):
            continue
        if word.endswith("*") and toxic <= 1.1 * longer.get(stem, -1):
            continue
        chosen[word] = toxic
        for n in range(1, len(word) + 1):
            longer[word[:n]] = max(toxic, longer.get(word[:n], toxic))
        if len(chosen) == most:
            break
    return list(chosen)


def _beside(rows: list[tuple[str, int]], chosen: list[str]) -> list[str]:
    """The candidate words that a chosen stem covers and that may be misspelt: a stem allows no edit, they do."""
    stems = set(chosen)
    return [word for word, _ in rows if tolerance(word) and word not in stems and _covered(word, stems)]


def learn(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = 10_000, seed: int = 5) -> Model:
    """Fits lexicon, innocent words and weights on at most ``fit_rows`` labelled documents outside the held-out fold.

    A term is a word or a stem whose log odds of being in a toxic document, less 2.5 standard errors, exceed log 4;
    all that pass are taken but for stems and words that add nothing (``_choose``), and beside a stem the words it covers that pass too, for their misspellings. An innocent word is within tolerance of a term but seen about as often in
    other documents; a term with ``CROWD`` innocent words around it is matched exactly only. What reaches the driver is bounded by the sample's words. Without labels nothing is learned and every
    score is 0.5; without a term it is the share of toxic labels.
    """
    small_batches(df.sparkSession)
    sample = materialize(_sample(df, labels, label_col, id_col, text_col, fit_rows, seed), "toxicity-sample")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        return Model()
    odds = F.log(((F.col("toxic") + 0.5) / (n1 + 1.0)) / ((F.col("other") + 0.5) / (n0 + 1.0)))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    groups = _groups([(r.key, r.prints) for r in _fingerprints(sample).collect()])
    terms = (_term_counts(sample, groups).withColumn("sure", F.round(odds - 2.5 * error, 9)).filter(F.col("sure") > float(np.log(4)))
             .orderBy(F.desc("sure"), F.desc(F.length(F.rtrim("word", F.lit("*")))), "word").collect())
    candidates = [(r.word, r.toxic) for r in terms]
    chosen = _choose(candidates)
    model = Model(chosen + _beside(candidates, chosen))
    shared = share(df.sparkSession, Lexicon(model.terms))

    def run(batches):
        scanner = Scanner(shared_value(shared, Lexicon, FuzzyLexicon))
        for batch in batches:
            for part in slices(batch, "text", PART):
                count, hits = scanner.hits([t or "" for t in part.column("text").to_pylist()])
                per: list[dict] = [{} for _ in range(len(part))]
                for r, surface, t, e, factor in hits:
                    per[r][(surface, t, e)] = per[r].get((surface, t, e), 0.0) + factor
                yield pa.RecordBatch.from_arrays([
                    part.column("label"), pa.array(count, pa.int64()),
                    pa.array([[{"word": w, "term": t, "edits": e, "factor": f} for (w, t, e), f in x.items()] for x in per],
                             pa.list_(pa.struct([("word", pa.string()), ("term", pa.int32()), ("edits", pa.int32()), ("factor", pa.float64())])))],
                    names=["label", "words", "hits"])

    seen = sample.select("label", "text").mapInArrow(
        run, "label int, words long, hits array<struct<word:string,term:int,edits:int,factor:double>>").collect()
    near: dict[tuple[str, str], list[int]] = {}
    for r in seen:
        for h in r.hits:
            if h.edits:
                near.setdefault((h.word, model.terms[h.term]), [0, 0])[r.label] += 1
    innocent = [k for k, (c0, c1) in near.items() if c0 and (c1 + 0.5) / (n1 + 1) < 4 * (c0 + 0.5) / (n0 + 1)]
    crowd = Counter(term for _, term in innocent)
    model.strict = frozenset(term for term, n in crowd.items() if n >= CROWD)
    model.innocent = frozenset(w for w, term in innocent if term not in model.strict)
    abuse = np.array([sum(EDIT_WEIGHT[h.edits] * h.factor for h in r.hits
                          if not h.edits or h.word not in model.innocent and model.terms[h.term] not in model.strict)
                      for r in seen])
    words, label = np.array([r.words for r in seen], float), np.array([r.label for r in seen], float)
    model.weights = _fit(_inputs(abuse, words), label)
    return model


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are not negative, the constant is free."""
    use = [0, 1, 2]
    while True:
        w = np.zeros(len(use))
        part = x[:, use]
        penalty = ridge * np.diag([1e-3] + [1.0] * (len(use) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + penalty + 1e-9 * np.eye(len(use)),
                                   part.T @ (y - p) - penalty @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            full = np.zeros(3)
            full[use] = w
            return tuple(float(v) for v in full)
        use.pop(1 + int(np.argmin(w[1:])))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_below: float | None = None) -> DataFrame:
    """Toxicity of every whole text; no shuffle.

    Every word is matched against the lexicon with its tolerance. A hit weighs 1, 0.8 or 0.6 by its edits, times
    ``QUOTED`` between quotation marks, ``REPORTED`` near a word that reports speech, ``ADDRESSED`` near one that
    addresses somebody; the document's sum and its density go through the fitted weights.

    Without ``keep_below``: (id, score, hits). With it: the rows of ``df`` with a score below, all columns kept. A model without a
    term tells no document from another and rejects none.
    Null and empty texts have no hit; a null id stays null; repeated rows are scored each; an empty table gives no row;
    other columns are never read for the score.
    """
    if keep_below is not None and not model.terms:
        return df
    small_batches(df.sparkSession)
    shared = share(df.sparkSession, (Lexicon(model.terms, model.strict), model))

    def scores(texts: list[str], scanner: Scanner, fitted: Model):
        count, hits = scanner.hits(texts)
        abuse, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for r, surface, _, e, factor in hits:
            if not e or surface not in fitted.innocent:
                abuse[r] += EDIT_WEIGHT[e] * factor
                n[r] += 1
        return fitted.score(abuse, count), n

    def run(batches):
        lexicon, fitted = shared_value(shared, Lexicon, FuzzyLexicon, Model)
        scanner = Scanner(lexicon)
        for batch in batches:
            for part in slices(batch, text_col, PART):
                s, n = scores([t or "" for t in part.column(text_col).to_pylist()], scanner, fitted)
                if keep_below is None:
                    yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(s), pa.array(n)], names=[id_col, "score", "hits"])
                else:
                    yield part.filter(pa.array(s < keep_below))

    if keep_below is not None:
        return df.mapInArrow(run, df.schema)
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)) \
        .mapInArrow(run, f"`{id_col}` long, score double, hits long")
