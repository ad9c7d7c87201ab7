"""Similarity join of documents on word n-grams: vertical partitioning of the global n-gram order."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from raresift.llm.components import connected_components
from raresift.llm.frames import arrow_rows, materialize
from raresift.llm.words import Words, mix, shingle_sets, slices

FRAGMENTS = 8  # cuts of the n-gram order for counting overlaps
ENTRIES = 1 << 18  # prefix entries per flush of a task
BUCKET = 1 << 20  # prefix entries of a bucket
PART = 1 << 20  # bytes of text whose sets are held together
SPLIT = 16  # parts of a hot n-gram's rows when their number is joined to them
PROFILE = 64  # fragments of the n-gram order in a set's profile
LIST = 64  # about so many sets in a list of one n-gram
OWN_LIST = 64  # a component with so many sets under an n-gram has lists of its own
SHARED = -(1 << 63)  # stands for the components that share lists
LISTED = 1 << 22  # at most so many ids (32 MB) are broadcast to filter a scan


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class _Sets:
    """n-gram sets of an Arrow batch: offsets of each row's sorted hashes, and two digests of each set."""

    def __init__(self, k: int):
        self.k, self.words = k, Words("space")

    def __call__(self, part, text_col: str):
        row, start, end, data, _ = self.words.split(part.column(text_col))
        r, h = shingle_sets(row, self.words.hashes(start, end, data), len(part), self.k)
        at = np.searchsorted(r, np.arange(len(part) + 1))
        ones, twos = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x51ED27, 0xA2C79B3))
        return at, h, _signed(mix(ones[at[1:]] - ones[at[:-1]])), _signed(twos[at[1:]] - twos[at[:-1]])


def document_sets(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sid, proof): size of every row's n-gram set and two digests of it; sid is null for an empty set."""
    def run(batches):
        sets = _Sets(k)
        for batch in batches:
            for part in slices(batch, "text", PART):
                at, _, one, two = sets(part, "text")
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, mask=n == 0), pa.array(two)],
                                                 names=["doc_id", "n_shingles", "sid", "proof"])

    return _documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, sid long, proof long")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _need(n, num: int, den: int):
    """Least overlap of a set of size n with any set it links with: ceil(num * n / den)."""
    return (num * n + den - 1) // den


def _extra(n, num: int, den: int):
    """Common n-grams asked of two extended prefixes: half the plain prefix, one at least."""
    return np.maximum(1, (n - _need(n, num, den) + 1) // 2)


def _repeated(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(sid) of sets that may link with another: enough of the extended prefix occurs in other sets' prefixes.

    The prefix is the first n - need + extra n-grams of the set in hash order. Two linked sets have at least the smaller
    ``extra`` in common there. A task sends every n-gram once, however many of its sets have it, and the counts of
    those sets beside it, so a frequent n-gram arrives at most once per task.
    """
    def run(batches):
        from pyspark import TaskContext

        sets, seen = _Sets(k), np.zeros(0, np.int64)  # sorted digests of sets already sent
        fresh: set[int] = set()
        hashes, sids, held = [], [], 0
        turn = TaskContext.get().partitionId()

        def flush():
            h, s = np.concatenate(hashes), np.concatenate(sids)
            order = np.lexsort((s, h))
            h, s = h[order], s[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            again = np.bincount(group)[group] > 1  # in two sets of this task
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            h, s, bucket, known = h[first], s[first], bucket[first], s[again]
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            use = np.flatnonzero(np.diff(cut))
            rows = [(int(b), h[cut[b]:cut[b + 1]].tobytes(), s[cut[b]:cut[b + 1]].tobytes()) for b in use.tolist()]
            if len(known):  # counts travel in their own rows
                rows += [(int((turn + i) % buckets), b"", x.tobytes()) for i, x in enumerate(np.array_split(np.sort(known), max(1, len(known) // ENTRIES)))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                              names=["bucket", "h", "s"])

        for batch in batches:
            for part in slices(batch, "text", PART):
                at, h, sid, _ = sets(part, "text")
                n = np.diff(at)
                take = np.minimum(n, n - _need(n, num, den) + _extra(n, num, den))
                if len(fresh) >= 4096 and len(seen) < ENTRIES:  # copies within a task are sent once, as far as remembered
                    seen, fresh = np.sort(np.concatenate([seen, np.fromiter(fresh, np.int64)])), set()
                sent = seen[np.minimum(np.searchsorted(seen, sid), len(seen) - 1)] == sid if len(seen) else np.zeros(len(part), bool)
                for i in np.flatnonzero((n > 0) & ~sent).tolist():
                    if int(sid[i]) not in fresh:
                        if len(fresh) < 4096:
                            fresh.add(int(sid[i]))
                        hashes.append(h[at[i]:at[i] + take[i]])
                        sids.append(np.full(take[i], sid[i], np.int64))
                        held += int(take[i])
                if held >= ENTRIES:
                    yield flush()
                    hashes, sids, held = [], [], 0
        if held:
            yield flush()

    def count(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        h, s = np.frombuffer(b"".join(df["h"]), np.uint64), np.frombuffer(b"".join(df.loc[df["h"].str.len() > 0, "s"]), np.int64)
        known = np.frombuffer(b"".join(df.loc[df["h"].str.len() == 0, "s"]), np.int64)
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[new], s[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        again = np.bincount(group)[group] > 1 if len(h) else first
        found, n = np.unique(np.concatenate([s[again], known]), return_counts=True)
        return pd.DataFrame({"sid": found, "n": n})

    parts = docs.mapInArrow(run, "bucket int, h binary, s binary")
    return parts.groupBy("bucket").applyInPandas(count, "sid long, n long").groupBy("sid").agg(F.sum("n").alias("common"))


def _fetch(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, n, h): the n-grams of the wanted sets (sid, doc_id, n), one row each. A bounded list of ids filters the scan; beyond the bound
    the join alone does."""
    few = wanted.select("doc_id").limit(LISTED + 1).toArrow().column(0).to_numpy() if wanted.count() <= LISTED else None
    listed = docs.sparkSession.sparkContext.broadcast(np.sort(few)) if few is not None else None

    def run(batches):
        ids = listed.value if listed is not None else None
        sets = _Sets(k)
        for batch in batches:
            if ids is not None:
                own = batch.column("doc_id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
                batch = batch.filter(pa.array(ids[at] == own if len(ids) else np.zeros(len(own), bool)))
            for part in slices(batch, "text", PART):
                at, h, sid, _ = sets(part, "text")
                values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(h)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sid), values], names=["doc_id", "sid", "h"])

    sets = docs.mapInArrow(run, "doc_id long, sid long, h array<long>")
    # equal rows give equal sets, so any of them will do
    return sets.join(wanted, ["doc_id", "sid"]).groupBy("sid").agg(F.first("n").alias("n"), F.first("h").alias("h"))


def _overlaps(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: common n-grams are counted fragment by fragment and summed per pair."""
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("h").alias("ha"))
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("h").alias("hb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]) \
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("common"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")) \
        .filter(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b")


def _fits(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _described(kept: DataFrame) -> DataFrame:
    """(sid, n, c, profile, prefix) of sets given with their frequency-ordered common n-grams: how many those are, their numbers
    in ``PROFILE`` fragments of the n-gram order (a byte each, at most 255), and the prefix. N-grams of one set come first and are left out."""
    def run(batches):
        for b in batches:
            g = b.column("g")
            at = g.offsets.to_numpy().astype(np.int64) - g.offsets[0].as_py()
            h = g.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            n, c, need = b.column("n").to_numpy(), np.diff(at), b.column("need").to_numpy()
            row = np.repeat(np.arange(len(c)), c)
            cell = row * PROFILE + (h >> np.uint64(64 - (PROFILE - 1).bit_length())).astype(np.int64)
            sizes = np.minimum(np.bincount(cell, minlength=len(c) * PROFILE), 255).astype(np.uint8).reshape(len(c), PROFILE)
            take = np.clip(n - need + 1 - (n - c), 0, c)
            first = np.arange(len(h)) - np.repeat(at[:-1], c) < take[row]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(h[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("n"), pa.array(c, pa.int64()), pa.array([x.tobytes() for x in sizes], pa.binary()), prefix],
                                             names=["sid", "n", "c", "profile", "prefix"])

    return kept.mapInArrow(run, "sid long, n long, c long, profile binary, prefix array<long>")


def _possible(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb), a < b, of sets in two lists x1 and x2, of different components, that sizes and profiles allow to link.

    Sets have no more in common than the smaller number of each fragment, summed; where a number is 255 it may be more, so there the smaller
    count of all common n-grams is the bound.
    """
    def arrays(x):
        s = x.values
        profile = np.frombuffer(b"".join(s.field("profile").to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)
        return (*(s.field(f).to_numpy() for f in ("sid", "n", "c", "comp")), profile, (profile == 255).any(axis=1))

    def run(batches):
        for batch in batches:
            for one, two in zip(batch.column("x1"), batch.column("x2")):
                (i, n, c, e, p, full), (j, m, d, f, q, full_2) = arrays(one), arrays(two)
                bound = np.minimum(c[:, None], d[None, :])
                total = n[:, None] + m[None, :]
                u, v = np.nonzero(((den + num) * bound >= num * total) & (e[:, None] != f[None, :]))
                keep = np.zeros(len(u), bool)
                for at in range(0, len(u), 1 << 15):
                    r, t = u[at:at + (1 << 15)], v[at:at + (1 << 15)]
                    shared = np.minimum(p[r], q[t]).sum(axis=1, dtype=np.int64)
                    keep[at:at + (1 << 15)] = ((den + num) * shared >= num * total[r, t]) | full[r] | full_2[t]
                u, v = u[keep], v[keep]
                low = i[u] < j[v]
                a, b, na, nb = (np.where(low, x, y) for x, y in ((i[u], j[v]), (j[v], i[u]), (n[u], m[v]), (m[v], n[u])))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb)], names=["a", "b", "na", "nb"])

    return lists.select("x1", "x2").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def similar_sets(docs: DataFrame, reps: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """Components (id, component_id) of the sets under links at the threshold; sets without a link may be missing.

    1. Sets whose prefix hardly occurs elsewhere drop out (``_repeated``).
    2. N-grams of the rest are counted; those of one set only can be in no overlap. A set with too few others drops out. The rest,
       ordered by frequency, give the prefix: linked sets share an n-gram of their prefixes.
    3. Per prefix n-gram every set is compared with three leaders, the first of which has the fewest n-grams of its own, so
       that edited copies link with it first of all; what links becomes components. Then all pairs of sets in different
       components are looked at in lists of bounded length, and those whose profiles allow a link are compared. Pairs inside a component need no
       comparison, so a group of n near copies costs about n of them, and no link that matters to a component is lost.
    Overlaps are counted per fragment of the n-gram order and summed per pair.
    """
    found = _repeated(docs, k, num, den, buckets)
    smallest = F.expr(f"({num} * n + {den - 1}) div {den}")
    least = F.expr(f"greatest(1, (low - ({num} * low + {den - 1}) div {den} + 1) div 2)")
    wanted = found.join(reps, "sid").withColumn("low", smallest).filter(F.col("common") >= least).select("sid", "doc_id", "n")
    wanted = materialize(wanted, "join-wanted")
    sets = materialize(_fetch(docs, wanted, k), "join-sets")

    grams = sets.select("sid", "n", F.explode("h").alias("h"))
    often = grams.groupBy("h").count().filter("count > 1")
    kept = grams.join(often, "h").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("count", "h"))).alias("g")) \
        .withColumn("need", smallest).filter(F.size("g") >= F.col("need"))
    kept = materialize(kept.select("sid", "n", "need", F.col("g.h").alias("g")), "join-kept")
    shift = 64 - (FRAGMENTS - 1).bit_length()
    segments = kept.select("sid", F.posexplode(F.array(*[F.filter("g", _in_fragment(f, shift)) for f in range(FRAGMENTS)])).alias("fragment", "h"))
    segments = materialize(segments.filter(F.size("h") > 0), "join-segments")  # read four times
    keys = materialize(_described(kept).select("sid", "n", "c", "profile", F.explode("prefix").alias("h")), "join-keys")

    own = F.col("n") - F.col("c")
    ranks = [F.struct(own.alias("r"), F.xxhash64("sid").alias("s")), F.struct((own * 50 / F.col("n")).cast("long").alias("r"), F.xxhash64("sid", F.lit(1)).alias("s")),
             F.struct(F.xxhash64("sid", F.lit(2)).alias("r"), F.lit(0).alias("s"))]
    led = keys.groupBy("h").agg(F.count("*").alias("m"), *[F.min(F.struct(r.alias("r"), "sid", "n")).alias(f"l{i}") for i, r in enumerate(ranks)])
    led = led.filter("m > 1").select("h", F.array(*[F.struct(f"l{i}.sid", f"l{i}.n") for i in range(len(ranks))]).alias("l"))
    pairs = keys.select("h", "sid", "n").join(led, "h").select("sid", "n", F.explode("l").alias("l"))
    one = materialize(_overlaps(_pairs(pairs, F.struct("sid", "n"), F.col("l"), num, den), segments, num, den), "join-links")
    groups = materialize(connected_components(one), "join-groups")
    mine = groups.select(F.col("id").alias("sid"), F.col("component_id").alias("comp"))

    now = keys.join(mine, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed = now.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("h")
    now = materialize(now.join(mixed, "h", "left_semi"), "join-open")
    # a list holds sets of one component, or sets that are a component each: the small ones share lists
    now = now.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(SPLIT)).cast("int"))
    now = _with_number(now, ["h", "comp"], OWN_LIST - 1).withColumn("own", F.when(F.col("m").isNotNull(), F.col("comp")).otherwise(SHARED))
    # sets that link differ in size by one step at most, so a long list is cut by size before it is cut by hash
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) if den > num else 1.0) + 1e-9).cast("int")
    now = _with_number(now.drop("m"), ["h", "own"], LIST).withColumn("band", F.when(F.col("m").isNotNull() & F.lit(den > num), step))
    lists = now.withColumn("salt", F.when(F.col("m").isNull(), 0).otherwise(F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / LIST)).cast("int"))) \
        .groupBy("h", "own", "band", "salt").agg(F.collect_list(F.struct("sid", "n", "c", "profile", "comp")).alias("x"), F.min("n").alias("low"), F.max("n").alias("high"))
    lists = materialize(lists, "join-lists")
    left, right = (lists.select("h", F.col("own").alias(f"o{i}"), F.coalesce("band", F.lit(-1)).alias(f"b{i}"), F.col("salt").alias(f"s{i}"), F.col("low").alias(f"l{i}"),
                                F.col("high").alias(f"g{i}"), F.col("x").alias(f"x{i}")) for i in (1, 2))
    once = F.struct("b1", "s1") <= F.struct("b2", "s2")
    sizes = (F.col("g1") * den >= F.col("l2") * num) & (F.col("g2") * den >= F.col("l1") * num)
    pairs = left.join(right, "h").filter(sizes & ((F.col("o1") < F.col("o2")) | ((F.col("o1") == SHARED) & (F.col("o2") == SHARED) & once)))
    with arrow_rows(docs.sparkSession, 256):  # two lists are some 20 KB
        two = materialize(_overlaps(_possible(pairs, num, den), segments, num, den), "join-links")
    if not two.head(1):
        return groups
    # the second links join components of the first
    for end in ("a", "b"):
        two = two.join(mine.withColumnRenamed("sid", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
    joined = materialize(connected_components(two), "join-groups").withColumnRenamed("id", "comp").withColumnRenamed("component_id", "to")
    # a set that only the second links reach is its own component before
    known = groups.select("id", F.col("component_id").alias("comp")).union(joined.select(F.col("comp").alias("id"), "comp")).distinct()
    return known.join(joined, "comp", "left").select("id", F.coalesce("to", "comp").alias("component_id"))


def _with_number(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows`` and m, how many rows have their keys, where that is over ``least``; else null. Rows meet the number of a frequent key in SPLIT parts, by
    their column part."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("m")).filter(F.col("m") > least)
    parts = often.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return rows.join(parts, [*keys, "part"], "left")


def _in_fragment(fragment: int, shift: int) -> Callable[[Column], Column]:
    return lambda h: F.shiftrightunsigned(h, shift) == fragment


def _pairs(df: DataFrame, one: Column, two: Column, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb), a < b, of sets whose sizes allow a link."""
    both = df.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q"))
    return both.filter((F.col("p.sid") != F.col("q.sid")) & _fits(F.col("p.n"), F.col("q.n"), num, den)) \
        .select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()


def _components(df: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """What ``join_components`` gives, with sid and a number of the component, c: components whose smallest id is the same differ in it."""
    with arrow_rows(df.sparkSession, 1024):  # a thousand texts are some MB
        return _components_of(df, k, num, den, id_col, text_col)


def _components_of(df: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    docs = _documents(df, id_col, text_col)
    table = materialize(document_sets(df, k, id_col, text_col), "join-documents")
    nodes = table.filter("sid is not null and doc_id is not null")
    reps = nodes.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.max("n_shingles").alias("n_max"),
                                    F.min("proof").alias("p0"), F.max("proof").alias("p1"))
    reps = materialize(reps, "join-reps")
    sums = reps.agg(F.sum(F.col("n")).alias("n"), F.max((F.col("p0") != F.col("p1")) | (F.col("n") != F.col("n_max"))).alias("bad")).first()
    if sums.bad:
        raise ValueError("two different n-gram sets have the same digest")
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sums.n or 0) // (4 * BUCKET) + 1)  # a prefix is less than a quarter of a set
    comps = similar_sets(docs.filter("doc_id is not null"), reps.select("sid", "doc_id", "n"), k, num, den, buckets) \
        .withColumnRenamed("id", "sid").withColumnRenamed("component_id", "c")
    named = reps.select("sid", "doc_id").join(comps, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    lowest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(lowest, "c").select("sid", "component_id", "c")
    named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return table.join(by_set, "sid", "left").select("doc_id", "n_shingles", named_id, "sid", "c")


def join_components(df: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a row's set holds its distinct k-word n-grams, or its whole
    sequence if it has fewer words. Rows link if den * intersection >= num * union, counted exactly on 64-bit hashes; component_id
    is the smallest doc_id reachable. Equal sets are one node from the start, found by their digest, so copies cost
    one number each. A second digest proves that equal digests mean equal sets; else the operator raises.

    Null and empty texts and texts of white space: n_shingles 0, linked with nothing (component_id is the own id). A null id
    stays null with component_id null and links nothing. Rows with the same id are separate rows. An empty table gives no row; other columns are ignored.
    """
    return _components(df, k, num, den, id_col, text_col).drop("sid", "c")


def first_of_groups(df: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of ``join_components``, of the smallest id; all columns are kept.

    Rows are kept by id and n-gram set: of an id with several texts each goes or stays with its own component, and of several sets of
    the smallest id the one with the smallest digest stays. Of several rows of one id and text one stays, the first by a hash of the
    whole row. Rows with a null id stay, all of them, and rows without a word stay but for that. Only the ids to drop are joined with the wide table; repeated
    ids alone are looked at row by row. A column of any name is kept.
    """
    found = materialize(_components(df, k, num, den, id_col, text_col), "join-result")
    known = found.filter("doc_id is not null")
    if not known.groupBy("doc_id").count().filter("count > 1").head(1):
        drop = known.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
        return df.join(drop, id_col, "left_anti")
    sets = materialize(known.select("doc_id", "sid", "c", "component_id").distinct(), "join-sets")  # a null sid for rows without a word
    repeated = materialize(known.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "join-repeated")
    drop = sets.filter("doc_id <> component_id").join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias(id_col)).distinct()
    several = repeated.select(F.col("doc_id").alias(id_col))
    digest = next(x for x in itertools.chain(["sid"], (f"sid{i}" for i in itertools.count())) if x not in df.columns)
    first = sets.filter("sid is not null and doc_id = component_id").groupBy("doc_id", "c").agg(F.min("sid").alias("first"))
    gone = sets.join(repeated, "doc_id", "left_semi").join(first, ["doc_id", "c"], "left") \
        .filter("sid is not null and (doc_id <> component_id or sid <> first)").select(F.col("doc_id").alias(id_col), "sid")
    rest = df.join(drop, id_col, "left_anti").join(several, id_col, "left_anti")
    marked = _with_sid(df.join(several, id_col, "left_semi"), k, text_col, digest)
    kept = marked.join(gone.withColumnRenamed("sid", digest), [id_col, digest], "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    one = kept.groupBy(F.col(id_col).alias("i"), F.col(text_col).alias("t")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("r"))
    return rest.unionByName(one.select("r.*"))


def _with_sid(df: DataFrame, k: int, text_col: str, name: str) -> DataFrame:
    """``df`` and the digest of each row's n-gram set, as in ``document_sets``."""
    def run(batches):
        sets = _Sets(k)
        for batch in batches:
            for part in slices(batch, text_col, PART):
                at, _, one, _ = sets(part, text_col)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(one, mask=np.diff(at) == 0)], names=[*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))
