"""Exact k-nearest-neighbour search as a distance join.

A small data side (rows and bytes checked) is broadcast and every query row is answered where it
stands; a small query side is broadcast and the data is scanned, at large sizes after growing samples
that bound each query. Data of at most BROADCAST_BYTES is cut into cells and broadcast with their tree: a query looks into
its own cell and then into those within its bound, where it stands, so nothing is shuffled. Otherwise the data is cut into
cells of BLOCK_ROWS by median splits of a bounded sample, and rows travel in packed tables, one per cell and million rows:

1. each query row, whole, meets its own cell, searched there by a tree of small cells; that gives its list and a bound;
2. only a query whose bound reaches the bounding box of another cell is sent there, with its features alone,
   and its lists are merged.

Beyond MAX_CELLS cells every cell has a tree of its own, so blocks stay local at any size.
A cell is compared in numpy and gives back at most k rows per query, so pairs are never
materialised. Rows at the same point keep only their first ids, which bounds groups of copies; a
hot cell is answered by several query groups. Results are ordered by (squared distance, id) and
are exact: bounds use the same floating-point sums as the distances.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raresift.sources.storage import materialize

BROADCAST_ROWS = 16384
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 1 << 17  # rows of a cell of data beyond a broadcast
QUERY_ROWS = 1 << 19  # queries that meet a copy of such a cell
GROUPS = 4  # groups of queries for every core, where they are not smaller than the next number
GROUP_ROWS = 4096
DEEP_BLOCK_ROWS = 2048  # the same for the two levels of cells
DEEP_QUERY_ROWS = 16384
PACK_ROWS = 1 << 20  # rows that a task sorts by cell and packs together
LEAF_ROWS = 256  # rows of a cell of broadcast data
LEAF_QUERIES = 1 << 16  # queries answered together from broadcast cells
MAX_CELLS = 65536
SAMPLE_ROWS = 262144
SAMPLE_BYTES = 128 << 20
FEW_SAMPLE = 1 << 21  # rows of the first pass over the data when the queries are few
FEW_STEP = 1024  # how many times more rows each later pass reads
MAX_REACH = 4096  # cells a query may be sent to, on average
_CHUNK_CELLS = 1 << 18


def _matrix(table, names: list[str]) -> np.ndarray:
    """Feature columns as rows of a (dimensions, rows) array."""
    out = np.empty((len(names), table.num_rows))
    for i, n in enumerate(names):
        col = table.column(n)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        out[i] = col.to_numpy(zero_copy_only=False)
    return out


def _pair_distances(q: np.ndarray, d: np.ndarray, r: np.ndarray, c: np.ndarray, p: int) -> np.ndarray:
    """Sum of squared (p=2) or absolute (p=1) differences of given pairs, added in column order."""
    acc = np.zeros(len(r))
    for i in range(q.shape[0]):
        diff = q[i][r] - d[i][c]
        acc += np.abs(diff) if p == 1 else diff * diff
    return acc


def _screen(q: np.ndarray, d: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(t, base, slack): t + base[:, None] is within slack of the distance of every pair."""
    if p == 1:
        t = np.zeros((q.shape[1], d.shape[1]))
        for i in range(q.shape[0]):
            t += np.abs(q[i][:, None] - d[i][None, :])
        top = np.abs(q).sum(axis=0).max(initial=0.0) + np.abs(d).sum(axis=0).max(initial=0.0)
        return t, np.zeros(q.shape[1]), 1e-14 * len(q) * top
    base, norm = (q * q).sum(axis=0), (d * d).sum(axis=0)
    t = np.hstack([-2.0 * q.T, np.ones((q.shape[1], 1))]) @ np.vstack([d, norm])
    return t, base, 1e-14 * len(q) * (base.max(initial=0.0) + norm.max(initial=0.0))


def _nearest(q, d, k, p, q_ids=None, d_ids=None, bound=None):
    """(query index, data index, distance) of the k nearest data rows, data sorted by id.

    Pairs are screened with a matrix product; the ones that can be within the k-th distance get
    their exact distance. Ids are compared to leave out the query row itself; ``bound`` skips
    anything farther.
    """
    n, m = q.shape[1], d.shape[1]
    if n == 0 or m == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    centre = d.mean(axis=1, keepdims=True)
    qc, dc = q - centre, d - centre
    need = k if q_ids is None else k + 1
    step = max(1, _CHUNK_CELLS // m)
    stride = max(1, m // int(np.sqrt(20.0 * need * m)))
    rows, cols, dists = [], [], []
    for lo in range(0, n, step):
        t, base, slack = _screen(qc[:, lo:lo + step], dc, p)
        if bound is not None:
            limit = bound[lo:lo + step] - base
        elif m <= need:
            limit = np.full(len(base), np.inf)
        else:
            sub = t[:, ::stride] if -(-m // stride) >= need else t
            limit = np.partition(sub, need - 1, axis=1)[:, need - 1]
        r, c = np.divmod(np.flatnonzero(t <= (limit + 2 * slack)[:, None]), m)
        v = _pair_distances(q[:, lo:lo + step], d, r, c, p)
        ok = np.ones(len(r), bool) if bound is None else v <= bound[lo:lo + step][r]
        if q_ids is not None:
            ok &= d_ids.get_indexer(q_ids[lo:lo + step])[r] != c
        r, c, v = r[ok], c[ok], v[ok]
        order = np.lexsort((v, r))
        r, c, v = r[order], c[order], v[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        rows.append(r[keep] + lo)
        cols.append(c[keep])
        dists.append(v[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _finite(df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """Features as doubles; a null, NaN or infinite one is an error that names the column and the row.

    One such value would otherwise spoil the distances of every row it is compared with.
    """
    def checked(c: str) -> Column:
        x = F.col(c).cast("double")
        fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        message = F.concat(F.lit(f"feature {c} of row "), F.coalesce(F.col(row_id).cast("string"), F.lit("null")),
                           F.lit(" is not a finite number: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))
        return F.when(fine, x).otherwise(F.raise_error(message).cast("double"))

    return df.withColumns({c: checked(c) for c in features})


def _row_bytes(df: DataFrame) -> int:
    """Rough width of a row; nested columns are counted when they have been read."""
    sizes = {"double": 8, "bigint": 8, "int": 4, "float": 4, "boolean": 1, "string": 40}
    return sum(sizes.get(t, 64) for _, t in df.dtypes)


def _small_side(df: DataFrame, rows: int) -> pa.Table | None:
    """The whole table if it has at most ``rows`` rows and BROADCAST_BYTES bytes, else None; never reads much more."""
    most = min(rows, BROADCAST_BYTES // _row_bytes(df))
    if most > BROADCAST_ROWS and _more_than(df, most):  # every task would send that many whole rows
        return None
    found = df.limit(most + 1).toArrow()
    return found if found.num_rows <= most and found.nbytes <= BROADCAST_BYTES else None


def _more_than(df: DataFrame, rows: int) -> bool:
    return df.select(F.lit(1)).limit(rows + 1).count() > rows


def _spread(df: DataFrame, row_id: str) -> DataFrame:
    """The table in enough tasks for heavy work: dealt out anew only if its files are fewer than the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), row_id)


def _id_index(ids):
    import pandas as pd

    return pd.Index(ids)


def _neighbour_type(d: DataFrame, row_id: str, payload: list[str]) -> T.StructType:
    fields = [T.StructField("dist", T.DoubleType()), T.StructField("id", d.schema[row_id].dataType)]
    fields += [T.StructField(c, d.schema[c].dataType) for c in payload]
    return T.StructType(fields)


def _struct_array(dist: np.ndarray, data: pa.Table, idx: np.ndarray, row_id: str, payload: list[str]) -> pa.StructArray:
    picked = data.select([row_id, *payload]).take(pa.array(idx)).combine_chunks()
    arrays = [pa.array(dist)]
    for c in [row_id, *payload]:
        col = picked.column(c)
        arrays.append(col.chunk(0) if col.num_chunks else pa.array([], col.type))
    return pa.StructArray.from_arrays(arrays, names=["dist", "id", *payload])


def _answer_small(q: DataFrame, sides: dict[str, tuple[pa.Table, T.StructType]], k: int, features: list[str], row_id: str,
                  payload: list[str], exclude_self: bool, p: int) -> DataFrame:
    """Neighbours in one or several small tables, each as a column of its name, in one pass over the queries."""
    spark = q.sparkSession
    shared = spark.sparkContext.broadcast({n: d.sort_by(row_id) for n, (d, _) in sides.items()})
    q = _spread(q, row_id)
    out = T.StructType(q.schema.fields + [T.StructField(n, T.ArrayType(e)) for n, (_, e) in sides.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        matrices = {n: _matrix(d, features) for n, d in tables.items()}
        places = {n: _id_index(d.column(row_id).to_pandas()) if exclude_self else None for n, d in tables.items()}
        for batch in batches:
            qm = _matrix(batch, features)
            ids = batch.column(row_id).to_pandas().to_numpy() if exclude_self else None
            columns = list(batch.columns)
            for n, data in tables.items():
                r, c, v = _nearest(qm, matrices[n], k, p, ids, places[n])
                offsets = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), _struct_array(v, data, c, row_id, payload)))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *tables])

    return q.mapInArrow(run, out)


def _answer_few(q: DataFrame, q_small: pa.Table, d: DataFrame, k: int, features: list[str], row_id: str,
                payload: list[str], exclude_self: bool, p: int, element: T.StructType, name: str) -> DataFrame:
    """Few queries, any amount of data: each task keeps the k best rows of every query, if they are within its bound.

    Large data is read in passes over growing samples; the k-th distance in one is the bound of the next, so a pass hands
    on about FEW_STEP * k rows per query, whatever its size. Only the bounds, one number per query, go to the driver.
    """
    total, bound = d.count(), None
    rows = FEW_SAMPLE
    while rows < total:
        every = max(2, total // rows)
        part = d.where(F.pmod(F.xxhash64(row_id), F.lit(every)) == 0).select(row_id, *features)
        found = _best_of_few(q_small, part, k, features, row_id, [], exclude_self, p, T.StructType(element.fields[:2]), bound)
        last = (_top(found, k).groupBy("_q").agg(F.count("*").alias("n"), F.max("dist").alias("b")).where(F.col("n") == k)).collect()
        limits = {r["_q"]: r["b"] for r in last}
        bound = np.array([limits.get(i, np.inf) for i in q_small.column(row_id).to_pylist()])
        rows *= FEW_STEP
    return _collected(q, _best_of_few(q_small, d, k, features, row_id, payload, exclude_self, p, element, bound), k, row_id, element, name)


def _best_of_few(q_small: pa.Table, d: DataFrame, k: int, features: list[str], row_id: str, payload: list[str],
                 exclude_self: bool, p: int, element: T.StructType, limits: np.ndarray | None) -> DataFrame:
    """Per task the k best rows of every query that are not farther than its limit."""
    shared = d.sparkSession.sparkContext.broadcast((q_small, limits))
    out = T.StructType([T.StructField("_q", d.schema[row_id].dataType), *element.fields])

    def run(batches):
        few, start = shared.value
        qm, q_ids = _matrix(few, features), few.column(row_id).to_pandas().to_numpy()
        best, bound = None, np.full(few.num_rows, np.inf) if start is None else start.copy()
        for batch in batches:
            data = pa.Table.from_batches([batch]).sort_by(row_id)
            d_ids = _id_index(data.column(row_id).to_pandas()) if exclude_self else None
            limit = bound if best is not None or start is not None else None
            r, c, v = _nearest(qm, _matrix(data, features), k, p, q_ids if exclude_self else None, d_ids, limit)
            block = _struct_array(v, data, c, row_id, payload)
            found = pa.table([pa.array(r), *block.flatten()], names=["_r", *element.fieldNames()])
            best = found if best is None else pa.concat_tables([best, found])
            best = best.sort_by([("_r", "ascending"), ("dist", "ascending"), ("id", "ascending")])
            rr = best.column("_r").to_numpy()
            at = np.arange(len(rr)) - np.searchsorted(rr, rr, side="left")
            best = best.take(pa.array(np.nonzero(at < k)[0]))
            full = at == k - 1
            bound[rr[full]] = best.column("dist").to_numpy()[at[at < k] == k - 1]
        if best is not None:
            ids = few.column(row_id).take(best.column("_r"))
            for b in pa.table([ids, *best.columns[1:]], names=out.fieldNames()).to_batches():
                yield b

    return _spread(d, row_id).mapInArrow(run, out)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_q").orderBy("dist", "id")
    return found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k)


def _collected(q: DataFrame, found: DataFrame, k: int, row_id: str, element: T.StructType, name: str) -> DataFrame:
    """Best k candidates per query as an ordered array on the query row."""
    top = _top(found, k)
    fields = [F.col(f) for f in element.fieldNames()]
    lists = top.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_rn", F.struct(*fields).alias("_e")))).alias("_l"))
    lists = lists.select(F.col("_q").alias(row_id), F.transform("_l", lambda e: e["_e"]).alias(name))
    empty = F.array().cast(T.ArrayType(element))
    return q.join(lists, row_id, "left").withColumn(name, F.coalesce(F.col(name), empty))


class _Cells:
    """Median splits of a sample: node i has children 2i+1 and 2i+2, leaves are the cells.

    Once the cells' bounds are known, every node carries the bounding box and size of its rows, and
    a query descends only into nodes that can matter.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.leaves = 1 << depth
        self.axis = np.zeros(self.leaves - 1, dtype=np.int64)
        self.cut = np.full(self.leaves - 1, np.inf)
        self._split(sample, 0, 0)

    def _split(self, s: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or s.shape[1] < 2:
            return
        axis = int(np.argmax(s.std(axis=1)))
        low = np.median(s[axis])
        low = low if low < s[axis].max() else s[axis].min()
        self.axis[node], self.cut[node] = axis, low
        right = s[axis] > low
        self._split(s[:, ~right], 2 * node + 1, level + 1)
        self._split(s[:, right], 2 * node + 2, level + 1)

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(x.shape[1], dtype=np.int64)
        columns = np.arange(x.shape[1])
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[self.axis[node], columns] > self.cut[node])
        return node - (self.leaves - 1)

    def measure(self, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray, block_rows: int) -> None:
        """Boxes and sizes of the cells, carried up to the root."""
        total = 2 * self.leaves - 1
        self.lo, self.hi = np.full((len(lo), total), np.inf), np.full((len(lo), total), -np.inf)
        self.size = np.zeros(total, dtype=np.int64)
        self.lo[:, self.leaves - 1:], self.hi[:, self.leaves - 1:], self.size[self.leaves - 1:] = lo, hi, sizes
        for node in range(self.leaves - 2, -1, -1):
            left, right = 2 * node + 1, 2 * node + 2
            self.lo[:, node] = np.minimum(self.lo[:, left], self.lo[:, right])
            self.hi[:, node] = np.maximum(self.hi[:, left], self.hi[:, right])
            self.size[node] = self.size[left] + self.size[right]
        self.blocks = np.maximum(1, -(-sizes // block_rows))

    def _near(self, x, r, node, p):
        acc = np.zeros(len(r))
        for i in range(x.shape[0]):
            v = x[i][r]
            gap = np.maximum(np.maximum(self.lo[i][node] - v, v - self.hi[i][node]), 0.0)
            acc += gap * gap if p == 2 else gap
        return acc

    def bound(self, x: np.ndarray, need: int, p: int) -> np.ndarray:
        """Distances within which at least ``need`` rows lie: the far corner of a node on each query's path."""
        n = x.shape[1]
        best, node, columns = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.arange(n)
        for level in range(self.depth + 1):
            total = np.zeros(n)
            for i in range(x.shape[0]):
                far = np.maximum(np.abs(x[i] - self.lo[i][node]), np.abs(x[i] - self.hi[i][node]))
                total += far * far if p == 2 else far
            best = np.where(self.size[node] >= need, np.minimum(best, total), best)
            if level < self.depth:
                node = 2 * node + 1 + (x[self.axis[node], columns] > self.cut[node])
        return best

    def reach(self, x: np.ndarray, bound: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, cell) of all cells whose box is not farther than the query's bound."""
        r, node = np.arange(x.shape[1]), np.zeros(x.shape[1], dtype=np.int64)
        for level in range(self.depth + 1):
            ok = (self.size[node] > 0) & (self._near(x, r, node, p) <= bound[r])
            r, node = r[ok], node[ok]
            if level < self.depth:
                r, node = np.repeat(r, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).ravel()
        return r, node - (self.leaves - 1)


def _first_copies(points, features: list[str], need: int) -> np.ndarray:
    """Rows that are among the first ``need`` of their point."""
    return points.select(features).to_pandas().groupby(features).cumcount().to_numpy() < need


class _Leaves:
    """Data rows in small cells: each query meets the cell it stands in, whose k-th distance bounds it, and then the cells within the bound."""

    def __init__(self, data: pa.Table, k: int, features: list[str], row_id: str, exclude_self: bool, p: int):
        self.k, self.features, self.row_id, self.exclude_self, self.p = k, features, row_id, exclude_self, p
        self.need = k + (1 if exclude_self else 0)
        data = data.sort_by(row_id).combine_chunks()
        self.rows = data.filter(pa.array(_first_copies(data, features, self.need))).combine_chunks()  # of a point only the first ids can be near
        x = _matrix(self.rows, features)
        tree = _Cells(x, int(np.clip(np.ceil(np.log2(max(self.rows.num_rows / LEAF_ROWS, 1))), 0, 16)))
        cell = tree.locate(x)
        self.order = np.argsort(cell, kind="stable")
        sizes = np.bincount(cell, minlength=tree.leaves)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        lo, hi = np.full((len(features), tree.leaves), np.inf), np.full((len(features), tree.leaves), -np.inf)
        for c in np.flatnonzero(sizes):
            own = x[:, self.order[self.starts[c]:self.starts[c + 1]]]
            lo[:, c], hi[:, c] = own.min(axis=1), own.max(axis=1)
        tree.measure(lo, hi, sizes, LEAF_ROWS)
        self.tree = tree

    def open(self) -> _Leaves:
        """Ready for queries; what this adds is not broadcast."""
        self.points = _matrix(self.rows, self.features)[:, self.order]
        self.ids = _id_index(self.rows.column(self.row_id).to_pandas()) if self.exclude_self else None
        return self

    def _compared(self, qm, r, cell, own, bound, known=None):
        """(query, data row, distance) of the nearest rows in pairs of query and cell, and of those already ``known``."""
        by = np.argsort(cell, kind="stable")
        r, cell = r[by], cell[by]
        ends = np.flatnonzero(np.diff(cell, append=-1)) + 1
        starts, found = self.starts, [] if known is None else [known]
        for a, b in zip([0, *ends[:-1]], ends):
            some, c = r[a:b], cell[a]
            i, j, v = _nearest(qm[:, some], self.points[:, starts[c]:starts[c + 1]], self.need, self.p, bound=None if bound is None else bound[some])
            found.append((some[i], self.order[starts[c] + j], v))
        i, j, v = (np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if own is not None:
            other = j != own[i]
            i, j, v = i[other], j[other], v[other]
        by = np.lexsort((j, v, i))
        i, j, v = i[by], j[by], v[by]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < self.k
        return i[first], j[first], v[first]

    def answered(self, batch, bound: np.ndarray | None = None):
        """(end, (query, data row, distance)) of one run of queries after the other; ``bound`` for queries from elsewhere."""
        qm, n, tree = _matrix(batch, self.features), batch.num_rows, self.tree
        own = self.ids.get_indexer(batch.column(self.row_id).to_pandas()) if self.exclude_self else None
        home = None
        if bound is None:
            home = tree.locate(qm)
            filled = np.flatnonzero(tree.size[home + tree.leaves - 1] > 0)
            i, j, v = self._compared(qm, filled, home[filled], own, None)
            bound = tree.bound(qm, self.need, self.p)
            ends = np.flatnonzero(np.diff(i, append=-1)) if len(i) else np.zeros(0, int)
            full = ends[ends - np.searchsorted(i, i[ends], side="left") == self.k - 1]
            bound[i[full]] = np.minimum(bound[i[full]], v[full])
        slice_rows = max(64, min(4096, (1 << 23) // tree.leaves))
        r, cell, known, done = [], [], None, 0
        for a in range(0, n, slice_rows):
            some, there = tree.reach(qm[:, a:a + slice_rows], bound[a:a + slice_rows], self.p)
            some += a
            if home is not None:  # its rows are known
                other = there != home[some]
                some, there = some[other], there[other]
            r.append(some)
            cell.append(there)
            if sum(len(c) for c in r) > 1 << 23 or a + slice_rows >= n:  # in parts, should boxes exclude little
                last = min(a + slice_rows, n)
                if home is not None:
                    part = slice(*np.searchsorted(i, [done, last]))
                    known = i[part], j[part], v[part]
                yield last, self._compared(qm, np.concatenate(r), np.concatenate(cell), own, bound, known)
                r, cell, done = [], [], last

    def lists(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, start: int, end: int, payload: list[str]) -> pa.ListArray:
        """The neighbours of queries ``start`` to ``end``."""
        offsets = pa.array(np.searchsorted(i, np.arange(start, end + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, _struct_array(v, self.rows, j, self.row_id, payload))


def _answer_cells(q: DataFrame, data: pa.Table, k: int, features: list[str], row_id: str, payload: list[str],
                  exclude_self: bool, p: int, element: T.StructType, name: str) -> DataFrame:
    """Data that fits a broadcast, in small cells: queries are answered where they stand."""
    # Packed with its class, since executors have no copy of this package.
    shared = q.sparkSession.sparkContext.broadcast(cloudpickle.dumps(_Leaves(data, k, features, row_id, exclude_self, p)))
    q = _spread(q, row_id)
    out = T.StructType(q.schema.fields + [T.StructField(name, T.ArrayType(element))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = cloudpickle.loads(shared.value).open()

        def whole(waiting):
            batch = pa.Table.from_batches(waiting).combine_chunks()
            done = 0
            for last, (i, j, v) in leaves.answered(batch):
                part = batch.slice(done, last - done).append_column(name, leaves.lists(i, j, v, done, last, payload))
                yield from part.to_batches(max_chunksize=10000)
                done = last

        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= LEAF_QUERIES:
                yield from whole(waiting)
                waiting, n = [], 0
        if waiting:
            yield from whole(waiting)

    return q.mapInArrow(run, out)


def _draw(ids: pa.Array, salt: int) -> np.ndarray:
    """Repeatable pseudo-random number per id."""
    import pandas as pd

    mixed = pd.util.hash_array(ids.to_pandas().to_numpy(), categorize=False) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return (mixed ^ (mixed >> np.uint64(33))) >> np.uint64(1)


def _packed(df: DataFrame, place, ends: list[str] = ()) -> DataFrame:
    """Rows as compressed tables of one (_cell, _part) each, with their number and the ends of the columns ``ends``.

    ``place(table)`` gives the rows to keep and their cells and parts. Packed rows cost a third of the shuffle of single ones.
    """
    sides = "".join(f", l{i} double, h{i} double" for i in range(len(ends)))

    def whole(waiting):
        rows, cell, part = place(pa.Table.from_batches(waiting).combine_chunks())
        order = np.lexsort((part, cell))
        rows, cell, part = rows.take(pa.array(order)).combine_chunks(), cell[order], part[order]
        last = np.flatnonzero((np.diff(cell, append=-1) != 0) | (np.diff(part, append=-1) != 0)) + 1
        first = np.concatenate([[0], last[:-1]]).astype(int)
        x = _matrix(rows, ends)
        low, high = np.minimum.reduceat(x, first, axis=1), np.maximum.reduceat(x, first, axis=1)
        for lo in range(0, len(first), 64):
            blobs = []
            for a, b in zip(first[lo:lo + 64], last[lo:lo + 64]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(rows.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            at = first[lo:lo + 64]
            columns = [pa.array(cell[at].astype(np.int32)), pa.array(part[at].astype(np.int32)), pa.array((last[lo:lo + 64] - at).astype(np.int32)),
                       pa.array(blobs, pa.binary())]
            names = ["_cell", "_part", "_n", "_rows"]
            for i in range(len(ends)):
                columns += [pa.array(low[i, lo:lo + 64]), pa.array(high[i, lo:lo + 64])]
                names += [f"l{i}", f"h{i}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield from whole(waiting)
                waiting, n = [], 0
        if waiting:
            yield from whole(waiting)

    return df.mapInArrow(run, f"_cell int, _part int, _n int, _rows binary{sides}")


def _meet(data: DataFrame, asked: DataFrame, parts: np.ndarray, work, leaves_of, out: T.StructType) -> DataFrame:
    """``work(leaves, cell, queries)`` for the packed queries of every cell, next to the cell's own data.

    A cell with many queries is met by several groups of them, each with a copy of its data.
    """
    spark = data.sparkSession
    hot = [(int(c), int(parts[c])) for c in np.flatnonzero(parts > 1)]
    if hot:
        times = F.broadcast(spark.createDataFrame(hot, "_cell int, _times int"))
        data = (data.join(times, "_cell", "left")
                .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_times", F.lit(1)) - 1))))
    columns = ["_cell", "_part", "_rows"]
    both = data.select(*columns, F.lit(0).alias("_kind")).unionByName(asked.select(*columns, F.lit(1).alias("_kind")))
    tasks = int(max(parts.sum(), spark.sparkContext.defaultParallelism))
    stream = both.repartition(min(tasks, 4096), "_cell", "_part").sortWithinPartitions("_cell", "_part", "_kind")

    def run(batches):
        at, held, leaves, waiting, n = None, [], None, [], 0
        for b in batches:
            for cell, part, blob, kind in zip(*[b.column(c) for c in (*columns, "_kind")]):
                here = (cell.as_py(), part.as_py())
                if here != at:
                    if waiting:
                        yield from work(leaves, at[0], pa.concat_tables(waiting).combine_chunks())
                    at, held, leaves, waiting, n = here, [], None, [], 0
                rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
                if kind.as_py() == 0:
                    held.append(rows)
                    continue
                if held:
                    leaves, held = leaves_of(pa.concat_tables(held)), []
                waiting.append(rows)
                n += rows.num_rows
                if n >= LEAF_QUERIES:
                    yield from work(leaves, at[0], pa.concat_tables(waiting).combine_chunks())
                    waiting, n = [], 0
        if waiting:
            yield from work(leaves, at[0], pa.concat_tables(waiting).combine_chunks())

    return stream.mapInArrow(run, out)


def _compare(q: DataFrame, d: DataFrame, k: int, features: list[str], row_id: str, payload: list[str],
             exclude_self: bool, p: int, element: T.StructType, bounded: bool) -> DataFrame:
    """Top k of every query within every block it was sent to; one row per kept neighbour."""
    out = T.StructType([T.StructField("_q", q.schema[row_id].dataType), *element.fields])
    names = out.fieldNames()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        right = right.sort_by(row_id).combine_chunks()
        ids = left.column(row_id).to_pandas().to_numpy() if exclude_self else None
        d_ids = _id_index(right.column(row_id).to_pandas()) if exclude_self else None
        bound = left.column("_bound").to_numpy() if bounded else None
        r, c, v = _nearest(_matrix(left, features), _matrix(right, features), k, p, ids, d_ids, bound)
        block = _struct_array(v, right, c, row_id, payload)
        q_ids = pc.take(left.column(row_id), pa.array(r))
        return pa.table([q_ids, *block.flatten()], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    keys = ["_cell", "_block", "_part"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(run, out)


def _answer_blocks(q: DataFrame, d: DataFrame, k: int, features: list[str], row_id: str,
                   payload: list[str], exclude_self: bool, p: int, element: T.StructType,
                   block_rows: int, query_rows: int, name: str, max_reach: int = MAX_REACH) -> DataFrame:
    spare = 1 if exclude_self else 0
    spark = q.sparkSession
    d = materialize(d, "knn-data")
    total = d.count()

    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (16 * len(features))))
    every = max(1, total // wanted)
    sample = (d.where(F.pmod(F.xxhash64(row_id), F.lit(every)) == 0).select(*features)
              .limit(2 * wanted).toArrow())
    sample = sample.filter(pa.array(_first_copies(sample, features, k + spare)))
    depth = int(np.clip(np.ceil(np.log2(max(total / block_rows, 1))), 0, np.log2(MAX_CELLS)))
    cells = _Cells(_matrix(sample, features), depth)
    if total > MAX_CELLS * block_rows:
        copies = Window.partitionBy(*features).orderBy(row_id)
        d = materialize(d.withColumn("_rn", F.row_number().over(copies)).where(F.col("_rn") <= k + spare).drop("_rn"), "knn-data")
        return _answer_deep(q, materialize(q.select(row_id, *features), "knn-query"), d, total, cells, k, features, row_id, payload, exclude_self, p,
                            element, min(block_rows, DEEP_BLOCK_ROWS), min(query_rows, DEEP_QUERY_ROWS), name, max_reach)
    # Packed with its class, since executors have no copy of this package.
    splits = spark.sparkContext.broadcast(cloudpickle.dumps(cells))

    def stored(rows):
        if not _first_copies(rows, features, k + spare).all():
            rows = rows.sort_by(row_id).combine_chunks()
            rows = rows.filter(pa.array(_first_copies(rows, features, k + spare))).combine_chunks()
        return rows, cloudpickle.loads(splits.value).locate(_matrix(rows, features)), np.zeros(rows.num_rows, int)

    data = materialize(_packed(d, stored, features), "knn-cells")
    # Cell statistics: at most MAX_CELLS rows, whatever the table size.
    lo, hi = np.full((len(features), cells.leaves), np.inf), np.full((len(features), cells.leaves), -np.inf)
    sizes = np.zeros(cells.leaves, dtype=np.int64)
    for s in data.groupBy("_cell").agg(F.sum("_n").alias("n"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(len(features))],
                                       *[F.max(f"h{i}").alias(f"h{i}") for i in range(len(features))]).collect():
        sizes[s["_cell"]] = s["n"]
        for i in range(len(features)):
            lo[i, s["_cell"]], hi[i, s["_cell"]] = s[f"l{i}"], s[f"h{i}"]
    cells.measure(lo, hi, sizes, block_rows)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(cells))

    def parts_of(rows: DataFrame, times: int) -> np.ndarray:
        """Groups of queries per cell; where queries are few, small enough that all cores have several."""
        out = np.ones(cells.leaves, dtype=np.int64)
        found = rows.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()
        fair = -(-sum(r["n"] for r in found) * times // (GROUPS * spark.sparkContext.defaultParallelism))
        for r in found:
            out[r["_cell"]] = max(1, -(-r["n"] * times // max(1, min(query_rows, max(fair, GROUP_ROWS)))))
        return out

    def leaves_of(rows):
        return _Leaves(rows, k, features, row_id, exclude_self, p).open()

    # Round 1: the own cell gives a list and a bound of the k-th distance. How many queries a cell has, for the groups, is told by a sixteenth.
    def located(batches):
        tree = cloudpickle.loads(shared.value)
        for b in batches:
            cell, n = np.unique(tree.locate(_matrix(b, features)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int32))], names=["_cell", "_n"])

    some = q.where(F.pmod(F.xxhash64(row_id), F.lit(16)) == 0).select(row_id, *features)
    parts = parts_of(some.mapInArrow(located, "_cell int, _n int"), 16)

    def homes(rows):
        cell = cloudpickle.loads(shared.value).locate(_matrix(rows, features))
        return rows, cell, np.arange(rows.num_rows) % parts[cell]

    extra = [T.StructField("_key", T.LongType()), T.StructField("_bound", T.DoubleType()), T.StructField("_cells", T.ArrayType(T.IntegerType()))]
    listed = T.StructField(name, T.ArrayType(element))
    from pyspark.sql.pandas.types import to_arrow_type

    list_type = to_arrow_type(listed.dataType)

    def at_home():
        tree, made = None, 0

        def work(leaves, cell, rows):
            nonlocal tree, made
            from pyspark import TaskContext

            tree = cloudpickle.loads(shared.value) if tree is None else tree
            x, done = _matrix(rows, features), 0
            nobody = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            for last, (i, j, v) in [(rows.num_rows, nobody)] if leaves is None else leaves.answered(rows):
                part, n = rows.slice(done, last - done), last - done
                near = pa.array([[]] * n, list_type) if leaves is None else leaves.lists(i, j, v, done, last, payload)
                here = x[:, done:last]
                bound = tree.bound(here, k + spare, p)
                ends = np.searchsorted(i, np.arange(done, last), side="right")
                full = np.flatnonzero(ends - np.searchsorted(i, np.arange(done, last)) == k)
                bound[full] = np.minimum(bound[full], v[ends[full] - 1])
                r, c = tree.reach(here, bound, p)
                r, c = r[c != cell], c[c != cell]
                offsets = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                key = (TaskContext.get().partitionId() << 40) + made + np.arange(n)
                made += n
                part = part.append_column(name, near).append_column("_key", pa.array(key, mask=np.diff(offsets) == 0))
                part = part.append_column("_bound", pa.array(bound, mask=np.diff(offsets) == 0)).append_column("_cells", pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int32))))
                yield from part.to_batches(max_chunksize=10000)
                done = last

        return work

    first = _meet(data, _packed(q, homes), parts, at_home(), leaves_of, T.StructType([*q.schema.fields, listed, *extra]))
    first = materialize(first, "knn-first")

    # Round 2: every other cell that can hold a neighbour within the bound.
    open_ = first.where(F.col("_key").isNotNull())
    sent = open_.select("_key", row_id, *features, "_bound", F.explode("_cells").alias("_cell"))
    counts = sent.groupBy("_cell").agg(F.count("*").alias("_n"))
    parts = parts_of(counts, 1)
    asked = first.count()
    reached = asked + open_.agg(F.sum(F.size("_cells"))).first()[0] if open_.limit(1).count() else asked
    if reached > max_reach * max(asked, 1):
        raise RuntimeError(f"{reached} (query, cell) pairs for {asked} queries: the features' boxes exclude too little; "
                           f"use fewer features or raise max_reach")
    if reached == asked:
        return first.select(*q.columns, name)

    def visiting(rows):
        cell = rows.column("_cell").to_numpy()
        return rows.drop_columns(["_cell"]), cell, np.arange(rows.num_rows) % parts[cell]

    def visit(leaves, cell, rows):
        done = 0
        for last, (i, j, v) in leaves.answered(rows, rows.column("_bound").to_numpy()):
            part = pa.table([rows.column("_key").slice(done, last - done), leaves.lists(i, j, v, done, last, payload)], names=["_key", name])
            some = np.zeros(last - done, bool)
            some[i - done] = True
            yield from part.filter(pa.array(some)).to_batches(max_chunksize=10000)
            done = last

    more = _meet(data, _packed(sent, visiting), parts, visit, leaves_of, T.StructType([extra[0], listed]))
    more = more.groupBy("_key").agg(F.flatten(F.collect_list(name)).alias("_more"))
    both = F.concat(F.col(name), F.coalesce("_more", F.array().cast(listed.dataType)))
    closed = first.where(F.col("_key").isNull()).select(*q.columns, name)
    return closed.unionByName(open_.join(more, "_key", "left").select(*q.columns, F.slice(F.array_sort(both), 1, k).alias(name)))


def _beside(rows: DataFrame, trees: DataFrame, work, out: T.StructType) -> DataFrame:
    """``work(tree, rows)`` for the rows (with _cell and _salt) of every cell next to the cell's own tree.

    A task gets each tree right before its rows, in one sorted stream, so neither all trees nor all rows of a cell are held.
    """
    both = rows.withColumn("_tree", F.lit(None).cast("binary")).unionByName(trees, allowMissingColumns=True)
    stream = both.repartition("_cell", "_salt").sortWithinPartitions("_cell", "_salt", F.col("_tree").isNull())

    def run(batches):
        tree = None
        for b in batches:
            at = np.flatnonzero(b.column("_tree").is_valid().to_numpy(zero_copy_only=False))
            for lo, hi in zip([0, *(at + 1)], [*at, b.num_rows]):
                if hi > lo:
                    yield from work(tree, b.slice(lo, hi - lo).drop_columns(["_tree"]))
                if hi < b.num_rows:
                    tree = cloudpickle.loads(b.column("_tree")[int(hi)].as_py())

    return stream.mapInArrow(run, out)


def _answer_deep(q: DataFrame, queries: DataFrame, d: DataFrame, total: int, coarse: _Cells, k: int, features: list[str], row_id: str,
                 payload: list[str], exclude_self: bool, p: int, element: T.StructType, block_rows: int, query_rows: int, name: str,
                 max_reach: int) -> DataFrame:
    """Two levels of cells for data beyond MAX_CELLS blocks: the tree of the coarse cells is on the driver, every coarse
    cell has a tree of its own for its blocks, kept as rows of a table and met by the cell's rows in the tasks."""
    import pandas as pd

    spare = 1 if exclude_self else 0
    depth = int(np.ceil(np.log2(total / (coarse.leaves * block_rows))))
    shared = d.sparkSession.sparkContext.broadcast(cloudpickle.dumps(coarse))
    salts = max(1, total // (coarse.leaves * (1 << 20)) + 1)
    place = [T.StructField("_cell", T.IntegerType()), T.StructField("_salt", T.IntegerType())]
    placed = [*place, T.StructField("_block", T.IntegerType())]

    def located(df: DataFrame) -> DataFrame:
        def run(batches):
            tree = cloudpickle.loads(shared.value)
            for b in batches:
                salt = _draw(b.column(row_id), 5) % np.uint64(salts)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.locate(_matrix(b, features)).astype(np.int32)), pa.array(salt.astype(np.int32))],
                                                 names=[*b.schema.names, "_cell", "_salt"])

        return df.mapInArrow(run, T.StructType(df.schema.fields + place))

    def salted(trees: DataFrame) -> DataFrame:
        return trees.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    # Trees of the coarse cells from a sample of some rows per block.
    every = max(1, total // (coarse.leaves * (16 << depth)))
    sample = located(d.where(F.pmod(F.xxhash64(row_id, F.lit(1)), F.lit(every)) == 0).select(row_id, *features))

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = _Cells(rows.sort_values(row_id)[features].to_numpy().T, depth)
        return pd.DataFrame({"_cell": [key[0]], "_tree": [cloudpickle.dumps(tree)]})

    trees = sample.groupBy("_cell").applyInPandas(split, "_cell int, _tree binary")
    # a cell without a sampled row has one block
    empty = cloudpickle.dumps(_Cells(np.zeros((len(features), 0)), depth))
    cells = d.sparkSession.range(coarse.leaves).select(F.col("id").cast("int").alias("_cell"))
    trees = materialize(cells.join(trees, "_cell", "left").withColumn("_tree", F.coalesce("_tree", F.lit(empty))), "knn-trees")

    def leaf(tree, b):
        block = tree.locate(_matrix(b, features)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=[*b.schema.names, "_block"])

    d = materialize(_beside(located(d), salted(trees), leaf, T.StructType(d.schema.fields + placed)), "knn-blocks")
    boxes = d.groupBy("_cell", "_block").agg(F.count("*").alias("n"), *[F.min(c).alias(f"l{i}") for i, c in enumerate(features)],
                                             *[F.max(c).alias(f"h{i}") for i, c in enumerate(features)])

    def measure(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = cloudpickle.loads(left["_tree"].iloc[0])
        lo, hi = np.full((len(features), tree.leaves), np.inf), np.full((len(features), tree.leaves), -np.inf)
        sizes = np.zeros(tree.leaves, dtype=np.int64)
        at = right["_block"].to_numpy()
        sizes[at] = right["n"]
        for i in range(len(features)):
            lo[i, at], hi[i, at] = right[f"l{i}"], right[f"h{i}"]
        tree.measure(lo, hi, sizes, block_rows)
        return pd.DataFrame({"_cell": [key[0]], "_tree": [cloudpickle.dumps(tree)], "n": [int(sizes.sum())]}
                            | {f"l{i}": [float(lo[i].min())] for i in range(len(features))} | {f"h{i}": [float(hi[i].max())] for i in range(len(features))})

    ends = ", ".join(f"l{i} double, h{i} double" for i in range(len(features)))
    trees = materialize(trees.groupBy("_cell").cogroup(boxes.groupBy("_cell")).applyInPandas(measure, f"_cell int, _tree binary, n long, {ends}"), "knn-trees")
    lo, hi = np.full((len(features), coarse.leaves), np.inf), np.full((len(features), coarse.leaves), -np.inf)
    sizes = np.zeros(coarse.leaves, dtype=np.int64)
    for r in trees.drop("_tree").collect():  # MAX_CELLS rows
        sizes[r["_cell"]] = r["n"]
        for i in range(len(features)):
            lo[i, r["_cell"]], hi[i, r["_cell"]] = r[f"l{i}"], r[f"h{i}"]
    coarse.measure(lo, hi, sizes, block_rows)
    boxed = d.sparkSession.sparkContext.broadcast(cloudpickle.dumps(coarse))
    trees = trees.select("_cell", "_tree")
    keys = ["_cell", "_block"]

    def compared(asked: DataFrame, fields: T.StructType, payload: list[str], bounded: bool) -> DataFrame:
        """A block with many queries is answered by several groups, each with a copy of the block."""
        hot = asked.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("_parts")).where("_parts > 1")
        parts = F.coalesce("_parts", F.lit(1))
        left = asked.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(row_id), parts).cast("int")).drop("_parts")
        right = d.drop("_salt").join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        return _compare(left, right, k, features, row_id, payload, exclude_self, p, fields, bounded)

    # Round 1: the block a query stands in.
    home = _beside(located(queries), salted(trees), leaf, T.StructType(queries.schema.fields + placed)).drop("_salt")
    near = compared(home, T.StructType(element.fields[:2]), [], False)
    first = near.groupBy("_q").agg(F.count("*").alias("_n"), F.max("dist").alias("_first"))
    bounded = queries.join(first.withColumnRenamed("_q", row_id), row_id, "left")
    bounded = bounded.select(row_id, *features, F.when(F.col("_n") >= k, F.col("_first")).alias("_bound"))
    asked = T.StructType(queries.schema.fields + [T.StructField("_bound", T.DoubleType())] + place)

    # Round 2: coarse cells within the bound, then their blocks within it.
    def cells_within(batches):
        tree = cloudpickle.loads(boxed.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                x = _matrix(b, features)
                bound = b.column("_bound").to_numpy(zero_copy_only=False).astype(float)
                open_ = np.nonzero(np.isnan(bound))[0]
                if len(open_):
                    bound[open_] = tree.bound(x[:, open_], k + spare, p)
                r, cell = tree.reach(x, bound, p)
                salt = _draw(b.column(row_id), 6)[r] % np.uint64(salts)
                rows = b.set_column(b.schema.get_field_index("_bound"), "_bound", pa.array(bound)).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32))],
                                                 names=[*rows.schema.names, "_cell", "_salt"])

    def blocks_within(tree, b):
        for start in range(0, b.num_rows, 4096):
            some = b.slice(start, 4096)
            r, block = tree.reach(_matrix(some, features), some.column("_bound").to_numpy(), p)
            rows = some.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(block.astype(np.int32))], names=[*rows.schema.names, "_block"])

    sent = _beside(bounded.mapInArrow(cells_within, asked), salted(trees), blocks_within, T.StructType(asked.fields + placed[2:]))
    sent = materialize(sent.drop("_salt"), "knn-sent")
    reached, n = sent.count(), queries.count()
    if reached > max_reach * max(n, 1):
        raise RuntimeError(f"{reached} (query, block) pairs for {n} queries: the features' boxes exclude too little; "
                           f"use fewer features or raise max_reach")
    return _collected(q, compared(sent, element, payload, True), k, row_id, element, name)


def with_neighbours(q: DataFrame, d: DataFrame, k: int, features: list[str], row_id: str = "row_id",
                    payload: list[str] | None = None, exclude_self: bool = False, p: int = 2,
                    name: str = "neighbours", broadcast_rows: int = BROADCAST_ROWS,
                    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, max_reach: int = MAX_REACH) -> DataFrame:
    """Add the k nearest rows of ``d`` to every row of ``q``.

    ``name`` becomes an array of struct(dist, id, payload...) ordered by (dist, id); ``dist`` is the
    squared Euclidean distance for p=2 and the Manhattan distance for p=1. Query ids must be unique.
    A feature that is null, NaN or infinite on either side is an error. A side is broadcast if it has at most
    ``broadcast_rows`` rows and BROADCAST_BYTES bytes. A query that would be sent to over ``max_reach`` cells on
    average is an error, as the search would compare nearly all pairs.
    """
    if p not in (1, 2):
        raise ValueError(f"Unsupported metric: p={p}")
    payload = payload or []
    q = _finite(q, features, row_id)
    d = _finite(d, features, row_id).select(row_id, *features, *[c for c in payload if c not in features])
    element = _neighbour_type(d, row_id, payload)
    small = _small_side(d, broadcast_rows)
    if small is not None:
        return _answer_small(q, {name: (small, element)}, k, features, row_id, payload, exclude_self, p)
    return _answer_large(q, d, k, features, row_id, payload, exclude_self, p, element, broadcast_rows, block_rows, query_rows, name, max_reach)


def _answer_large(q: DataFrame, d: DataFrame, k: int, features: list[str], row_id: str, payload: list[str], exclude_self: bool, p: int,
                  element: T.StructType, broadcast_rows: int, block_rows: int, query_rows: int, name: str, max_reach: int) -> DataFrame:
    few = _small_side(q.select(row_id, *features), broadcast_rows)
    if few is not None:
        return _answer_few(q, few, d, k, features, row_id, payload, exclude_self, p, element, name)
    held = _small_side(d, BROADCAST_BYTES) if _more_than(q, BROADCAST_ROWS) else None
    if held is not None:
        return _answer_cells(q, held, k, features, row_id, payload, exclude_self, p, element, name)
    return _answer_blocks(q, d, k, features, row_id, payload, exclude_self, p, element, block_rows, query_rows, name, max_reach)


def knn_join(q: DataFrame, d: DataFrame, k: int, features: list[str], row_id: str = "row_id",
             payload: list[str] | None = None, exclude_self: bool = False, p: int = 2, **limits) -> DataFrame:
    """k-nearest-neighbour join: one row (q, rank, d_id, dist, payload...) per pair; dist is the metric's own."""
    found = with_neighbours(q.select(row_id, *features), d, k, features, row_id, payload, exclude_self, p, "_n", **limits)
    rows = found.select(F.col(row_id).alias("q"), F.posexplode("_n").alias("_i", "_e"))
    dist = F.sqrt("_e.dist") if p == 2 else F.col("_e.dist")
    return rows.select("q", (F.col("_i") + 1).alias("rank"), F.col("_e.id").alias("d_id"), dist.alias("dist"),
                       *[F.col(f"_e.{c}").alias(c) for c in payload or []])


def with_class_neighbours(q: DataFrame, d: DataFrame, k: int, features: list[str], label: str = "Class",
                          row_id: str = "row_id", payload: list[str] | None = None,
                          exclude_self: bool = False, p: int = 2, classes: tuple = (0, 1), **limits) -> DataFrame:
    """Add the k nearest rows of each class as columns ``near_<class>``."""
    if p not in (1, 2):
        raise ValueError(f"Unsupported metric: p={p}")
    payload = [label, *(payload or [])]
    sizes = {"broadcast_rows": BROADCAST_ROWS, "block_rows": BLOCK_ROWS, "query_rows": QUERY_ROWS, "max_reach": MAX_REACH, **limits}
    q = _finite(q, features, row_id)
    d = _finite(d, features, row_id).select(row_id, *features, *payload)
    element = _neighbour_type(d, row_id, payload)
    whole = _small_side(d, sizes["broadcast_rows"])
    own = {c: whole.filter(pc.equal(whole.column(label), c)) if whole is not None
           else _small_side(d.where(F.col(label) == c), sizes["broadcast_rows"]) for c in classes}
    small = {f"near_{c}": (t, element) for c, t in own.items() if t is not None}
    order = [*q.columns, *small, *[f"near_{c}" for c in classes if own[c] is None]]
    for c in classes:
        if own[c] is None:
            q = _answer_large(q, d.where(F.col(label) == c), k, features, row_id, payload, exclude_self, p, element, name=f"near_{c}", **sizes)
    if small:  # last, so that no search has to move these lists
        q = _answer_small(q, small, k, features, row_id, payload, exclude_self, p)
    return q.select(order)


def merged(lists: list[Column], k: int | None = None) -> Column:
    """One list ordered by (dist, id) from several, cut to the k nearest."""
    both = F.array_sort(F.concat(*lists), lambda a, b: F.when(a["dist"] < b["dist"], -1).when(a["dist"] > b["dist"], 1)
                        .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    return both if k is None else F.slice(both, 1, k)


def even_region(k: int, classes: tuple = (0, 1)) -> Column:
    """Region with k split evenly over the classes; a remainder goes to the closest leftover rows."""
    share, rest = divmod(k, len(classes))
    lists = [F.slice(f"near_{c}", 1, share) for c in classes]
    if rest:
        left = merged([F.slice(f"near_{c}", share + 1, rest) for c in classes], rest)
        lists.append(left)
    return merged(lists)


def knne_join(q: DataFrame, d: DataFrame, k: int, features: list[str], label: str = "Class",
              row_id: str = "row_id", p: int = 2, **limits) -> DataFrame:
    """Neighbours split evenly over the classes, ranked over the merged region."""
    found = with_class_neighbours(q.select(row_id, *features), d, -(-k // 2), features, label, row_id, [], p=p, **limits)
    rows = found.select(F.col(row_id).alias("q"), F.posexplode(even_region(k)).alias("_i", "_e"))
    dist = F.sqrt("_e.dist") if p == 2 else F.col("_e.dist")
    return rows.select("q", (F.col("_i") + 1).alias("rank"), F.col("_e.id").alias("d_id"), dist.alias("dist"),
                       F.col(f"_e.{label}").alias("y"))


def assign_cluster(q: DataFrame, centroids: DataFrame, features: list[str], row_id: str = "row_id", **limits) -> DataFrame:
    """Add ``cluster``, the id of the nearest centroid."""
    found = with_neighbours(q, centroids, 1, features, row_id, name="_c", **limits)
    return found.withColumn("cluster", F.col("_c")[0]["id"]).drop("_c")


def lloyd(df: DataFrame, seeds: DataFrame, features: list[str], iterations: int = 300,
          row_id: str = "row_id", tolerance: float = 1e-9) -> DataFrame:
    """Centroids (row_id, features) of k-means from given seeds.

    Steps until no centroid moves by more than ``tolerance`` in any feature, ``iterations`` at most; a warning says if
    that was not enough.

    Any number of centroids: the assignment is the neighbour join, the update one aggregate. A
    centroid without rows keeps its place.
    """
    centroids = materialize(seeds.select(row_id, *[F.col(c).cast("double").alias(c) for c in features]), "centroids")
    for step in range(iterations):
        means = (assign_cluster(df.select(row_id, *features), centroids, features, row_id)
                 .groupBy("cluster").agg(*[F.avg(c).alias(f"_m_{c}") for c in features]))
        moved = centroids.join(means.withColumnRenamed("cluster", row_id), row_id, "left")
        shift = F.greatest(*[F.abs(F.coalesce(F.col(f"_m_{c}") - F.col(c), F.lit(0.0))) for c in features], F.lit(0.0))
        moved = materialize(moved.select(row_id, *[F.coalesce(f"_m_{c}", c).alias(c) for c in features], shift.alias("_shift")), "centroids")
        most = moved.agg(F.max("_shift")).first()[0] or 0.0
        centroids = moved.drop("_shift")
        if most <= tolerance:
            break
    else:
        if iterations > 2:
            warnings.warn(f"k-means still moved by {most:.3g} after {iterations} steps", stacklevel=2)
    return centroids
