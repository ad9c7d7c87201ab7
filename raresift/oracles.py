"""SQL text for checking the registered queries with DuckDB on the same tables.

Each function gives named table expressions; ``sql`` joins them to one statement. The SQL states the
definitions directly (full windows, all pairs): it is the slow, plain form of what the operators do.
"""

from __future__ import annotations

import math

from raresift.operators.dynamic import beta_table
from raresift.views import POOL, TXN_FEATURES, VEC_FEATURES

TXN = """txn AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
           || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS row_id,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 86400 AS DOUBLE) AS Time,
         l_quantity AS V1, l_discount AS V2, l_tax AS V3, CAST(l_linenumber AS DOUBLE) AS V4,
         CAST(l_suppkey AS DOUBLE) AS V5, l_extendedprice AS Amount,
         CASE WHEN l_quantity >= 48 AND l_discount >= 0.09 THEN 1 ELSE 0 END AS Class
  FROM lineitem)"""
TF = TXN + """, tf AS (
  SELECT row_id, V1, V2, V3, V4, V5, ln(1 + Amount) AS Log_Amount, Class FROM txn)"""
RARE = TF + """, rf AS (
  SELECT row_id, V1, V2, V3, V4, V5, Log_Amount,
         CASE WHEN V1 >= 49 AND V2 >= 0.095 THEN 1 ELSE 0 END AS Class FROM tf)"""
VF = """vf AS (
  SELECT CAST(vec_id AS VARCHAR) AS row_id, {cols},
         ln(1 + abs(CAST(embedding[29] AS DOUBLE)) * 100.0::DOUBLE) AS Log_Amount,
         CASE WHEN label = 0 THEN 1 ELSE 0 END AS Class
  FROM embeddings)""".format(cols=", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, 29)))
DOCS = """docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS row_id, CAST(length(text) AS DOUBLE) AS V1,
         CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS V2,
         CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS V3,
         CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS V4, toxic AS Class
  FROM documents d JOIN labels USING (doc_id))"""


def unit(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


DUP = TXN + f""", dup AS (
  SELECT Time, V1, V2, V3, V4, V5, Amount, Class
  FROM (SELECT *, {unit("'dup|' || row_id")} AS u FROM txn),
       unnest(range(1 + (u < 0.02)::INT + (u < 0.01)::INT + (u < 0.005)::INT)))"""


def _nulls() -> str:
    cells = []
    for c in ["Time", "V1", "V2", "V3", "V4", "V5", "Amount", "Class"]:
        gap = f"{unit(f"'{c}|' || row_id")} < 0.02 OR (u >= 0.006 AND u < 0.008)"
        if c in ("V1", "V2", "V3", "V4"):
            gap += " OR u < 0.006"
        if c == "V5":
            gap += " OR u < 0.003"
        cells.append(f"CASE WHEN {gap} THEN {"'NaN'::DOUBLE" if c == 'V3' else 'NULL'} ELSE {c} END AS {c}")
    return TXN + f", nul AS (SELECT row_id, {', '.join(cells)} FROM (SELECT *, {unit("'row|' || row_id")} AS u FROM txn))"


NUL = _nulls()
NUL_COLUMNS = ["row_id", "Time", "V1", "V2", "V3", "V4", "V5", "Amount", "Class"]
NUMERIC = NUL_COLUMNS[1:]


def missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c not in ("row_id", "Class") else f"({c} IS NULL)"


def sql(tables: str, select: str) -> str:
    return f"WITH {tables} {select}"


def per_column(columns: list[str], body) -> str:
    return " UNION ALL ".join(body(c) for c in columns)


# --- splits -------------------------------------------------------------------------------------

def ranked(src: str, seed, out: str = "rk") -> str:
    return f"""{out} AS (
  SELECT *, row_number() OVER (PARTITION BY Class ORDER BY md5('{seed}|' || row_id), row_id) AS rk,
         count(*) OVER (PARTITION BY Class) AS n FROM {src})"""


POOL_SQL = "[" + ", ".join(
    f"0.5::DOUBLE + 0.5::DOUBLE * ({s}::DOUBLE * ({c} - {k}::DOUBLE)) / (1.0::DOUBLE + abs({s}::DOUBLE * ({c} - {k}::DOUBLE)))"
    for _, c, s, k in POOL) + "]"
NAMES_SQL = "[" + ", ".join(f"'{p[0]}'" for p in POOL) + "]"


def pool_long(src: str, out: str = "pl", keep: str = "") -> str:
    return f"""{out}_w AS (SELECT *, {POOL_SQL} AS p FROM {src}),
  {out} AS (SELECT row_id, {keep} Class AS y, j, ({NAMES_SQL})[j] AS clf, p[j] AS p1, CAST(p[j] > 0.5 AS INT) AS pred
    FROM {out}_w, unnest(range(1, {len(POOL) + 1})) AS g(j))"""


# --- metrics ------------------------------------------------------------------------------------

def confusion(src: str, groups: str, out: str = "cf") -> str:
    return f"""{out} AS (SELECT {groups},
    count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn,
    count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn
    FROM {src} GROUP BY {groups})"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"


SCORES = {
    "accuracy": ratio("tp + tn", "tp + tn + fp + fn"), "precision": ratio("tp", "tp + fp"),
    "recall": ratio("tp", "tp + fn"), "f1": ratio("2 * tp", "2 * tp + fp + fn"),
    "balanced_accuracy": f"({ratio('tp', 'tp + fn')} + {ratio('tn', 'tn + fp')}) / 2",
    "tnr": ratio("tn", "tn + fp"), "fpr": ratio("fp", "fp + tn"), "tpr": ratio("tp", "tp + fn"),
}
_N = "CAST(tp + tn + fp + fn AS DOUBLE)"
_PE = f"(((tp + fp) / {_N}) * ((tp + fn) / {_N}) + ((tn + fn) / {_N}) * ((tn + fp) / {_N}))"
SCORES["kappa"] = f"CASE WHEN {_PE} < 1 THEN ((tp + tn) / {_N} - {_PE}) / (1 - {_PE}) END"


def curve(src: str, groups: str, out: str = "cv") -> str:
    return f"""{out}_s AS (SELECT {groups}, p1, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
    FROM {src} GROUP BY {groups}, p1),
  {out}_c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS tp_all, sum(neg) OVER g AS tn_all
    FROM {out}_s WINDOW w AS (PARTITION BY {groups} ORDER BY p1 DESC), g AS (PARTITION BY {groups})),
  {out} AS (SELECT {groups},
    CASE WHEN max(tp_all) > 0 AND max(tn_all) > 0
      THEN sum(neg * (cp - pos + 0.5::DOUBLE * pos)) / (max(tp_all)::DOUBLE * max(tn_all)::DOUBLE) END AS roc_auc,
    CASE WHEN max(tp_all) > 0 THEN sum(pos * cp::DOUBLE / (cp + cn)) / max(tp_all) ELSE 0 END AS average_precision
    FROM {out}_c GROUP BY {groups})"""


def all_metrics(src: str, groups: list[str]) -> str:
    g = ", ".join(groups)
    cells = [f"round({e}, 6) AS {m}" for m, e in SCORES.items()]
    return (confusion(src, g) + ", " + curve(src, g),
            f"SELECT {g}, tp, tn, fp, fn, {', '.join(cells)}, round(roc_auc, 6) AS roc_auc, "
            f"round(average_precision, 6) AS average_precision FROM cf JOIN cv USING ({g})")


# --- neighbours ---------------------------------------------------------------------------------

def distance(a: str, b: str, features: list[str], p: int = 2) -> str:
    if p == 1:
        return " + ".join(f"abs({a}.{f} - {b}.{f})" for f in features)
    return " + ".join(f"({a}.{f} - {b}.{f}) * ({a}.{f} - {b}.{f})" for f in features)


def knn(q: str, d: str, k: int, features: list[str], out: str, own: bool = False, p: int = 2) -> str:
    """out(q, rank, dist, id): dist squared for p = 2."""
    skip = f"AND {q}.row_id <> {d}.row_id" if q != d else "AND a.row_id <> b.row_id"
    return f"""{out}_n AS (
    SELECT a.row_id AS q, min({{'dist': {distance('a', 'b', features, p)}, 'id': b.row_id}}, {k}) AS nb
    FROM {q} a, {d} b WHERE true {skip.replace(q + '.', 'a.').replace(d + '.', 'b.') if own else ''} GROUP BY a.row_id),
  {out} AS (SELECT q, rank, nb[rank].dist AS dist, nb[rank].id AS id
    FROM {out}_n, unnest(range(1, len(nb) + 1)) AS g(rank))"""


# --- resampling ----------------------------------------------------------------------------------

def under(src: str, out: str, ratio: float, seed) -> str:
    return ranked(src, f"{seed}u", f"{out}_k") + f""",
  {out} AS (SELECT * EXCLUDE (rk, n) FROM {out}_k
    WHERE Class = 1 OR rk <= floor((SELECT count(*) FROM {src} WHERE Class = 1) / {ratio}::DOUBLE + 1e-9))"""


def _grow(src: str, seeds: str, nn: str, times: str, out: str, features: list[str], seed) -> str:
    """seeds(row_id, features, times) and nn(q, rank, id) to src plus synthetic rows."""
    cells = ", ".join(f"m.{f} + m.u * (o.{f} - m.{f}) AS {f}" for f in features)
    cols = ", ".join(["row_id", *features, "Class"])
    return f"""{out}_t AS (SELECT s.*, c AS copy, s.row_id || '|' || c AS mark FROM {times} s, unnest(range(CAST(s.times AS BIGINT))) AS g(c)),
  {out}_m AS (SELECT *, {unit(f"'{seed}g|' || mark")} AS u,
      1 + CAST(floor({unit(f"'{seed}n|' || mark")} * (SELECT count(*) FROM {nn} WHERE q = t.row_id)) AS INT) AS pick FROM {out}_t t),
  {out} AS (SELECT {cols}, origin FROM {src} UNION ALL
    SELECT 's|' || m.mark, {cells}, 1, 'synthetic' FROM {out}_m m JOIN {nn} n ON n.q = m.row_id AND n.rank = m.pick
    JOIN {seeds} o ON o.row_id = n.id)"""


def _even(seeds: str, src: str, out: str, seed) -> str:
    return f"""{out}_tot AS (SELECT (SELECT count(*) FROM {src} WHERE Class = 0) - (SELECT count(*) FROM {src} WHERE Class = 1) AS total,
    (SELECT count(*) FROM {seeds}) AS m),
  {out} AS (SELECT s.*, total // m + CASE WHEN row_number() OVER (ORDER BY md5('{seed}e|' || row_id), row_id) <= total % m THEN 1 ELSE 0 END AS times
    FROM {seeds} s, {out}_tot)"""


def smote(src: str, out: str, features: list[str], seed, k: int = 5) -> str:
    return ", ".join([
        f"{out}_r AS (SELECT * FROM {src} WHERE Class = 1)",
        knn(f"{out}_r", f"{out}_r", k, features, f"{out}_nn", True),
        _even(f"{out}_r", src, f"{out}_e", seed),
        _grow(src, f"{out}_r", f"{out}_nn", f"{out}_e", out, features, seed)])


def adasyn(src: str, out: str, features: list[str], seed, k: int = 5) -> str:
    return ", ".join([
        f"{out}_r AS (SELECT * FROM {src} WHERE Class = 1)",
        knn(f"{out}_r", src, k, features, f"{out}_a", True),
        f"{out}_h AS (SELECT q, count(*) FILTER (d.Class = 0) AS m FROM {out}_a a JOIN {src} d ON d.row_id = a.id GROUP BY q)",
        knn(f"{out}_r", f"{out}_r", k, features, f"{out}_nn", True),
        f"""{out}_e AS (SELECT r.*, round_even(m::DOUBLE * ((SELECT count(*) FROM {src} WHERE Class = 0) - (SELECT count(*) FROM {src} WHERE Class = 1))
            / (SELECT sum(m) FROM {out}_h)::DOUBLE, 0) AS times FROM {out}_r r JOIN {out}_h h ON h.q = r.row_id)""",
        _grow(src, f"{out}_r", f"{out}_nn", f"{out}_e", out, features, seed)])


def borderline(src: str, out: str, features: list[str], seed, k: int = 5, m: int = 10) -> str:
    return ", ".join([
        f"{out}_r AS (SELECT * FROM {src} WHERE Class = 1)",
        knn(f"{out}_r", src, m, features, f"{out}_a", True),
        f"{out}_h AS (SELECT q, count(*) FILTER (d.Class = 0) AS m FROM {out}_a a JOIN {src} d ON d.row_id = a.id GROUP BY q)",
        f"{out}_d AS (SELECT r.* FROM {out}_r r JOIN {out}_h h ON h.q = r.row_id WHERE h.m * 2 >= {m} AND h.m < {m})",
        knn(f"{out}_d", f"{out}_r", k, features, f"{out}_nn", True),
        _even(f"{out}_d", src, f"{out}_e", seed),
        _grow(src, f"{out}_r", f"{out}_nn", f"{out}_e", out, features, seed)])


def enn(src: str, out: str, features: list[str], k: int = 3, classes: str = "majority") -> str:
    only = "TRUE" if classes == "all" else "q.Class = 0"
    return ", ".join([
        knn(src, src, k, features, f"{out}_nn", True),
        f"""{out} AS (SELECT * FROM {src} WHERE row_id NOT IN (
    SELECT q.row_id FROM {out}_nn n JOIN {src} q ON q.row_id = n.q JOIN {src} d ON d.row_id = n.id
    WHERE {only} AND q.Class <> d.Class))"""])


def tomek(src: str, out: str, features: list[str], remove: str = "majority") -> str:
    gone = f"SELECT a.q FROM {out}_l a" if remove == "all" else f"SELECT a.q FROM {out}_l a WHERE a.c = 0"
    return ", ".join([
        knn(src, src, 1, features, f"{out}_nn", True),
        f"""{out}_l AS (SELECT a.q, x.Class AS c FROM {out}_nn a JOIN {out}_nn b ON a.id = b.q AND b.id = a.q
    JOIN {src} x ON x.row_id = a.q JOIN {src} y ON y.row_id = a.id WHERE x.Class <> y.Class)""",
        f"{out} AS (SELECT * FROM {src} WHERE row_id NOT IN ({gone}))"])


def tomek_rare(src: str, out: str, features: list[str]) -> str:
    """As ``tomek``, from the minority rows and the rows nearest to them, which are the only ones that can be linked."""
    return ", ".join([
        f"{out}_r AS (SELECT * FROM {src} WHERE Class = 1)",
        knn(f"{out}_r", src, 1, features, f"{out}_a", True),
        f"{out}_c AS (SELECT * FROM {src} WHERE Class = 0 AND row_id IN (SELECT id FROM {out}_a))",
        knn(f"{out}_c", src, 1, features, f"{out}_b", True),
        f"""{out} AS (SELECT * FROM {src} WHERE row_id NOT IN (
    SELECT b.q FROM {out}_a a JOIN {out}_b b ON a.id = b.q AND b.id = a.q))"""])


def ncr(src: str, out: str, features: list[str], k: int = 3) -> str:
    return ", ".join([
        knn(src, src, k, features, f"{out}_nn", True),
        f"""{out}_p AS (SELECT n.q, n.id, q.Class AS qc, d.Class AS dc, count(*) FILTER (q.Class <> d.Class) OVER (PARTITION BY n.q) AS others
    FROM {out}_nn n JOIN {src} q ON q.row_id = n.q JOIN {src} d ON d.row_id = n.id)""",
        f"""{out} AS (SELECT * FROM {src} WHERE row_id NOT IN (SELECT q FROM {out}_p WHERE qc = 0 AND others > 0)
    AND row_id NOT IN (SELECT id FROM {out}_p WHERE qc = 1 AND others * 2 > {k} AND dc = 0))"""])


def oss(src: str, out: str, features: list[str], seed) -> str:
    cols = ", ".join(["row_id", *features, "Class", "origin"])
    return ", ".join([
        ranked(src, f"{seed}c", f"{out}_k"),
        f"{out}_c AS (SELECT {cols} FROM {out}_k WHERE Class = 1 OR rk = 1)",
        f"{out}_r AS (SELECT {cols} FROM {out}_k WHERE Class = 0 AND rk > 1)",
        knn(f"{out}_r", f"{out}_c", 1, features, f"{out}_n1"),
        f"""{out}_u AS (SELECT {cols} FROM {out}_c UNION ALL SELECT {", ".join("r." + c.strip() for c in cols.split(","))} FROM {out}_r r
    JOIN {out}_n1 n ON n.q = r.row_id JOIN {out}_c c ON c.row_id = n.id WHERE c.Class = 1)""",
        tomek(f"{out}_u", out, features)])


def centroids(src: str, out: str, features: list[str], seed, iterations: int) -> str:
    parts = [ranked(src, f"{seed}c", f"{out}_k"),
             f"{out}_maj AS (SELECT * FROM {src} WHERE Class = 0)",
             f"""{out}_0 AS (SELECT row_id, {", ".join(features)} FROM {out}_k
    WHERE Class = 0 AND rk <= (SELECT count(*) FROM {src} WHERE Class = 1))"""]
    for i in range(iterations):
        cells = ", ".join(f"coalesce(avg(x.{f}), any_value(c.{f})) AS {f}" for f in features)
        parts += [knn(f"{out}_maj", f"{out}_{i}", 1, features, f"{out}_a{i}"),
                  f"""{out}_{i + 1} AS (SELECT c.row_id, {cells} FROM {out}_{i} c LEFT JOIN {out}_a{i} a ON a.id = c.row_id
    LEFT JOIN {out}_maj x ON x.row_id = a.q GROUP BY c.row_id)"""]
    cols = ", ".join(features)
    parts.append(f"""{out} AS (SELECT 'c|' || row_id AS row_id, {cols}, 0 AS Class, 'centroid' AS origin FROM {out}_{iterations}
    UNION ALL SELECT row_id, {cols}, Class, origin FROM {src} WHERE Class = 1)""")
    return ", ".join(parts)


def origin(src: str, out: str) -> str:
    return f"{out} AS (SELECT *, 'original' AS origin FROM {src})"


def resampled(src: str, features: list[str]) -> str:
    cells = ", ".join(f"round({f}, 6) AS {f}" for f in features)
    return f"SELECT row_id, {cells}, Class, origin FROM {src}"


# --- dynamic selection -----------------------------------------------------------------------------

SIZE = len(POOL)


def dynamic_tables(k: int = 8, kind: str = "even", seed=7) -> str:
    """q (all rows outside the selection set), ds, hard, and nb(q, rank, dist, id, y) of the region."""
    scores = [f"s{j}" for j in range(1, SIZE + 1)]
    features = scores if kind == "profile" else TXN_FEATURES
    flat = "".join(f", p[{j}] AS s{j}" for j in range(1, SIZE + 1))
    per_class = k // 2 if kind != "plain" else k
    parts = [TF, f"tp AS (SELECT *{flat} FROM (SELECT *, {POOL_SQL} AS p FROM tf))", ranked("tp", seed),
             "ds AS (SELECT * FROM rk WHERE rk <= round(0.15 * n))", "q AS (SELECT * FROM rk WHERE rk > round(0.15 * n))",
             f"hard AS (SELECT * FROM q WHERE len(list_filter(p, lambda x: x > 0.5)) BETWEEN 1 AND {SIZE - 1})"]
    for c in (0, 1):
        parts += [f"d{c} AS (SELECT * FROM ds WHERE Class = {c})", knn("hard", f"d{c}", per_class, features, f"n{c}")]
    limit = f"WHERE rank <= {k}"
    parts.append(f"""nb AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank, dist, id, y
    FROM (SELECT q, dist, id, 0 AS y FROM n0 UNION ALL SELECT q, dist, id, 1 AS y FROM n1)) {limit})""")
    parts.append(f"""rg AS (SELECT n.q, n.rank, n.dist, n.y, j, d.p[j] AS p, h.p[j] > 0.5 AS o,
    CASE WHEN (d.p[j] > 0.5) = (n.y = 1) THEN 1 ELSE 0 END AS c, CASE WHEN n.y = 1 THEN d.p[j] ELSE 1 - d.p[j] END AS s,
    1 / (sqrt(n.dist) + 1e-10) AS w, min(n.dist) OVER (PARTITION BY n.q) AS dmin
    FROM nb n JOIN ds d ON d.row_id = n.id JOIN hard h ON h.row_id = n.q, unnest(range(1, {SIZE + 1})) AS g(j))""")
    return ", ".join(parts)


def _prune(active: bool) -> str:
    if not active:
        return "kp AS (SELECT DISTINCT q, j, TRUE AS keep FROM rg)"
    return """kp0 AS (SELECT q, j, coalesce(max(c) FILTER (y = 0), 0) = 1 AND coalesce(max(c) FILTER (y = 1), 0) = 1 AS hit2,
    min(y) AS y0, max(y) AS y1 FROM rg GROUP BY q, j),
  kp AS (SELECT q, j, CASE WHEN bool_or(y0 <> y1) OVER w AND bool_or(hit2) OVER w THEN hit2 ELSE TRUE END AS keep
    FROM kp0 WINDOW w AS (PARTITION BY q))"""


_SAFE = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
_W = "exp(dmin - dist)"
_PART = "CASE WHEN {v} > 0 THEN {v} * ln(2 * {v}) ELSE 0 END"


def _pot(score: str) -> str:
    return _SAFE.format(a=f"sum({_W} * ({score}))", b=f"sum({_W})")


_BETA = "(" + "[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in beta_table()) + "])"
COMPETENCE = {
    "OLA": "avg(c)", "DESP": "avg(c)",
    "LCA": _SAFE.format(a="count(*) FILTER (o = (y = 1) AND c = 1)::DOUBLE", b="count(*) FILTER (o = (y = 1))"),
    "MLA": _SAFE.format(a="coalesce(sum(w) FILTER (o = (y = 1) AND c = 1), 0)", b="coalesce(sum(w) FILTER (o = (y = 1)), 0)"),
    "APriori": _SAFE.format(a="sum(w * s)", b="sum(w)"),
    "APosteriori": _SAFE.format(a="coalesce(sum(w * s) FILTER (o = (y = 1)), 0)", b="sum(w * CASE WHEN o THEN p ELSE 1 - p END)"),
    "KNORAE": "coalesce(min(rank) FILTER (c = 0) - 1, count(*))",
    "KNORAU": "sum(c)", "KNOP": "sum(c)",
    "DESKL": _pot(f"(CASE WHEN c = 1 THEN 1 ELSE -1 END) * ({_PART.format(v='p')} + {_PART.format(v='(1 - p)')}) / {math.log(2.0)!r}::DOUBLE"),
    "Exponential": _pot("1 - pow(2.0::DOUBLE, 1 - least(s, 1 - 1e-10) / (1 - least(s, 1 - 1e-10)))"),
    "Logarithmic": _pot("2 * s - 1"),
    "RRC": _pot("bt[least(floor(s * 1000), 999)::INT + 1] + (bt[least(floor(s * 1000), 999)::INT + 2] "
                "- bt[least(floor(s * 1000), 999)::INT + 1]) * (s * 1000 - least(floor(s * 1000), 999))"),
}
_BEST = "CASE WHEN keep AND row_number() OVER (PARTITION BY q ORDER BY keep DESC, comp DESC, j) = 1 THEN 1 ELSE 0 END"
_ALL = "CASE WHEN sum({s}) OVER (PARTITION BY q) > 0 THEN {s} ELSE keep::INT END"


def _above(level: float) -> str:
    return _ALL.format(s=f"(CASE WHEN keep AND comp > {level} THEN 1 ELSE 0 END)")


_TOP = "max(CASE WHEN keep THEN comp END) OVER (PARTITION BY q)"
SELECTION = {
    **{n: _BEST for n in ("OLA", "LCA", "MLA", "APriori", "APosteriori")},
    "KNORAE": f"CASE WHEN {_TOP} > 0 THEN (CASE WHEN keep AND comp = {_TOP} THEN 1 ELSE 0 END) ELSE keep::INT END",
    "KNORAU": _ALL.format(s="(CASE WHEN keep THEN comp ELSE 0 END)"),
    "KNOP": _ALL.format(s="(CASE WHEN keep THEN comp ELSE 0 END)"),
    "DESP": _above(0.5), "RRC": _above(0.5), "DESKL": _above(0), "Exponential": _above(0), "Logarithmic": _above(0),
}
KIND = {**{n: "even" for n in SELECTION}, "KNOP": "profile",
        **{n: "plain" for n in ("RRC", "DESKL", "Exponential", "Logarithmic")}}


def _answers(weights: str) -> str:
    return f"""{weights},
  ans AS (SELECT q AS row_id, sum(wt * h.p[j]) / sum(wt) AS p1 FROM wt JOIN hard h ON h.row_id = wt.q GROUP BY q),
  fin AS (SELECT row_id, p1 FROM ans UNION ALL
    SELECT row_id, list_sum(p) / {SIZE} AS p1 FROM q WHERE row_id NOT IN (SELECT row_id FROM hard))"""


FINAL = "SELECT row_id, round(p1, 6) AS p1, CAST(p1 > 0.5 AS INT) AS pred FROM fin"


def selector(name: str, final: str = FINAL) -> str:
    table = f", bt0 AS (SELECT {_BETA} AS bt)" if name == "RRC" else ""
    src = "rg, bt0" if name == "RRC" else "rg"
    comp = f"cm AS (SELECT q, j, {COMPETENCE[name]} AS comp FROM {src} GROUP BY q, j)"
    weights = f"wt AS (SELECT q, j, {SELECTION[name]} AS wt FROM cm JOIN kp USING (q, j))"
    return sql(f"{dynamic_tables(kind=KIND[name])}{table}, {_prune(name != 'DESKL')}, {comp}, {_answers(weights)}", final)


def gated(name: str, rate: float) -> str:
    """Rows the pool disagrees on: easy plain regions answer themselves, others by the selector."""
    share = sql(dynamic_tables(kind="plain"), "SELECT q AS row_id, avg(y) AS s FROM nb GROUP BY q")
    return f"""SELECT row_id, round(p1, 6) AS p1, CAST(p1 > 0.5 AS INT) AS pred FROM (
  SELECT row_id, CASE WHEN least(s, 1 - s) < {rate} THEN s ELSE p1 END AS p1
  FROM ({selector(name, "SELECT row_id, p1 FROM ans")}) v JOIN ({share}) r USING (row_id))"""


def every_selector() -> str:
    """Metrics of every region selector over all rows outside the selection set."""
    plain = "SELECT row_id, p1 FROM fin"
    answers = {**{n: selector(n, plain) for n in SELECTION}, "DESKNN": desknn(plain)}
    union = " UNION ALL ".join(f"SELECT '{n}' AS model, row_id, round(p1, 9) AS p1 FROM ({q})" for n, q in answers.items())
    tables, select = all_metrics("ml", ["model"])
    return sql(f"{TF}, al AS ({union}), ml AS (SELECT model, p1, CAST(p1 > 0.5 AS INT) AS pred, Class AS y FROM al JOIN tf USING (row_id)), {tables}", select)


def desknn(final: str = FINAL) -> str:
    n, m = SIZE // 2, math.ceil(SIZE * 0.3)
    weights = f"""rw AS (SELECT *, sum(1 - c) OVER (PARTITION BY q, rank) AS wrong FROM rg),
  cm AS (SELECT q, j, avg(c) AS acc, sum((1 - c) * (wrong - 1)) AS err FROM rw GROUP BY q, j),
  top AS (SELECT q, j, err, row_number() OVER (PARTITION BY q ORDER BY acc DESC, j) AS ra FROM cm JOIN kp USING (q, j) WHERE keep),
  wt AS (SELECT q, j, CASE WHEN row_number() OVER (PARTITION BY q ORDER BY err, j) <= {m} THEN 1 ELSE 0 END AS wt FROM top WHERE ra <= {n})"""
    return sql(f"{dynamic_tables()}, {_prune(True)}, {_answers(weights)}", final)


def desclustering(clusters: int = 5, seed="7c") -> str:
    """Centroids are the first selection-set rows in hash order."""
    n, m = SIZE // 2, math.ceil(SIZE * 0.3)
    parts = [TF, f"tp AS (SELECT *, {POOL_SQL} AS p FROM tf)", ranked("tp", 7),
             "ds AS (SELECT * FROM rk WHERE rk <= round(0.15 * n))", "q AS (SELECT * FROM rk WHERE rk > round(0.15 * n))",
             f"hard AS (SELECT * FROM q WHERE len(list_filter(p, lambda x: x > 0.5)) BETWEEN 1 AND {SIZE - 1})",
             f"cen AS (SELECT * FROM ds ORDER BY md5('{seed}|' || row_id), row_id LIMIT {clusters})",
             knn("ds", "cen", 1, TXN_FEATURES, "ca"), knn("hard", "cen", 1, TXN_FEATURES, "qa"),
             f"""rw AS (SELECT a.id AS cluster, a.q, j, CASE WHEN (d.p[j] > 0.5) = (d.Class = 1) THEN 1 ELSE 0 END AS c
    FROM ca a JOIN ds d ON d.row_id = a.q, unnest(range(1, {SIZE + 1})) AS g(j))""",
             "rx AS (SELECT *, sum(1 - c) OVER (PARTITION BY q) AS wrong FROM rw)",
             "cm AS (SELECT cluster, j, avg(c) AS acc, sum((1 - c) * (wrong - 1)) AS err FROM rx GROUP BY cluster, j)",
             "top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY acc DESC, j) AS ra FROM cm)",
             f"""cw AS (SELECT cluster, j, CASE WHEN row_number() OVER (PARTITION BY cluster ORDER BY err, j) <= {m} THEN 1 ELSE 0 END AS wt
    FROM top WHERE ra <= {n})""",
             "wt AS (SELECT qa.q, j, wt FROM qa JOIN cw ON cw.cluster = qa.id)"]
    return sql(", ".join(parts[:-1]) + ", " + _answers(parts[-1]), FINAL)
