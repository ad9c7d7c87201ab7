import numpy as np
import pytest

from raresift.llm import neardup
from raresift.llm.components import connected_components


def brute(rows, cosine=0.98):
    """{id: (links, component)} from (id, vector, label) rows with distinct ids."""
    links, at = {i: set() for i, _, _ in rows}, {}
    usable = []
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v):
            usable.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)), label))
    for n, (i, v, a) in enumerate(usable):
        for j, w, b in usable[n + 1:]:
            if a == b and len(v) == len(w) and v @ w >= cosine:
                links[i].add(j)
                links[j].add(i)
    for i in links:
        seen, work = {i}, [i]
        while work:
            for j in links[work.pop()] - seen:
                seen.add(j)
                work.append(j)
        at[i] = min(seen)
    return {i: (len(links[i]), at[i]) for i in links}


SCHEMA = "vec_id long, embedding array<float>, label int, id string, codes int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, "x", 1) for i, v, k in rows], SCHEMA)
    return {r.vec_id: r for r in neardup.near_duplicates(df, **more).collect()}


def cloud(rng, n, dim, spread, labels=3):
    """Chains and clusters around few centres."""
    rows = []
    for c in range(max(1, n // 12)):
        centre = rng.standard_normal(dim)
        for _ in range(12):
            v = centre + spread * rng.standard_normal(dim)
            rows.append([len(rows), v.astype(np.float32).tolist(), int(rng.integers(labels))])
    return rows


def test_as_all_pairs(spark):
    rows = cloud(np.random.default_rng(1), 240, 16, 0.13)
    rows += [[1000 + i, rows[0][1], rows[0][2]] for i in range(20)]  # copies
    rows += [[2000, None, 1], [2001, [0.0] * 16, 1], [2002, [float("nan")] * 16, 1], [2003, [None] * 16, 1], [2004, rows[0][1], None],
             [2005, [], 1], [2006, [1.0, 2.0], 1], [2007, [2.0, 4.0], 1], [2008, [float("inf")] * 16, 1]]
    got, want = run(spark, rows), brute(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_hot_bucket_is_cut(spark, monkeypatch):
    """Parts of hot buckets and several tables count every pair once."""
    monkeypatch.setattr(neardup, "ROWS", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [[i, (centre + (0.05 + 0.1 * (i % 2)) * rng.standard_normal(16)).tolist(), 0] for i in range(150)]
    rows += [[500 + i, rng.standard_normal(16).tolist(), 0] for i in range(100)]
    rows = [[i, np.float32(v).tolist(), k] for i, v, k in rows]
    assert {i: (r.n_links, r.component_id) for i, r in run(spark, rows).items()} == brute(rows)


def test_null_and_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, 0, None), (5, 1, 5), (5, 1, 5)]
    assert run(spark, []) == {}


@pytest.mark.parametrize("bits", [1, 6, 20])
def test_table_count_keeps_the_promise(bits):
    n = neardup.tables_needed(bits, 0.98, 1e-6)
    same = (1 - np.arccos(0.98) / np.pi) ** bits
    assert (1 - same) ** n <= 1e-6 < (1 - same) ** (n - 1) or n == 1


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(7, None), (3000, 3000)]
    edges += [(9000, i) for i in range(8000, 8300)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component_id for r in connected_components(df).collect()} == {x: find(x) for x in parent}
    assert connected_components(df.limit(0)).collect() == []
