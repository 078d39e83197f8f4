import math

import numpy as np
import pytest

from vantage.llm import embed_dedup as ed


def plain(rows, cosine=0.95):
    """rows: (vec_id, list)."""
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    scaled = [np.array(v, float) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok, strict=True)]  # lest squares overflow
    unit = [v / np.linalg.norm(v) if v is not None else None for v in scaled]
    n = len(rows)
    links = [{j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine} for i in range(n)]
    out, done = [], {}
    for i in range(n):
        if i not in done:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                done[j] = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), done[i], rows[i][0] == done[i]))
    return sorted(out, key=str)


def clusters(rng, dim, n):
    rows = []
    for _ in range(n):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 7)):
            rows.append((centre + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2, 0.25, 0.3, 0.5])) * rng.uniform(0.1, 9))
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("tile", [16384, 20])
def test_random_clusters(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "TILE", tile)
    rows = clusters(np.random.default_rng(4), 64, 120)
    # a chain: neighbours are linked, ends are not
    a, b = np.eye(64)[0], np.eye(64)[1]
    rows += [(1000 - k, (a * math.cos(k * 0.3) + b * math.sin(k * 0.3)).tolist()) for k in range(6)]
    rows += [(2000 + k, rows[0][1]) for k in range(40)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted(map(tuple, ed.near_vectors(df).collect()), key=str)
    want = plain(rows)
    assert got == want and sum(w[1] for w in want) > 300


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [1.0, 0.0]), (7, [2.0, -0.0]), (9, [-1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.01]), (10, [1.0]), (11, [3.0]), (None, [0.0, 5.0]), (12, [1e-200, 0.0]), (13, [1e200, 1e190]), (14, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ed.near_vectors(df).collect()), key=str)
    assert got == plain(rows) and sum(g[1] for g in got) > 20
    assert ed.near_vectors(df.limit(0)).collect() == []


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, ed.near_vectors(df).collect()), key=str) == plain(rows)


def screened(x, how, cosine=0.95):
    """(share of all pairs compared, copies a vector) over all rows, counted apart from the operator's own estimate."""
    own, came, rows = {}, {}, 0
    for block, at, keys, side in ed.cells(x, how, cosine):
        rows += len(at)
        for k in keys.tolist():
            into = came if side else own
            into[block, k] = into.get((block, k), 0) + 1
    n = len(x)
    return sum(c * (c - 1) / 2 + c * came.get(k, 0) for k, c in own.items()) / (n * (n - 1) / 2), rows / n


def test_grid_is_an_index_where_directions_are_few():
    """80,000 vectors near a six-dimensional space: under a quarter of all pairs compared, under 8 copies of a vector.

    A link's radius is 0.316, and a coordinate's spread there is 0.41: cells as wide as the radius are few.
    """
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80_000, 6)) @ rng.standard_normal((6, 64)) + 0.05 * rng.standard_normal((80_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share, copies = screened(x, ed.plan(x[: ed.SAMPLE], 0.95))
    assert share < 0.25 and copies < 8


def test_even_directions_compare_every_pair_once():
    """Vectors spread evenly over 64 directions: a block's radius is wider than a coordinate's spread, so no grid helps."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share, copies = screened(x, ed.plan(x[: ed.SAMPLE], 0.95))
    assert share <= 1 and copies < 8


@pytest.mark.parametrize("number, grid", [(1, 0), (1, 3), (2, 2), (4, 2), (4, 4), (8, 3)])
def test_every_plan_is_exact(spark, monkeypatch, number, grid):
    monkeypatch.setattr(ed, "plans", lambda classes, cosine: {64: ed.Plan(np.linalg.qr(np.random.default_rng(3).standard_normal((64, 64)))[0], ed.dealt(64, number), grid)})
    rows = clusters(np.random.default_rng(6), 64, 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ed.near_vectors(df).collect()), key=str) == plain(rows)


def test_low_rank_table(spark, monkeypatch):
    """A table whose plan has a grid, over tiles, against brute force; mixed lengths and clashing columns."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 4)) @ rng.standard_normal((4, 32)) + 0.02 * rng.standard_normal((1200, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ed.plan(unit, 0.95).grid
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [float(i % 3), 1.0]) for i in range(9)]
    monkeypatch.setattr(ed, "TILE", 100)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<double>, cid int, v string")
    assert sorted(map(tuple, ed.near_vectors(df).collect()), key=str) == plain(rows)
