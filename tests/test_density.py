"""DBSCAN and components against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tillsight.operators.density as density
from tillsight.plans.graph import component_roots


def brute(points, eps, k):
    """points: (id, coordinates or None); label by the smallest core id, border by the smallest label."""
    ids = [p[0] for p in points if p[1] is not None]
    x = np.array([p[1] for p in points if p[1] is not None], float).reshape(len(ids), -1)
    d2 = sum((x[:, None, i] - x[None, :, i]) * (x[:, None, i] - x[None, :, i]) for i in range(x.shape[1]))
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= k
    label = np.array(ids)
    while True:
        new = np.array([min(label[near[i] & core], default=label[i]) if core[i] else label[i] for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    order = {r: i for i, r in enumerate(sorted(set(label[core].tolist())))}
    out = {p[0]: -1 for p in points}
    for i, me in enumerate(ids):
        mine = [order[label[j]] for j in np.flatnonzero(near[i] & core)]
        out[me] = min(mine) if mine else -1
    return out


def run(spark, points, d, eps, k):
    schema = "id long, " + ", ".join(f"s_{i} double" for i in range(d)) + ", cell string, n int"
    rows = [(i, *(x if x is not None else [None] * d), "c", 1) for i, x in points]
    out = density.dbscan(spark.createDataFrame(rows, schema), eps, k)
    assert out.columns == ["id", "label"]
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("d,eps,k,rows", [(2, 0.3, 5, 2), (3, 0.35, 4, 7), (1, 0.01, 3, 4096), (4, 0.5, 4, 4096)])
def test_dbscan_is_brute_force(spark, monkeypatch, d, eps, k, rows):
    monkeypatch.setattr(density, "CELL_ROWS", rows)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, .15, (500, d)), rng.normal(1.5, .4, (300, d)), rng.uniform(-4, 4, (150, d)),
                        np.round(rng.normal(-2, .3, (200, d)), 1)])
    points = [(int(i), r.tolist()) for i, r in zip(rng.permutation(len(x)) * 3, x)] + [(100_000, None)]
    got = run(spark, points, d, eps, k)
    assert len(got) == len(points) and dict(got) == brute(points, eps, k)


def test_hot_cell_and_marginal_gap(spark):
    """A third of all points in one cell; a second cell exactly eps away, and one just beyond."""
    rng = np.random.default_rng(1)
    hot = [[float(a), float(b)] for a, b in rng.uniform(0, .05, (700, 2))]
    points = [(i, x) for i, x in enumerate(hot + [[0.05, 0.0]] + [[1.05, 0.0]] * 6 + [[-1.0 - 1e-12, 0.0]] * 6 + [[9.0, 9.0]])]
    got = dict(run(spark, points, 2, 1.0, 5))
    assert got == brute(points, 1.0, 5)


def test_no_point_pairs_between_dense_cells(spark):
    """Two crowded cells settle by their boxes: the descent looks at a few boxes, not at pairs."""
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in np.concatenate([rng.uniform(0, .5, (4000, 2)), rng.uniform(.8, 1.3, (4000, 2))])]
    places = spark.createDataFrame(rows, "x double, y double").withColumn(
        "cell", F.array(F.floor(F.col("x") / .7).cast("double"), F.floor(F.col("y") / .7).cast("double")))
    boxes = density._boxes(places, ["cell"], ["x", "y"])
    pairs = density._around(boxes, 2, 2, 1.0).where(F.col("a") < F.col("b"))
    assert density._touching(pairs, places, ["x", "y"], .7, 1.0).distinct().count() == pairs.count() == 1


def test_dbscan_odd_tables(spark):
    assert run(spark, [], 2, 1.0, 3) == []
    assert dict(run(spark, [(1, None), (2, None)], 2, 1.0, 1)) == {1: -1, 2: -1}
    assert dict(run(spark, [(i, [2.0, 2.0]) for i in range(4)], 2, 1.0, 4)) == dict.fromkeys(range(4), 0)
    assert dict(run(spark, [(i, [2.0, 2.0]) for i in range(4)], 2, 1.0, 5)) == dict.fromkeys(range(4), -1)


def test_component_roots(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100)] + [tuple(map(int, e)) for e in rng.integers(200, 400, (150, 2))]
    got = dict(map(tuple, component_roots(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("d,k,block,tile", [(5, 12, 150, 16), (7, 40, 4096, 256)])
def test_wide_dbscan_lists_no_pairs_of_sparse_cells(spark, monkeypatch, d, k, block, tile):
    """In many dimensions most cells lie around a place: their pairs were listed, with bounds, before."""
    monkeypatch.setattr(density, "SMALL_BLOCK", block)
    monkeypatch.setattr(density, "TILE", tile)
    listed, around = [], density._around
    monkeypatch.setattr(density, "_around", lambda *a: listed.append(around(*a).count()) or around(*a))
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, .5, (500, d)), rng.normal(3, .6, (250, d)), rng.uniform(-3, 5, (100, d)),
                        np.zeros((60, d)), np.full((60, d), .2), np.round(rng.normal(-2, .4, (80, d)), 1)])
    points = [(int(i), r.tolist()) for i, r in zip(rng.permutation(len(x)) * 3, x)] + [(100_000, None)]
    got, want = dict(run(spark, points, d, 1.2, k)), brute(points, 1.2, k)
    assert got == want and len(set(want.values())) > 2
    assert sum(listed) < len(points)


def _blocks_of(rng, d):
    x = np.concatenate([rng.normal(0, .5, (900, d)), rng.normal(900, .5, (300, d)), rng.normal(0, 1, (40, d)) * 1e5, np.zeros((30, d))])
    x = np.concatenate([x, x[:200] + 1.2 * np.eye(d)[0], np.full((20, d), 1e200)])  # places at eps exactly, and beyond any square
    return x[rng.permutation(len(x))]


def test_products_of_matrices_compare_exactly(monkeypatch):
    """Tiles are compared by one product in single precision; what its rounding leaves open is compared pair by pair."""
    monkeypatch.setattr(density, "TILE", 64)
    monkeypatch.setattr(density, "CHUNK", 200)
    checked = []
    exactly = density._exactly
    monkeypatch.setattr(density, "_exactly", lambda x, y, e: checked.append(len(x)) or exactly(x, y, e))
    rng = np.random.default_rng(3)
    d, eps2 = 7, 1.2 * 1.2
    cols = [f"s_{i}" for i in range(d)]
    x, y = _blocks_of(rng, d), _blocks_of(np.random.default_rng(3), d)
    with np.errstate(all="ignore"):
        near = sum((x[:, None, i] - y[None, :, i]) ** 2 for i in range(d)) <= eps2
        l, r = pd.DataFrame(x, columns=cols), pd.DataFrame(y, columns=cols)
        l["pid"], r["n"], r["label"] = np.arange(len(x)), rng.integers(1, 4, len(y)), rng.integers(0, 5, len(y))
        counted = density._counts(cols, eps2)(l, r)
        least = density._least_labels(cols, eps2)(l, r)
        assert counted["found"].tolist() == (near @ r["n"].to_numpy()).tolist()
        want = [(i, r["label"].to_numpy()[row].min()) for i, row in enumerate(near) if row.any()]
        assert list(least.itertuples(index=False, name=None)) == want
        l["cid"], r["cid"] = np.arange(len(x)), len(x) + np.arange(len(y))
        links = density._links(cols, eps2)(l, r)
    graph = {i: {i} for i in range(len(x) + len(y))}  # components by joining sets
    for a, b in [(i, len(x) + j) for i, j in zip(*np.nonzero(near))]:
        if graph[a] is not graph[b]:
            graph[a] |= graph[b]
            for k in graph[b]:
                graph[k] = graph[a]
    root = {i: min(s) for i, s in graph.items()}
    assert dict(zip(links["ca"], links["cb"])) == {i: g for i, g in root.items() if g != i}
    assert 0 < sum(checked) < near.size / 2
