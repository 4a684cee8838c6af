import numpy as np
import pandas as pd
import pytest
from callgrain.operators import hierarchy as H
from callgrain.operators import metric_tree as T
from pyspark.sql import functions as F


def unit(x):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def reachability(u, k):
    d = np.sqrt(((u[:, None, :] - u[None, :, :]) ** 2).sum(axis=2))
    order = np.sort(d, axis=1)
    core = order[:, min(k, len(u) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def prim(w):
    n, best, out = len(w), w[0].copy(), []
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        best[inside] = np.inf
        at = best.argmin()
        out.append(best[at])
        inside[at] = True
        best = np.minimum(best, w[at])
    return sorted(out)


def pieces(w, members, below):
    """Components of the members linked by less than ``below``."""
    left, out = set(members), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            at = todo.pop()
            near = {j for j in left if w[at, j] < below}
            left -= near
            found |= near
            todo += near
        out.append(sorted(found))
    return out


def brute(x, min_size, k):
    """From the definition, from low density to high: splits, stability, choice."""
    length = np.linalg.norm(x, axis=1)
    rows = np.flatnonzero(length > 0)
    w = reachability(unit(x[rows]), k)
    levels = sorted(set(w[np.triu_indices(len(w), 1)]), reverse=True)

    def cluster(members, birth):
        """(stability total, chosen point sets) of a cluster that exists from density ``birth`` on."""
        total, here = 0.0, members
        for d in levels:
            if len(here) < min_size or not any(True for _ in here):
                break
            parts = pieces(w, here, d) if w[np.ix_(here, here)].max() >= d else [here]
            if len(parts) == 1:
                continue
            big = [p for p in parts if len(p) >= min_size]
            density = 1 / max(d, H.NEAREST)
            if len(big) == 1:
                total += (len(here) - len(big[0])) * (density - birth)
                here = big[0]
                continue
            total += len(here) * (density - birth)
            kids = [cluster(p, density) for p in big]
            below = sum(s for s, _ in kids)
            if birth and total >= below:
                return total, [members]
            return (below, [c for _, cs in kids for c in cs]) if kids else (total, [members] if birth else [])
        return total, [members] if birth else []

    label = np.full(len(x), -1)
    if len(rows) >= min_size:
        chosen = sorted(cluster(list(range(len(rows))), 0.0)[1])
        for i, c in enumerate(chosen):
            label[rows[c]] = i
    return label


def blobs(seed, scale=1, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, dim))
    parts = [centre[0] + 0.04 * rng.normal(size=(40 * scale, dim)), np.repeat(centre[1:2], 12, axis=0), np.zeros((2, dim)), np.repeat(centre[2:3], 3, axis=0)]
    parts += [centre[i] + s * rng.normal(size=(25 * scale, dim)) for i, s in zip(range(1, 7), (0.03, 0.06, 0.1, 0.1, 0.15, 0.25))]
    parts += [centre[6] + 0.2 + 0.02 * rng.normal(size=(20 * scale, dim)), rng.normal(size=(30 * scale, dim))]
    return np.vstack(parts)


def frame(spark, x, **cols):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": list(x), **cols}))


def labels(df):
    return df.toPandas().sort_values("id")["cluster_id"].tolist()


@pytest.mark.parametrize("seed,min_size,min_pts,leaf,window", [(1, 8, 4, 24, 10**6), (2, 5, 5, 30, 40)])
def test_equals_the_definition(spark, seed, min_size, min_pts, leaf, window):
    x = blobs(seed)
    want = brute(x, min_size, min_pts).tolist()
    assert max(want) >= 4 and -1 in want
    assert labels(H.density_hierarchy(frame(spark, x).repartition(3), "id", "v", min_size, min_pts, leaf=leaf, window=window)) == want


def test_tree_weights_of_2000_points(spark):
    x = unit(blobs(3, scale=9))[:2000]
    x = x[np.linalg.norm(x, axis=1) > 0]
    edges, points = H.hierarchy_edges(frame(spark, x), "id", "v", 6, leaf=64)
    copies = points.toPandas()
    inner = [c for w, c in zip(copies["w"], copies["core"], strict=True) for _ in range(w - 1)]
    got = sorted([r["w"] for r in edges.select("w").collect()] + inner)
    assert len(got) == len(x) - 1 > 1900
    np.testing.assert_allclose(got, prim(reachability(x, 6)), atol=1e-9)


def test_groups_that_search_each_other(spark, monkeypatch):
    """Neighbours and edges are found across groups of leaves; deep trees of few points need no passes over all."""
    monkeypatch.setattr(T, "LEAST_POINTS", 1)
    monkeypatch.setattr(T, "GROUPS", 3)
    x = unit(blobs(6))
    x = x[np.linalg.norm(x, axis=1) > 0]
    passes, store = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, label="table": (passes.append(label), store(df, label))[1])
    edges, points = H.hierarchy_edges(frame(spark, x), "id", "v", 4, leaf=16)
    copies = points.toPandas()
    inner = [c for w, c in zip(copies["w"], copies["core"], strict=True) for _ in range(w - 1)]
    got = sorted([r["w"] for r in edges.select("w").collect()] + inner)
    np.testing.assert_allclose(got, prim(reachability(x, 4)), atol=1e-9)
    assert "tree-level" not in passes and "node-pairs" not in passes


def test_partitions_are_separate(spark):
    x = blobs(4)
    part = ["a" if i % 3 else "b" for i in range(len(x))]
    got = H.density_hierarchy(frame(spark, x, part=part), "id", "v", 5, 3, partition_col="part", leaf=20).toPandas().sort_values("id")
    for p in "ab":
        rows = np.array([q == p for q in part])
        assert got["cluster_id"].to_numpy()[rows].tolist() == brute(x[rows], 5, 3).tolist()


def test_degenerate(spark):
    assert labels(H.density_hierarchy(frame(spark, np.zeros((3, 4))), "id", "v", 2)) == [-1] * 3
    assert labels(H.density_hierarchy(frame(spark, np.eye(3)), "id", "v", 5)) == [-1] * 3
    assert labels(H.density_hierarchy(frame(spark, np.ones((1, 3))), "id", "v", 2)) == [-1]
    assert H.density_hierarchy(frame(spark, np.ones((1, 3))).limit(0), "id", "v", 2).count() == 0
    with pytest.raises(ValueError):
        H.density_hierarchy(frame(spark, np.eye(3)), "id", "v", 1)


def test_tree_bounds_and_growth(spark):
    """Blocks that are not paired hold nothing near; compared pairs grow with the points, not their square."""
    rng = np.random.default_rng(5)
    centre = 3 * rng.normal(size=(64, 3))
    compared = []
    for n in (500, 1000, 2000):
        x = centre[np.arange(n) % 64 if n == 500 else rng.integers(0, 64, n)] + 0.1 * rng.normal(size=(n, 3))
        points = spark.createDataFrame(pd.DataFrame({"part": 0, "rep": range(n), "w": 1, "vec": list(x)}))
        tree = T.build(H.materialize(points.withColumns({"rep": F.col("rep").cast("long"), "w": F.col("w").cast("long")}), "points"), 32)
        assert tree.leaves.agg(F.sum("n")).first()[0] == n and tree.leaves.agg(F.max("n")).first()[0] <= 32
        cores, pairs = H.with_core_distances(tree, 5)
        compared.append(H.compared_pairs(tree, pairs))
        got = {}
        for r in cores.select("ids", "core").collect():
            got.update(zip(np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["core"], "<f8").tolist(), strict=True))
        d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 5]
        np.testing.assert_allclose([got[i] for i in range(n)], d, atol=1e-9)
    assert compared[2] < 3.2 * compared[1] and compared[1] < 3.2 * compared[0] and compared[2] < 2000 * 2000 / 6
