import numpy as np
import pandas as pd
import pytest

from callgrain.operators import cluster as C
from callgrain.operators import metric_tree as T
from pyspark.sql import functions as F


def brute(x, min_cos, min_pts):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    near = u @ u.T >= min_cos
    core = near.sum(1) >= min_pts
    label, k = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] != -1:
            continue
        found, todo = {i}, [i]
        while todo:
            for w in np.flatnonzero(near[todo.pop()] & core):
                if w not in found:
                    found.add(w)
                    todo.append(w)
        if len(found) >= min_pts:
            label[list(found)] = k
            k += 1
        else:
            label[list(found)] = -2
    label[label == -2] = -1
    return label


def blobs(seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 12))
    parts = [centre[0] + 0.05 * rng.normal(size=(150, 12)), np.repeat(centre[:1], 40, axis=0), np.zeros((2, 12))]
    parts += [centre[i] + 0.35 * rng.normal(size=(30, 12)) for i in range(1, 6)]
    return np.vstack([*parts, rng.normal(size=(60, 12))])


def frame(spark, x, **cols):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": list(x), **cols}))


@pytest.mark.parametrize("min_cos,min_pts,block", [(0.85, 5, 32), (0.6, 4, 64), (0.95, 3, 2048)])
def test_equals_brute_force(spark, min_cos, min_pts, block):
    x = blobs(3)
    got = C.density_cluster(frame(spark, x).repartition(3), "id", "v", min_cos, min_pts, block=block).toPandas()
    assert got.sort_values("id")["cluster_id"].tolist() == brute(x, min_cos, min_pts).tolist()


@pytest.mark.parametrize("min_cos,min_pts,probes", [(0.85, 5, 64), (0.6, 4, 1)])
def test_groups_that_search_each_other(spark, monkeypatch, min_cos, min_pts, probes):
    """Points of a cluster in several groups: counted and linked across them, without a table of pairs of leaves."""
    monkeypatch.setattr(T, "LEAST_POINTS", 1)
    monkeypatch.setattr(T, "GROUPS", 4)
    monkeypatch.setattr(C, "PROBES", probes)
    sent, search = [], C.search

    def counted(groups, seekers, *more):
        sent.append((groups.of_leaf.select("part", "grp").distinct().count(), seekers.agg(F.sum("m")).first()[0] or 0))
        return search(groups, seekers, *more)

    monkeypatch.setattr(C, "search", counted)
    x = blobs(5)
    got = C.density_cluster(frame(spark, x), "id", "v", min_cos, min_pts, block=16).toPandas()
    assert got.sort_values("id")["cluster_id"].tolist() == brute(x, min_cos, min_pts).tolist()
    # what a group has settled by itself is not sent to the others
    assert len(sent) == 3 and all(n > 1 and m < len(x) for n, m in sent)


class Counted(np.ndarray):
    """Vectors that count how many of them are compared."""

    cells = 0

    def __matmul__(self, other):
        Counted.cells += len(self) * other.shape[1]
        return np.asarray(self) @ np.asarray(other)


def leaves_of(vecs, leaves):
    starts = np.linspace(0, len(vecs), leaves + 1).astype(np.int64)
    return T.Points(np.arange(leaves), np.zeros(leaves), None, None, starts, np.arange(len(vecs)), vecs)


def test_a_group_compares_a_pair_once(monkeypatch):
    """Two large components that are far apart meet once, not once in each direction."""
    monkeypatch.setattr(T, "TILE_COLUMNS", 256)
    rng, n = np.random.default_rng(1), 4000
    side = np.where(np.arange(n) % 2, 1.0, -1.0)
    vecs = np.column_stack([side, 0.01 * rng.normal(size=(n, 3))])
    p = leaves_of((vecs / np.linalg.norm(vecs, axis=1, keepdims=True)).view(Counted), 8)
    Counted.cells, number = 0, np.arange(n)
    label = C._linked(p, number, p, number, number, np.ones((8, 8), bool), 0.9)
    assert label.tolist() == (number % 2).tolist()
    assert Counted.cells < 0.5 * n * n


@pytest.mark.parametrize("share", [0.1, 0.8, 1.0])
def test_each_pair_once_covers_the_pairs(monkeypatch, share):
    monkeypatch.setattr(T, "TILE_COLUMNS", 50)
    monkeypatch.setattr(T, "TILE_CELLS", 700)
    rng = np.random.default_rng(2)
    p = leaves_of(np.zeros((310, 2)), 12)
    may = rng.random((12, 12)) < share / 2
    may = may | may.T | np.eye(12, dtype=bool)
    seen = np.zeros((310, 310), bool)
    for rows, cols in T.each_pair_once(p, may):
        assert len(rows) * len(cols) <= 700
        seen[np.ix_(rows, cols)] = True
    assert (seen | seen.T)[may[np.ix_(p.leaf, p.leaf)]].all()


def test_partitions_are_separate(spark):
    x = blobs(4)
    part = ["a" if i % 3 else "b" for i in range(len(x))]
    got = C.density_cluster(
        frame(spark, x, part=part), "id", "v", 0.8, 4, partition_col="part", block=40
    ).toPandas().sort_values("id")
    for p in "ab":
        rows = np.array([q == p for q in part])
        assert got["cluster_id"].to_numpy()[rows].tolist() == brute(x[rows], 0.8, 4).tolist()


def test_degenerate(spark):
    zeros = frame(spark, np.zeros((3, 4)))
    assert {r["cluster_id"] for r in C.density_cluster(zeros, "id", "v", 0.5, 2).collect()} == {-1}
    alone = frame(spark, np.eye(3))
    assert {r["cluster_id"] for r in C.density_cluster(alone, "id", "v", 0.5, 2).collect()} == {-1}
    with pytest.raises(ValueError):
        C.density_cluster(alone, "id", "v", 0.0, 2)


def test_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, v array<float>")
    got = {r["k"]: r["centroid"] for r in C.centroids(df, "k", "v").collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 6.0]}
