"""Density clustering with a hierarchy: clusters of different density, chosen by their stability.

The method is HDBSCAN* (Campello, Moulavi, Sander 2013): the distance at which two points are mutually
reachable is the largest of their core distances and their own distance; a minimum spanning tree under
it holds the clusterings of all densities at once; a cluster is born where a component splits into
parts of ``min_size`` or more, lives while points fall off, and is chosen where it is more stable than
what it splits into.

* Core distances: groups of leaves of a metric tree look through themselves, own leaf first; then only
  through groups and leaves that can hold something nearer than what is known.
* Spanning tree: Borůvka rounds. All edges met so far give every component an upper bound for its
  cheapest way out; only points whose core distance is below it look further, only in groups and
  leaves whose bounds allow something cheaper. Products of vectors find the candidates, differences
  give their distances. Edges are ordered by (weight, ends), so a round picks no circle.
* Tree of clusters: edges are taken in windows of rising weight; the components of a window are
  independent groups, a component is one row for the next window. Levels of equal weight merge at
  once, so the result depends on no order.

Equal vectors are one point with a weight. No task holds more than a few blocks, or one component's
part of a window.
"""

from __future__ import annotations

import sys
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.operators.metric_tree import (
    Groups, Points, Tree, build, distances, exact, group_leaves, in_groups, joined, leaf_gaps, points_of, rounding, search, squares,
    to_compare,
)
from callgrain.plans.components import connected_components
from callgrain.plans.ids import with_ids
from callgrain.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOISE = -1
# Edges of one window that one task merges.
WINDOW_EDGES = 1_000_000
# Distances below this are as dense as can be.
NEAREST = 1e-6
KEYS = ["part", "node"]


def _f8(values) -> pa.Array:
    return pa.array([np.asarray(values).astype("<f8").tobytes()])


def _i8(values) -> pa.Array:
    return pa.array([np.asarray(values).astype("<i8").tobytes()])


def _ints(raw) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _floats(raw) -> np.ndarray:
    return np.frombuffer(raw, "<f8")


def _rows(table: pa.Table, prefix: str = "") -> list[dict]:
    return [{k.removeprefix(prefix): v for k, v in r.items()} for r in table.to_pylist()]


def _head(table: pa.Table) -> dict:
    return {c: table.column(c).slice(0, 1).combine_chunks() for c in KEYS}


# --- core distances ------------------------------------------------------------------------------


def _best(dist: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest columns of every row, by distance, then id; padded with infinity."""
    if dist.shape[1] < k:
        pad = k - dist.shape[1]
        dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
        weights = np.pad(weights, ((0, 0), (0, pad)))
    order = np.lexsort((ids, dist), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (dist, ids, weights))


def _core(dist: np.ndarray, weights: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th other point, copies counted; the furthest known one if there are fewer."""
    upto = np.cumsum(weights, axis=1) + (own - 1)[:, None]
    enough = upto >= k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), dist.shape[1] - 1)
    core = np.where(enough.any(axis=1), dist[np.arange(len(dist)), at], np.inf)
    return np.where(own - 1 >= k, 0.0, core)


_NEAR = "dist binary, ids binary, weights binary"


def _nearer(a: Points, b: Points, b_weights: np.ndarray, found: list[np.ndarray], bound: np.ndarray, may: np.ndarray, k: int) -> int:
    """Puts what b has within ``bound`` of the points of a into ``found``, the k nearest of each point.
    Returns how many distances were looked at."""
    compared, a_leaf, b_leaf = 0, a.leaf, b.leaf
    for rows, cols in to_compare(a, b, may):
        x, y = a.vecs[rows], b.vecs[cols]
        near, slack = squares(x, y), rounding(x, y)
        compared += near.size
        # those looked at before may be among them; a point is not its own neighbour
        near[~may[np.ix_(a_leaf[rows], b_leaf[cols])] | (a.ids[rows][:, None] == b.ids[cols][None, :])] = np.inf
        limit = np.minimum(bound[rows], found[0][rows, -1]) ** 2
        if len(cols) > k:
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((near <= limit[:, None] * (1 + 1e-12) + 2 * slack) & np.isfinite(near))
        dist = exact(x[i], y[j])
        # the k best of each row, beside those known
        order = np.lexsort((b.ids[cols[j]], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, dist, nth = (v[nth < k] for v in (i, j, dist, nth))
        fresh = [np.full((len(rows), k), np.inf), np.full((len(rows), k), -1, np.int64), np.zeros((len(rows), k), np.int64)]
        for new, values in zip(fresh, (dist, b.ids[cols[j]], b_weights[cols[j]]), strict=True):
            new[i, nth] = values
        best = _best(*(np.hstack([f[rows], n]) for f, n in zip(found, fresh, strict=True)), k)
        for f, n in zip(found, best, strict=True):
            f[rows] = n
    return compared


def _nothing(n: int, k: int) -> list[np.ndarray]:
    return [np.full((n, k), np.inf), np.full((n, k), -1, np.int64), np.zeros((n, k), np.int64)]


def _per_leaf(p: Points, values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values[s:t].astype(kind).tobytes() for s, t in zip(p.starts[:-1], p.starts[1:], strict=True)], pa.binary())


def _lists(table: pa.Table, p: Points, found: list[np.ndarray], compared: int) -> dict:
    """Rows of the leaves' lists; the compared distances stand in the first row."""
    kinds = ("<f8", "<i8", "<i8")
    return {
        "part": table.column("part"), "node": table.column("node"),
        **{c: _per_leaf(p, f, kind) for c, f, kind in zip(("dist", "ids", "weights"), found, kinds, strict=True)},
        "compared": pa.array([compared] + [0] * (len(p.node) - 1), pa.int64()),
    }


def _in_group(dim: int, k: int):
    """The k nearest within the group: in the own leaf first, then in leaves that can hold nearer ones."""

    def run(table: pa.Table) -> pa.Table:
        p, w = points_of(table, dim), joined(table, "weights", "<i8")
        found, own = _nothing(len(p.ids), k), np.eye(len(p.node), dtype=bool)
        far = np.full(len(p.ids), np.inf)
        compared = _nearer(p, p, w, found, far, own, k)
        low = leaf_gaps(p, p)
        # leaves in the order of their distance: the nearest few make the bound of the others small
        near = low <= np.partition(low, min(FIRST_LEAVES, len(low) - 1), axis=1)[:, [min(FIRST_LEAVES, len(low) - 1)]]
        near &= low <= _leaf_reach(p, found, w, k)[:, None]
        compared += _nearer(p, p, w, found, far, near & ~own, k)
        rest = (low <= _leaf_reach(p, found, w, k)[:, None]) & ~near & ~own
        compared += _nearer(p, p, w, found, far, rest, k)
        reach = pa.array(_leaf_reach(p, found, w, k))
        return pa.table(_lists(table, p, found, compared) | {"bound": _per_leaf(p, _core(*found[::2], w, k), "<f8"), "reach": reach})

    return run


# Leaves that a leaf is compared with before the others.
FIRST_LEAVES = 3


def _leaf_reach(p: Points, found: list[np.ndarray], w: np.ndarray, k: int) -> np.ndarray:
    return np.maximum.reduceat(_core(*found[::2], w, k), p.starts[:-1])


def _in_others(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = points_of(left, dim), points_of(right, dim, "b_", "b")
        found, bound = _nothing(len(a.ids), k), joined(left, "bound", "<f8")
        may = (leaf_gaps(a, b) <= left.column("reach").to_numpy()[:, None]) & (a.grp != b.grp[0])[:, None]
        compared = _nearer(a, b, joined(right, "b_weights", "<i8"), found, bound, may, k)
        out = pa.table(_lists(left, a, found, compared))
        some = np.maximum.reduceat(np.isfinite(found[0]).any(axis=1), a.starts[:-1])
        some[0] = True
        return out.filter(pa.array(some))

    return run


def _joined(k: int):
    """Lists of one block from several tasks: core distances and neighbours."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _ints(_rows(left)[0]["weights"])
        parts = [[f(r[c]).reshape(len(own), -1) for c, f in (("dist", _floats), ("ids", _ints), ("weights", _ints))] for r in _rows(right, "b_")]
        dist, ids, w = _best(*(np.hstack([p[i] for p in parts]) for i in range(3)), k)
        core = _core(dist, w, own, k)
        finite = np.where(np.isfinite(dist), dist, 0.0).max(axis=1)
        core = np.where(np.isfinite(core), core, finite)
        return pa.Table.from_pydict(_head(left) | {"core": _f8(core), "near_dist": _f8(dist), "near_ids": _i8(ids)})

    return run


def with_core_distances(tree: Tree, k: int, groups: Groups | None = None) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``core`` and their neighbours, and the distances that were looked at (compared)."""
    groups = groups or group_leaves(tree)
    slim = tree.leaves.select(*KEYS, "ids", "weights", "vecs")
    schema = f"part {tree.part_type}, node long, {_NEAR}, compared long"
    first = materialize(in_groups(groups, slim, _in_group(tree.dim, k), f"{schema}, bound binary, reach double"), "in-groups")
    look = slim.select(*KEYS, "ids", "vecs").join(first.select(*KEYS, "bound", "reach"), KEYS).join(tree.leaves.select(*KEYS, F.col("n").alias("m")), KEYS)
    more = materialize(search(groups, look, slim, False, _in_others(tree.dim, k), schema), "in-others")
    lists = first.drop("reach", "bound").unionByName(more)
    compared = lists.select("compared")
    lists = lists.drop("compared")
    lists = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])
    cores = slim.select(*KEYS, "weights").groupBy(*KEYS).cogroup(lists.groupBy("b_part", "b_node")).applyInArrow(
        _joined(k), f"part {tree.part_type}, node long, core binary, near_dist binary, near_ids binary"
    )
    return materialize(slim.join(cores, KEYS), "cores"), compared


def compared_pairs(tree: Tree, pairs: DataFrame) -> int:
    """Pairs of points that were compared."""
    return pairs.agg(F.sum("compared")).first()[0] or 0


# --- spanning tree -------------------------------------------------------------------------------


def _points_and_edges(dim: int):
    """Of one block: its points, edges to their neighbours, and edges to its first point."""

    def run(table: pa.Table) -> pa.Table:
        row = _rows(table)[0]
        ids, core, vecs = _ints(row["ids"]), _floats(row["core"]), _floats(row["vecs"]).reshape(-1, dim)
        dist, near = _floats(row["near_dist"]).reshape(len(ids), -1), _ints(row["near_ids"]).reshape(len(ids), -1)
        real = np.isfinite(dist)
        x = np.concatenate([np.repeat(ids, dist.shape[1])[real.ravel()], ids])
        y = np.concatenate([near[real], np.full(len(ids), ids[0])])
        d = np.concatenate([dist[real], distances(vecs, vecs[:1])[:, 0]])
        n = len(x)
        head = _head(table)
        return pa.Table.from_pydict(
            {c: v.take(pa.array(np.zeros(n, np.int64))) for c, v in head.items()} | {"x": pa.array(x), "y": pa.array(y), "d": pa.array(d), "core": pa.array(core[np.searchsorted(ids, x)])}
        )

    return run


def _state(table: pa.Table, prefix: str, column: str, kind) -> np.ndarray:
    return table.column(f"{prefix}{column}").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)


def _lookers(dim: int):
    """Points of a block whose core distance is below the bound of their component."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(n, 1)])
                core, comp, bound = joined(row, "core", "<f8"), _state(row, "", "comp", np.int64), _state(row, "", "bound", np.float64)
                looks = core < bound
                if looks.any():
                    cols = {c: row.column(c).combine_chunks() for c in KEYS}
                    cols |= {"m": pa.array([int(looks.sum())], pa.int64()), "reach": pa.array([float(bound[looks].max())])}
                    cols |= {"ids": _i8(joined(row, "ids", "<i8")[looks]), "vecs": _f8(joined(row, "vecs", "<f8").reshape(-1, dim)[looks])}
                    cols |= {"core": _f8(core[looks]), "comp": _i8(comp[looks]), "bound": _f8(bound[looks])}
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def _only(p: Points, comp: np.ndarray) -> np.ndarray:
    """The component of a leaf whose points are all in one, else -1."""
    low, high = np.minimum.reduceat(comp, p.starts[:-1]), np.maximum.reduceat(comp, p.starts[:-1])
    return np.where(low == high, low, -1)


def _ways_out(dim: int):
    """Per component of the lookers a the cheapest edge to another one in the group b, if below its bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = points_of(left, dim), points_of(right, dim, "b_", "b")
        core, comp, bound = joined(left, "core", "<f8"), joined(left, "comp", "<i8"), joined(left, "bound", "<f8")
        b_core, b_comp = joined(right, "b_core", "<f8"), _state(right, "b_", "comp", np.int64)
        names, number = np.unique(comp, return_inverse=True)
        best = np.full(len(names), np.inf)
        best[number] = bound  # one bound per component
        kept: dict[int, tuple] = {}
        only_a, only_b = _only(a, comp), _only(b, b_comp)
        may = leaf_gaps(a, b) <= left.column("reach").to_numpy()[:, None]
        may &= np.minimum.reduceat(b_core, b.starts[:-1])[None, :] < left.column("reach").to_numpy()[:, None]
        may &= (only_a[:, None] != only_b[None, :]) | (only_a[:, None] < 0)
        for rows, cols in to_compare(a, b, may):
            rows = rows[core[rows] < best[number[rows]]]
            if not len(rows):
                continue
            x, y = a.vecs[rows], b.vecs[cols]
            w, slack = squares(x, y), rounding(x, y)
            np.maximum(w, (core[rows] ** 2)[:, None], out=w)
            np.maximum(w, (b_core[cols] ** 2)[None, :], out=w)
            w[comp[rows][:, None] == b_comp[cols][None, :]] = np.inf
            # of a component only the cheapest, and what rounding cannot tell from it
            cheapest, limit = w.min(axis=1), best.copy() ** 2
            np.minimum.at(limit, number[rows], cheapest)
            limit = limit[number[rows]] * (1 + 1e-12) + 2 * slack
            some = np.flatnonzero((cheapest <= limit) & np.isfinite(cheapest))
            i, j = np.nonzero(w[some] <= limit[some][:, None])
            i = some[i]
            d = np.maximum(exact(x[i], y[j]), np.maximum(core[rows[i]], b_core[cols[j]]))
            ids, b_ids, of = a.ids[rows[i]], b.ids[cols[j]], number[rows[i]]
            order = np.lexsort((np.maximum(ids, b_ids), np.minimum(ids, b_ids), d, of))
            order = order[np.flatnonzero(np.diff(of[order], prepend=-1))] if len(order) else order
            for at in order:
                if d[at] < best[of[at]]:
                    best[of[at]] = d[at]
                    p, q, cx, cy = ids[at], b_ids[at], names[of[at]], b_comp[cols[j[at]]]
                    kept[of[at]] = (min(p, q), max(p, q), d[at], cx if p < q else cy, cy if p < q else cx)
        cols = list(zip(*kept.values(), strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_pydict({c: pa.array([v.item() for v in col], k) for c, col, k in zip(("lo", "hi", "w", "c_lo", "c_hi"), cols, kinds, strict=True)})

    return run


def _each_end(edges: DataFrame) -> DataFrame:
    return edges.select("*", F.explode(F.array("c_lo", "c_hi")).alias("comp"))


def spanning_tree(tree: Tree, cores: DataFrame, vectors: DataFrame, groups: Groups) -> DataFrame:
    """(lo, hi, w): a minimum spanning tree of every part under mutual reachability.

    ``vectors`` is (rep, vec) of all points. The weights are the same whichever tree is taken.
    """
    met = materialize(
        cores.groupBy(*KEYS).applyInArrow(_points_and_edges(tree.dim), f"part {tree.part_type}, node long, x long, y long, d double, core double"),
        "near-edges",
    )
    points = materialize(met.groupBy(*KEYS, "x").agg(F.first("core").alias("core")).withColumnRenamed("x", "rep"), "points")
    core_of = points.select("rep", "core")
    # the first point of every leaf to that of its group, and those to the first of the part: with the leaves' own edges all are connected
    firsts = points.groupBy(*KEYS).agg(F.min("rep").alias("x")).join(groups.of_leaf.select(*KEYS, "grp"), KEYS)
    of_group = firsts.groupBy("part", "grp").agg(F.min("x").alias("y"))
    of_part = of_group.groupBy("part").agg(F.min("y").alias("top"))
    links = firsts.join(of_group, ["part", "grp"]).select("x", "y").union(of_group.join(of_part, "part").select(F.col("y").alias("x"), F.col("top").alias("y")))
    ends = links.where("x != y").join(vectors.select(F.col("rep").alias("x"), F.col("vec").alias("vx")), "x").join(
        vectors.select(F.col("rep").alias("y"), F.col("vec").alias("vy")), "y"
    )
    gap = F.aggregate(F.zip_with("vx", "vy", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    edges = met.select("x", "y", "d").union(ends.select("x", "y", F.sqrt(gap).alias("d")))
    reachable = (
        edges.where("x != y").join(core_of.select(F.col("rep").alias("x"), F.col("core").alias("cx")), "x")
        .join(core_of.select(F.col("rep").alias("y"), F.col("core").alias("cy")), "y")
        .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), F.greatest("d", "cx", "cy").alias("w"))
        # found from both ends, with the same weight but for the last bit
        .groupBy("lo", "hi").agg(F.min("w").alias("w"))
    )
    edges = materialize(reachable.withColumns({"c_lo": F.col("lo"), "c_hi": F.col("hi")}), "edges")
    comps = materialize(points.withColumn("comp", F.col("rep")), "components")
    found = None
    while not edges.isEmpty():
        bounds = materialize(_each_end(edges).groupBy("comp").agg(F.min("w").alias("bound")), "bounds")
        state = materialize(comps.join(bounds, "comp", "left").select(*KEYS, "rep", "comp", "core", F.coalesce("bound", F.lit(0.0)).alias("bound")), "state")
        packed = state.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rep", "comp", "bound"))).alias("state"))
        blocks = cores.select(*KEYS, "ids", "core", "vecs").join(packed, KEYS)
        blocks = materialize(blocks.select(*KEYS, "ids", "core", "vecs", F.col("state.comp").alias("comp"), F.col("state.bound").alias("bound")), "blocks")
        look = blocks.mapInArrow(_lookers(tree.dim), f"part {tree.part_type}, node long, m long, reach double, ids binary, vecs binary, core binary, comp binary, bound binary")
        out = search(groups, look, blocks.drop("bound"), True, _ways_out(tree.dim), "lo long, hi long, w double, c_lo long, c_hi long")
        edges = materialize(edges.unionByName(out).groupBy("lo", "hi", "c_lo", "c_hi").agg(F.min("w").alias("w")), "edges")
        picks = _each_end(edges).groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "c_lo", "c_hi")).alias("p"))
        picked = materialize(picks.select("p.*").distinct(), "picked")
        found = picked if found is None else found.unionByName(picked)
        roots = connected_components(picked, "c_lo", "c_hi")
        old = materialize(roots.withColumnRenamed("node", "old"), "merged")
        renamed = comps.join(old.withColumnRenamed("old", "comp"), "comp", "left")
        comps = materialize(renamed.select(*KEYS, "rep", "core", F.coalesce("root", "comp").alias("comp")), "components")
        moved = edges.join(old.select(F.col("old").alias("c_lo"), F.col("root").alias("r_lo")), "c_lo", "left").join(
            old.select(F.col("old").alias("c_hi"), F.col("root").alias("r_hi")), "c_hi", "left"
        )
        moved = moved.select("lo", "hi", "w", F.coalesce("r_lo", "c_lo").alias("c_lo"), F.coalesce("r_hi", "c_hi").alias("c_hi"))
        edges = materialize(moved.where("c_lo != c_hi").select("lo", "hi", "c_lo", "c_hi", "w"), "edges")
    empty = cores.sparkSession.createDataFrame([], "lo long, hi long, w double")
    return empty if found is None else found.select("lo", "hi", "w")


# --- tree of clusters ----------------------------------------------------------------------------

# kind 0: component left over (id, size, cluster, s, best, level); 1: point or component ``id`` joined
# ``cluster``; 2: ``cluster`` closed under ``up`` (null: it is the whole part), chosen or not
_EVENTS = "kind int, id long, size long, cluster long, s double, best double, level double, up long, chosen boolean"
_EVENT_COLUMNS = [c.split()[0] for c in _EVENTS.split(",")]


class _Forest:
    """Merges the edges of one component in rising order, level by level.

    A cluster's ``s`` is the sum of 1 / distance over its points, each at the distance at which it
    came; when it ends at distance d its stability is ``s`` less its size / d. ``best`` is the best
    total of the clusters below it.
    """

    def __init__(self, nodes: list[dict], min_size: int) -> None:
        self.min_size, self.out = min_size, []
        self.up = {n["id"]: n["id"] for n in nodes}
        self.node = {n["id"]: dict(n) for n in nodes}
        self.small = {n["id"]: [n["id"]] for n in nodes if n["cluster"] is None}

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _join(self, root: int, cluster: int) -> None:
        self.out += [{"kind": 1, "id": m, "cluster": cluster} for m in self.small.pop(root)]

    def form(self, root: int, below: float) -> None:
        """Copies of one vector that are a cluster by themselves before the level ``below``."""
        n = self.node[root]
        if n["cluster"] is None and n["size"] >= self.min_size and n["level"] < below:
            n["cluster"], n["s"], n["best"] = -1 - root, n["size"] / max(n["level"], NEAREST), 0.0
            self._join(root, n["cluster"])

    def level(self, edges: list[tuple[int, int, int]], d: float) -> None:
        """Merges all edges (lo, hi, number) of weight d."""
        groups: dict[int, list[int]] = {}
        first: dict[int, int] = {}
        local: dict[int, int] = {}

        def find(i: int) -> int:
            while local[i] != i:
                local[i] = local[local[i]]
                i = local[i]
            return i

        for lo, hi, number in edges:
            a, b = self.find(lo), self.find(hi)
            for r in (a, b):
                if r not in local:
                    local[r] = r
                    self.form(r, d)
            a, b = sorted((find(a), find(b)))
            local[b] = a
            first[a] = min(first.get(a, number), first.get(b, number), number)
        for r in local:
            groups.setdefault(find(r), []).append(r)
        for head, roots in groups.items():
            if len(roots) > 1:
                self._merge(roots, first[head], d)

    def _merge(self, roots: list[int], number: int, d: float) -> None:
        density = 1 / max(d, NEAREST)
        parts = [self.node[r] for r in roots]
        size, grown = sum(p["size"] for p in parts), [r for r in roots if self.node[r]["cluster"] is not None]
        loose = [r for r in roots if self.node[r]["cluster"] is None]
        root = min(roots)
        cluster, s, best = None, 0.0, 0.0
        if len(grown) == 1:
            one = self.node[grown[0]]
            cluster, s, best = one["cluster"], one["s"] + (size - one["size"]) * density, one["best"]
        elif grown or size >= self.min_size:
            cluster, s = number, size * density
            for r in grown:
                p = self.node[r]
                mine = p["s"] - p["size"] * density
                chosen = mine >= p["best"]
                best += max(mine, p["best"])
                self.out.append({"kind": 2, "cluster": p["cluster"], "s": mine, "size": p["size"], "up": number, "chosen": chosen})
        if cluster is not None:
            for r in loose:
                self._join(r, cluster)
        else:
            self.small[root] = [m for r in loose for m in self.small.pop(r)]
        for r in roots:
            self.up[r] = root
        self.node[root] = {"id": root, "size": size, "cluster": cluster, "s": s, "best": best, "level": d}

    def rest(self) -> list[dict]:
        return self.out + [{"kind": 0, **self.node[i]} for i in self.up if self.up[i] == i]


def _merge_group(min_size: int, last: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        forest = _Forest(left.select(["id", "size", "cluster", "s", "best", "level"]).to_pylist(), min_size)
        lo, hi, w, number = (right.column(c).to_numpy() for c in ("lo", "hi", "w", "number"))
        order = np.lexsort((number, w))
        cuts = np.flatnonzero(np.diff(w[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            forest.level(list(zip(lo[at].tolist(), hi[at].tolist(), number[at].tolist(), strict=True)), float(w[at[0]]))
        if last:
            for i in list(forest.up):
                if forest.up[i] == i:
                    forest.form(i, float("inf"))
        rows = forest.rest()
        if last:
            rows += [{"kind": 2, "cluster": r["cluster"], "s": r["s"], "size": r["size"]} for r in rows if r["kind"] == 0 and r["cluster"] is not None]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.Table.from_pydict({c: pa.array([r.get(c) for r in rows], k) for c, k in zip(_EVENT_COLUMNS, kinds, strict=True)})

    return run


def cluster_tree(points: DataFrame, edges: DataFrame, min_size: int, window: int = WINDOW_EDGES) -> tuple[DataFrame, DataFrame]:
    """Of (part, rep, w, core) and the spanning tree: (rep, cluster) and (cluster, up, size, s, chosen).

    A point belongs to the cluster that it meets first on the way to lower densities; no row if it
    meets none. ``s`` is the stability, ``chosen`` says that no better clusters lie below; the whole
    of a part is never chosen.
    """
    edges = materialize(with_ids(edges.select("lo", "hi", "w"), "number", ["w", "lo", "hi"]), "tree-edges")
    part_of = points.select(F.col("rep").alias("lo"), "part")
    edges = materialize(edges.join(part_of, "lo").select("part", "lo", "hi", "w", "number"), "tree-edges")
    none = [F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")]
    nodes = materialize(points.select("part", F.col("rep").alias("id"), F.col("w").alias("size"), *none, F.col("core").alias("level")), "tree-nodes")
    pending = points.select("rep", F.col("rep").alias("holder"))
    joined, closed = None, None
    while True:
        per_part = edges.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        last = per_part <= window
        if last:
            # the tree spans its part
            now, of = edges, nodes.select("part", F.col("id").alias("old"), F.lit(0).cast("long").alias("root"))
        else:
            now, of = _window(edges, nodes, window)
        members = nodes.join(of.select(F.col("old").alias("id"), "root"), "id")
        inside = now.join(of.select(F.col("old").alias("lo"), "root"), "lo").select(
            F.col("part").alias("e_part"), F.col("root").alias("e_root"), "lo", "hi", "w", "number"
        )
        events = materialize(
            members.groupBy("part", "root").cogroup(inside.groupBy("e_part", "e_root")).applyInArrow(_merge_group(min_size, last), _EVENTS), "merged"
        )
        met = events.where("kind = 1").select(F.col("id").alias("holder"), "cluster")
        moved = pending.join(met, "holder", "left").join(of.select(F.col("old").alias("holder"), "root"), "holder", "left")
        moved = materialize(moved.select("rep", "holder", "cluster", "root"), "pending")
        new = moved.where("cluster IS NOT NULL").select("rep", "cluster")
        joined = new if joined is None else joined.unionByName(new)
        ended = events.where("kind = 2").select("cluster", "up", "size", "s", "chosen")
        closed = ended if closed is None else closed.unionByName(ended)
        if last:
            return joined, closed
        pending = moved.where("cluster IS NULL").select("rep", F.coalesce("root", "holder").alias("holder"))
        left_over = events.where("kind = 0").select("id", "size", "cluster", "s", "best", "level")
        parts = nodes.select("part", "id")
        kept = nodes.join(of.select(F.col("old").alias("id")), "id", "left_anti")
        nodes = materialize(kept.unionByName(left_over.join(parts, "id")), "tree-nodes")
        late = edges.join(now.select("number"), "number", "left_anti")
        for end in ("lo", "hi"):
            late = late.join(of.select(F.col("old").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(
                end, F.coalesce(f"{end}_root", end)
            ).drop(f"{end}_root")
        edges = materialize(late.select("part", "lo", "hi", "w", "number"), "tree-edges")


def _window(edges: DataFrame, nodes: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The lightest edges whose components hold at most ``window`` of them, and (old, root, part) of
    the nodes they touch. Edges of equal weight stay together."""
    share = 0.5
    while True:
        limit = edges.agg(F.percentile_approx("w", share, 10_000)).first()[0]
        least = edges.agg(F.min("w")).first()[0]
        now = edges.where(F.col("w") <= limit)
        roots = materialize(connected_components(now, "lo", "hi"), "window-roots")
        ends = now.select(F.explode(F.array("lo", "hi")).alias("old")).distinct()
        of = materialize(
            ends.join(roots.withColumnRenamed("node", "old"), "old", "left").select("old", F.coalesce("root", "old").alias("root")), "window-nodes"
        )
        largest = now.join(of.withColumnRenamed("old", "lo"), "lo").groupBy("root").count().agg(F.max("count")).first()[0]
        if largest <= window or limit == least:
            return now, of
        share /= 2


def chosen_clusters(clusters: DataFrame) -> DataFrame:
    """(cluster, label): the highest chosen cluster at or above each; null if there is none.

    Paths are doubled, so the rounds grow with the logarithm of the depth.
    """
    mine = F.when(F.col("up").isNotNull() & F.col("chosen"), F.col("cluster"))
    state = materialize(clusters.select("cluster", "up", mine.alias("label")), "climb")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("label").alias("higher"))
        state = materialize(state.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "label").alias("label")), "climb")
    return state.select("cluster", "label")


# --- the whole -----------------------------------------------------------------------------------


def unit_points(df: DataFrame, id_col: str, vec_col: str, partition_col: str | None) -> tuple[DataFrame, DataFrame]:
    """(id, part, vec) of all rows, and stored (part, rep, w, vec) of the distinct unit vectors."""
    part = F.col(partition_col) if partition_col else F.lit(0)
    rows = df.select(part.alias("part"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("vec", F.when(length > 0, F.transform("vec", lambda x: x / length)))
    reps = rows.where("vec IS NOT NULL").groupBy("part", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    return rows, materialize(reps.select("part", "rep", "w", "vec"), "reps")


def hierarchy_edges(
    df: DataFrame, id_col: str, vec_col: str, min_pts: int, partition_col: str | None = None, leaf: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """The spanning tree (lo, hi, w) over distinct unit vectors, named by their smallest ids, and the
    stored points (part, rep, w, core)."""
    _, reps = unit_points(df, id_col, vec_col, partition_col)
    return _edges(reps, min_pts, leaf)


def _edges(reps: DataFrame, min_pts: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    tree = build(reps, max(leaf, 4 * min_pts))
    groups = group_leaves(tree)
    cores, _ = with_core_distances(tree, min_pts, groups)
    edges = materialize(spanning_tree(tree, cores, reps.select("rep", "vec"), groups), "spanning-tree")
    core = cores.select(F.explode(_unpacked("ids", "core")).alias("p")).select(F.col("p.id").alias("rep"), "p.value")
    points = reps.select("part", "rep", "w").join(core, "rep").select("part", "rep", "w", F.col("value").alias("core"))
    return edges, materialize(points, "core-points")


def _unpacked(ids: str, values: str):
    @F.arrow_udf("array<struct<id long, value double>>")
    def run(i: pa.Array, v: pa.Array) -> pa.Array:
        rows = [
            [{"id": a, "value": b} for a, b in zip(_ints(x.as_py()).tolist(), _floats(y.as_py()).tolist(), strict=True)] for x, y in zip(i, v, strict=True)
        ]
        return pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("value", pa.float64())])))

    return run(F.col(ids), F.col(values))


def density_hierarchy(
    df: DataFrame, id_col: str, vec_col: str, min_size: int, min_pts: int | None = None, partition_col: str | None = None,
    label_col: str = "cluster_id", leaf: int = 1024, window: int = WINDOW_EDGES,
) -> DataFrame:
    """(id, [partition,] label) of all rows: clusters numbered from 0 by their smallest id, noise -1.

    Vectors are compared by their direction. ``min_pts`` others, ``min_size`` if not given, make a
    point's core distance; ``leaf`` and ``window`` set task sizes, not the result. Rows without a
    direction are noise. Every partition is clustered by itself.
    """
    if min_size < 2:
        raise ValueError("min_size must be 2 or more")
    rows, reps = unit_points(df, id_col, vec_col, partition_col)
    keep = [F.col("id").alias(id_col), F.coalesce("number", F.lit(NOISE)).cast("int").alias(label_col)]
    keep += [F.col("part").alias(partition_col)] if partition_col else []
    if reps.isEmpty():
        return rows.withColumn("number", F.lit(None)).select(*keep)
    edges, points = _edges(reps, min_pts or min_size, leaf)
    joined, clusters = cluster_tree(points, edges, min_size, window)
    found = joined.join(chosen_clusters(clusters), "cluster").where("label IS NOT NULL").select("rep", "label")
    found = materialize(found.join(reps.select("rep", "part"), "rep"), "labels")
    order = with_ids(found.groupBy("part", "label").agg(F.min("rep").alias("rep")), "seq", ["part", "rep"])
    first = order.groupBy("part").agg(F.min("seq").alias("first"))
    numbers = order.join(first, "part").select("label", (F.col("seq") - F.col("first")).alias("number"))
    numbered = found.join(numbers, "label").select("rep", "number")
    by_vec = reps.join(numbered, "rep").select("part", "vec", "number")
    return rows.join(by_vec, ["part", "vec"], "left").select(*keep)
