"""Density clustering of vectors, centroids.

The clustering is DBSCAN* (Campello, Moulavi, Sander 2013) on cosine similarity: a vector is core
when at least ``min_pts`` vectors, itself included, are as similar as ``min_cos``; clusters are the
connected components of core vectors; everything else is noise.

It is exact and never writes out all pairs:

* equal vectors become one weighted point;
* points are in the leaves of a metric tree, and side by side leaves in groups of bounded size; a
  group looks through itself first, and only what is still open is sent to other groups: points
  that have not met ``min_pts`` neighbours, points outside of the largest component;
* leaves and groups meet only if their centres and radii allow a neighbour; leaves so near that all
  their points are neighbours are counted, not compared;
* a task returns neighbour weights of open points, later one link per component and group.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.operators.metric_tree import (
    Groups, Points, Tree, build, each_pair_once, group_leaves, in_groups, joined, leaf_gaps, points_of, rounding, search, to_compare, unpacked_ids,
)
from callgrain.plans.components import connected_components
from callgrain.plans.ids import with_ids
from callgrain.plans.skew import skew_join
from callgrain.session import materialize

# the task functions travel with the job: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOISE = -1
# Guards the pruning bounds, not the comparison itself, against rounding.
_SLACK = 1e-9
# A similarity equal to the limit counts, however the product was rounded.
_TIE = 1e-12


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _whole_parts(points: DataFrame):
    """Every partition as one comparison with itself."""
    zero = F.lit(0)
    return points.select(
        "part", *[zero.alias(c) for c in (*_TASK[1:], "side")], "rep", "w", "vec"
    ).groupBy("part")


def _with_degree(cells: DataFrame, degrees: DataFrame, min_pts: int) -> DataFrame:
    return cells.join(degrees.where(F.col("deg") >= min_pts).select("rep"), "rep", "left_semi")


_TASK = ["part", "a_cell", "a_blk", "b_cell", "b_blk"]
_ROWS = 1024  # rows compared at once inside a task


def _degrees_of(xa, wa, xb, wb, alone: bool, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour weights of the points of two blocks, or of one block with itself."""
    deg_a, deg_b = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    for at in range(0, len(xa), _ROWS):
        near = xa[at : at + _ROWS] @ xb.T >= limit
        if alone:
            # a point is its own neighbour whatever the rounding of its length
            rows = np.arange(near.shape[0])
            near[rows, at + rows] = True
        deg_a[at : at + _ROWS] = near @ wb
        if not alone:
            deg_b += wa[at : at + _ROWS] @ near
    return deg_a, deg_b


def _links_of(xa, ids_a, xb, ids_b, alone: bool, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """One link per point to the smallest id of its component within the two blocks."""
    new_a, new_b = np.ones(len(xa), bool), np.ones(len(xb), bool)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for seed in range(len(xa)):
        if not new_a[seed]:
            continue
        new_a[seed] = False
        front, in_a, in_b = np.array([seed]), [np.array([seed])], []
        while len(front):
            # every row is compared once over the whole search
            hit = np.zeros(len(xb), bool)
            for at in range(0, len(front), _ROWS):
                hit |= (xa[front[at : at + _ROWS]] @ xb.T >= limit).any(axis=0)
            if alone:
                front = np.flatnonzero(hit & new_a)
                new_a[front] = False
            else:
                found = np.flatnonzero(hit & new_b)
                new_b[found] = False
                in_b.append(found)
                back = np.zeros(len(xa), bool)
                for at in range(0, len(found), _ROWS):
                    back |= (xb[found[at : at + _ROWS]] @ xa.T >= limit).any(axis=0)
                front = np.flatnonzero(back & new_a)
                new_a[front] = False
            in_a.append(front)
        members = np.concatenate([ids_a[np.concatenate(in_a)], *(ids_b[f] for f in in_b)])
        root = members.min()
        others = members[members != root]
        src.append(others)
        dst.append(np.full(len(others), root))
    return np.concatenate(src).astype("int64"), np.concatenate(dst).astype("int64")


def _degrees(min_cos: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = _stack(pdf["vec"]), pdf["w"].to_numpy()
        return pd.DataFrame({"rep": pdf["rep"], "deg": _degrees_of(x, w, x, w, True, min_cos - _TIE)[0]})

    return run


def _links(min_cos: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _stack(pdf["vec"]), pdf["rep"].to_numpy()
        src, dst = _links_of(x, ids, x, ids, True, min_cos - _TIE)
        return pd.DataFrame({"src": src, "dst": dst})

    return run


def _reach(min_cos: float) -> float:
    """Neighbours are no further apart: the comparison allows for rounding of the cosine, so the bound allows for more."""
    return math.sqrt(2 - 2 * min_cos + 4 * _TIE) + _SLACK


def _count(a: Points, b: Points, weights: np.ndarray, deg: np.ndarray, may: np.ndarray, limit: float, enough: int, alone: bool) -> None:
    """Adds to ``deg`` the neighbour weights in b, point by point until there are enough."""
    weights, a_leaf, b_leaf = weights.astype(np.float64), a.leaf, b.leaf
    for rows, cols in to_compare(a, b, may):
        rows = rows[deg[rows] < enough]
        if len(rows):
            near = a.vecs[rows] @ b.vecs[cols].T >= limit
            some = near.any(axis=1)
            rows, near = rows[some], near[some]
            if alone:
                # leaves that have been counted already may be among them
                near &= may[np.ix_(a_leaf[rows], b_leaf[cols])] & (rows[:, None] != cols[None, :])
            deg[rows] += (near.astype(np.float64) @ weights[cols]).astype(np.int64)


def _slices(p: Points, values: np.ndarray, kind: str, keep: np.ndarray) -> pa.Array:
    """The kept values of every leaf, packed."""
    return pa.array([values[s:t][keep[s:t]].astype(kind).tobytes() for s, t in zip(p.starts[:-1], p.starts[1:], strict=True)], pa.binary())


def _sums(p: Points, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), p.starts[:-1])


def _group_degrees(min_cos: float, min_pts: int, dim: int):
    """Core points that a group tells by itself, and the others with their neighbours' weight so far."""

    def run(table: pa.Table) -> pa.Table:
        p, w = points_of(table, dim), joined(table, "weights", "<i8")
        # a point is its own neighbour whatever the rounding of its length
        deg, limit = w.copy(), min_cos - _TIE
        own = np.eye(len(p.node), dtype=bool)
        low = leaf_gaps(p, p)
        high = low + 2 * (p.radius[:, None] + p.radius[None, :]) + 3 * _SLACK + 2 * math.sqrt(rounding(p.centre, p.centre))
        sure = (high < math.sqrt(2 - 2 * min_cos)) & ~own
        deg += (sure @ _sums(p, w))[p.leaf]
        _count(p, p, w, deg, own, limit, min_pts, True)
        waiting = _sums(p, deg < min_pts) > 0
        _count(p, p, w, deg, (low <= _reach(min_cos)) & ~own & ~sure & waiting[:, None], limit, min_pts, True)
        core = deg >= min_pts
        return pa.table(
            {"part": table.column("part"), "node": table.column("node"), "core": _slices(p, p.ids, "<i8", core), "m": _sums(p, ~core),
             "ids": _slices(p, p.ids, "<i8", ~core), "vecs": _slices(p, p.vecs, "<f8", ~core), "deg": _slices(p, deg, "<i8", ~core)}
        )

    return run


def _more_degrees(min_cos: float, min_pts: int, dim: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = points_of(left, dim), points_of(right, dim, "b_", "b")
        had = joined(left, "deg", "<i8")
        deg = had.copy()
        # of the groups that look together, this one has counted itself
        may = (leaf_gaps(a, b) <= _reach(min_cos)) & (a.grp != b.grp[0])[:, None]
        _count(a, b, joined(right, "b_weights", "<i8"), deg, may, min_cos - _TIE, min_pts, False)
        more = deg > had
        return pa.table({"rep": a.ids[more], "deg": (deg - had)[more]})

    return run


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components i[k] and j[k] become one; ``label`` is the smallest of those that are one."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return label
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up


def _linked(a: Points, of_a: np.ndarray, b: Points, of_b: np.ndarray, label: np.ndarray, may: np.ndarray, limit: float) -> np.ndarray:
    """Components that have neighbours in a and b become one. What is one already is not compared again:
    points of the most frequent one only meet the others."""
    for rows, cols in each_pair_once(a, may) if a is b else to_compare(a, b, may):
        at, to = label[of_a[rows]], label[of_b[cols]]
        most = np.bincount(to).argmax()
        for r, c in ((rows[at != most], cols), (rows[at == most], cols[to != most])):
            if len(r) and len(c):
                # places in one long row: looking for them row by row takes longer than the products
                near = np.flatnonzero((a.vecs[r] @ b.vecs[c].T >= limit).ravel())
                if len(near):
                    i, j = np.divmod(near, len(c))
                    label = _merged(label, of_a[r[i]], of_b[c[j]])
    return label


# Core points of a group that ask the other groups first, so that large components are one early.
PROBES = 64


def _group_links(min_cos: float, dim: int):
    """The core points of a group, each with the smallest id of its component within the group."""

    def run(table: pa.Table) -> pa.Table:
        every = points_of(table, dim)
        told = [joined(table, "core", "<i8"), table.column("late").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
        core = np.isin(every.ids, np.concatenate(told))
        starts = np.concatenate([[0], np.cumsum(_sums(every, core))])
        p = every._replace(starts=starts, ids=every.ids[core], vecs=every.vecs[core])
        names, number = np.unique(p.ids, return_inverse=True)
        may = leaf_gaps(p, p) <= _reach(min_cos)
        # as near one way as the other, however the bound was rounded
        label = _linked(p, number, p, number, np.arange(len(names)), may | may.T, min_cos - _TIE)
        comp = names[label[number]]
        probe = np.zeros(len(comp), bool)
        if len(comp):
            large = np.flatnonzero(label[number] == np.bincount(label[number]).argmax())
            probe[large[:: -(-len(large) // PROBES)]] = True
        w, keep = joined(table, "weights", "<i8")[core], np.ones(len(comp), bool)
        held = [np.unique(comp[s:t], return_counts=True) for s, t in zip(starts[:-1], starts[1:], strict=True)]
        out = pa.table(
            {"part": table.column("part"), "node": table.column("node"), "n": np.diff(starts), "ids": _slices(p, p.ids, "<i8", keep),
             "weights": _slices(p, w, "<i8", keep), "vecs": _slices(p, p.vecs, "<f8", keep), "comp": _slices(p, comp, "<i8", keep),
             "probe": _slices(p, probe, "?", keep), "has": pa.array([h.tolist() for h, _ in held], pa.list_(pa.int64())),
             "times": pa.array([t.tolist() for _, t in held], pa.list_(pa.int64()))}
        )
        return out.filter(pa.array(np.diff(starts) > 0))

    return run


def _now(table: pa.Table, p: Points, prefix: str) -> np.ndarray:
    """The components of the points by the names that have been given to them since."""
    comp, was, now = (joined(table, f"{prefix}comp", "<i8"), *(
        table.column(f"{prefix}{c}").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("old", "new")
    ))
    if not len(was):
        return comp
    order = np.argsort(was)
    was, now = was[order], now[order]
    at = np.minimum(np.searchsorted(was, comp), len(was) - 1)
    return np.where(was[at] == comp, now[at], comp)


def _seekers(reach: float, dim: int):
    """Core points that look for links: probes, or all outside of the largest component of their part."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                ids = joined(row, "ids", "<i8")
                p = Points(*[None] * 4, np.array([0, len(ids)]), ids, joined(row, "vecs", "<f8").reshape(-1, dim))
                comp, largest = _now(row, p, ""), row.column("largest")[0].as_py()
                looks = joined(row, "probe", "?") if largest is None else comp != largest
                if looks.any():
                    cols = {c: row.column(c).combine_chunks() for c in ("part", "node")}
                    cols |= {"m": pa.array([int(looks.sum())], pa.int64()), "reach": pa.array([reach])}
                    cols |= {"ids": _slices(p, p.ids, "<i8", looks), "vecs": _slices(p, p.vecs, "<f8", looks), "comp": _slices(p, comp, "<i8", looks)}
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def _more_links(min_cos: float, dim: int):
    """Pairs of components that have neighbours in a and b."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = points_of(left, dim), points_of(right, dim, "b_", "b")
        comp_a, comp_b = joined(left, "comp", "<i8"), _now(right, b, "b_")
        names, number = np.unique(np.concatenate([comp_a, comp_b]), return_inverse=True)
        label = _linked(a, number[: len(comp_a)], b, number[len(comp_a) :], np.arange(len(names)), leaf_gaps(a, b) <= _reach(min_cos), min_cos - _TIE)
        moved = label != np.arange(len(names))
        return pa.table({"src": names[moved], "dst": names[label[moved]]})

    return run


def _tree_core(tree: Tree, groups: Groups, min_cos: float, min_pts: int) -> DataFrame:
    """(part, node, ids, weights, vecs, core, late): the leaves, and which of their points are core."""
    kind, dim = tree.part_type, tree.dim
    blocks = tree.leaves.select("part", "node", "ids", "weights", "vecs")
    schema = f"part {kind}, node long, core binary, m long, ids binary, vecs binary, deg binary"
    first = materialize(in_groups(groups, blocks, _group_degrees(min_cos, min_pts, dim), schema), "degrees")
    waiting = first.where("m > 0").select("part", "node", "m", "ids", "vecs", "deg", F.lit(_reach(min_cos)).alias("reach"))
    more = search(groups, waiting, blocks, False, _more_degrees(min_cos, min_pts, dim), "rep long, deg long")
    had = waiting.select("part", "node", F.explode(F.arrays_zip(unpacked_ids("ids").alias("rep"), unpacked_ids("deg").alias("deg"))).alias("p"))
    total = had.select("part", "node", "p.rep", "p.deg").join(more.groupBy("rep").agg(F.sum("deg").alias("more")), "rep")
    late = total.where(F.col("deg") + F.col("more") >= min_pts).groupBy("part", "node").agg(F.collect_list("rep").alias("late"))
    return blocks.join(first.select("part", "node", "core"), ["part", "node"]).join(late, ["part", "node"], "left")


def _tree_components(tree: Tree, min_cos: float, min_pts: int) -> tuple[DataFrame, DataFrame]:
    """Core points (part, rep, w, comp), and (node, root) of their components that are part of others.

    Components grow within the groups, then a few points of the largest one of each group ask the other
    groups, then all points outside of the largest component of their part do: of two neighbours in
    different components, one is outside of it.
    """
    kind, dim, keys = tree.part_type, tree.dim, ["part", "node"]
    groups = group_leaves(tree)
    schema = (
        f"part {kind}, node long, n long, ids binary, weights binary, vecs binary, comp binary, probe binary, has array<long>, times array<long>"
    )
    core = materialize(in_groups(groups, _tree_core(tree, groups, min_cos, min_pts), _group_links(min_cos, dim), schema), "core-blocks")
    held = core.select("part", "node", F.explode(F.arrays_zip("has", "times")).alias("h")).select(*keys, F.col("h.has").alias("comp"), "h.times")
    held = materialize(held, "held")
    links = roots = tree.leaves.sparkSession.createDataFrame([], "src long, dst long")
    for largest_known in () if groups.pairs.where("a != b").isEmpty() else (False, True):
        roots = connected_components(links) if largest_known else roots.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        renamed = held.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
        named = renamed.where("root IS NOT NULL").groupBy(*keys).agg(F.collect_list("comp").alias("old"), F.collect_list("root").alias("new"))
        sizes = renamed.groupBy("part", F.coalesce("root", "comp").alias("root")).agg(F.sum("times").alias("size"))
        largest = sizes.groupBy("part").agg(F.max(F.struct("size", "root"))["root"].alias("largest"))
        blocks = materialize(core.drop("has", "times", "weights").join(named, keys, "left"), "blocks")
        look = blocks.join(largest, "part") if largest_known else blocks.withColumn("largest", F.lit(None).cast("long"))
        look = look.mapInArrow(_seekers(_reach(min_cos), dim), f"part {kind}, node long, m long, reach double, ids binary, vecs binary, comp binary")
        found = search(groups, look, blocks.select(*keys, "ids", "vecs", "comp", "old", "new"), False, _more_links(min_cos, dim), "src long, dst long")
        links = materialize(links.unionByName(found).distinct(), "links")
    points = core.select("part", F.explode(F.arrays_zip(*[unpacked_ids(c).alias(c) for c in ("ids", "weights", "comp")])).alias("p"))
    return points.select("part", F.col("p.ids").alias("rep"), F.col("p.weights").alias("w"), "p.comp"), connected_components(links)


def density_cluster(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    min_cos: float,
    min_pts: int,
    partition_col: str | None = None,
    label_col: str = "cluster_id",
    block: int = 4096,
) -> DataFrame:
    """(id, [partition,] label): clusters numbered from 0 by their smallest id, noise is -1.

    With ``partition_col`` every partition is clustered by itself and numbered from 0, all of them
    in the same jobs. ``block`` sets task sizes and pruning, not the result.
    ``df`` is read twice, so it should be a stored table.
    """
    if not 0 < min_cos <= 1:
        raise ValueError("min_cos must be in (0, 1]")
    spark = df.sparkSession
    part = F.col(partition_col) if partition_col else F.lit(0)
    points = df.select(
        part.alias("part"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")
    )
    has_length = F.exists("vec", lambda x: x != 0)
    reps = materialize(
        points.where(has_length)
        .groupBy("part", "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")),
        "reps",
    )
    n, total = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    if n == 0:
        return _named(points.select("id", "part", F.lit(NOISE).alias("label")), id_col, partition_col, label_col)

    largest = reps.groupBy("part").count().agg(F.max("count")).first()[0] if partition_col else n
    one_block = largest <= block
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("vec", lambda x: x.cast("double") / length)
    cells = materialize(reps.select("part", "rep", "w", unit.alias("vec")), "points")

    if one_block:
        # every partition is one comparison, and its links end at the root already
        degrees = _whole_parts(cells).applyInPandas(_degrees(min_cos), "rep bigint, deg bigint")
        core = materialize(_with_degree(cells, degrees, min_pts), "core")
        links = _whole_parts(core).applyInPandas(_links(min_cos), "src bigint, dst bigint")
        core = core.withColumn("comp", F.col("rep"))
        comps = links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    else:
        core, comps = _tree_components(build(cells, block), min_cos, min_pts)
        core = materialize(core, "core")
    rooted = core.join(comps.withColumnRenamed("node", "comp"), "comp", "left").select(
        "part", "rep", "w", F.coalesce("root", "comp").alias("root")
    )
    roots = (
        rooted.groupBy("part", "root").agg(F.sum("w").alias("size")).where(F.col("size") >= min_pts)
    ).select("part", "root")
    numbered = with_ids(roots, "seq", ["part", "root"])
    first = numbered.groupBy("part").agg(F.min("seq").alias("first"))
    labels = numbered.join(first, "part").select("root", (F.col("seq") - F.col("first")).cast("int").alias("label"))
    rep_labels = skew_join(rooted.select("rep", "root"), labels, ["root"], ["rep"], "inner", rows=n).select("rep", "label")

    by_vec = reps.select("part", "vec", "rep").join(rep_labels, "rep").select("part", "vec", "label")
    out = skew_join(points, by_vec, ["part", "vec"], ["id"], "left", rows=total).select(
        "id", "part", F.coalesce("label", F.lit(NOISE)).alias("label")
    )
    return _named(out, id_col, partition_col, label_col)


def _named(df: DataFrame, id_col: str, partition_col: str | None, label_col: str) -> DataFrame:
    keep = [F.col("id").alias(id_col), F.col("label").cast("int").alias(label_col)]
    return df.select(*keep, *([F.col("part").alias(partition_col)] if partition_col else []))


def centroids(df: DataFrame, cluster_col: str, vec_col: str, out_col: str = "centroid") -> DataFrame:
    """Mean vector per cluster; partial sums are formed before the shuffle."""
    return df.groupBy(cluster_col).agg(Summarizer.mean(array_to_vector(vec_col)).alias("_mean")).select(
        cluster_col, vector_to_array("_mean").alias(out_col)
    )
