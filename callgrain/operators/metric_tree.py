"""A metric tree over vectors: which blocks of points can be near each other, without comparing all.

Points go down from the root, one level a pass: a node with more points than a task should hold gives
them to the nearest of a few of its own points, its pivots; a smaller one is cut in the same way by one
task, down to leaves. A leaf becomes one row that holds all its vectors, with a centre and a radius.

Two balls are compared by the triangle inequality alone: no two of their points are nearer than the
distance of the centres less both radii, none further than that distance plus both. Consecutive
leaves make groups of bounded size. Groups are paired first; a task gets the points that look for
something and one group, and leaves out the leaves that are too far away. So a vector is sent once
per pair of groups, not once per pair of leaves, and no table of pairs of leaves is written.

A node's number has its parent's in front (base ``FANOUT``), so every table is keyed by
(part, node) and nothing of the tree is held by the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType
from pyspark.sql.window import Window

from callgrain.plans.ids import with_ids
from callgrain.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT, FANOUT_BITS = 16, 4
# Below this level nodes are cut by hash: many equal distances, pivots do not help.
MAX_LEVEL = 10
# Points of one node that one task gives to their pivots, or cuts into leaves.
GROUP_ROWS = 20_000
# Bytes of vectors of a group of leaves, and into how many groups a table is cut that would need fewer.
# A group that would have fewer points than this is not worth a task.
GROUP_BYTES, GROUPS, LEAST_POINTS = 16_000_000, 8, 1_000
# Distances that a task holds at once, and how many of them belong to one point.
TILE_CELLS, TILE_COLUMNS = 2_000_000, 8_192
# Columns of the first tiles of points that are compared with themselves, and how fast they become more.
FIRST_COLUMNS, MORE_COLUMNS = 64, 4
MOST_PARTITIONS = 4_000
KEYS = ["part", "node"]
# Guards the bounds, not the distances themselves, against rounding.
SLACK = 1e-9


class Tree(NamedTuple):
    """``leaves``: part, node, level, n, weight, ids, weights, vecs, centre, radius (one packed row per leaf).
    A stored table."""

    leaves: DataFrame
    depth: int
    dim: int
    part_type: str


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x and y. Differences, not products: exact for near copies."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, x.shape[1] * len(y)))
    for at in range(0, len(x), step):
        gap = x[at : at + step, None, :] - y[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


@F.arrow_udf(DoubleType())
def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.linalg.norm(matrix(a) - matrix(b), axis=1)) if len(a) else pa.array([], pa.float64())


def _to_pivots(left: pa.Table, right: pa.Table) -> pa.Table:
    """Points of a node go to its nearest pivot's child, or by hash where pivots no longer help."""
    node = left.column("node")[0].as_py()
    if level := right.column("by_hash")[0].as_py():
        # other bits on each level
        mixed = left.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        child = (mixed >> np.uint64(64 - FANOUT_BITS * min(level, 15))) % np.uint64(FANOUT)
        child = child.astype(np.int64)
    else:
        vecs, pivots = matrix(left.column("vec")), matrix(right.column("pivots")[0].values)
        child = squares(vecs, pivots).argmin(axis=1)
    return left.set_column(left.column_names.index("node"), "node", pa.array(node * FANOUT + child, pa.int64()))


def _leaves(vecs: np.ndarray, node: int, level: int, leaf: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, node, level) of the leaves below a node that one task holds."""
    todo = [(np.arange(len(vecs)), node, level)]
    while todo:
        rows, node, level = todo.pop()
        n = len(rows)
        if n <= leaf:
            yield rows, node, level
            continue
        many = min(FANOUT, max(2, -(-2 * n // leaf)))
        child = squares(vecs[rows], vecs[rows[np.arange(many) * n // many]]).argmin(axis=1)
        if level >= MAX_LEVEL or np.bincount(child).max() > 0.9 * n:
            # pivots do not help: equal shares
            child = np.arange(n) * many // n
        todo += [(rows[child == c], node * FANOUT + c, level + 1) for c in np.unique(child).tolist()]


def _packed(leaf: int):
    """The leaves of one node, a packed row each."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        vecs, w, reps = matrix(table.column("vec")), table.column("w").to_numpy(), table.column("rep").to_numpy()
        found = list(_leaves(vecs, table.column("node")[0].as_py(), table.column("level")[0].as_py(), leaf))
        centres = [vecs[rows].mean(axis=0) for rows, _, _ in found]
        radii = [float(np.linalg.norm(vecs[rows] - c, axis=1).max()) for (rows, _, _), c in zip(found, centres, strict=True)]
        return pa.Table.from_pydict(
            {"part": table.column("part").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(found), np.int64))),
             "node": pa.array([x[1] for x in found], pa.int64()), "level": pa.array([x[2] for x in found], pa.int32()),
             "n": pa.array([len(x[0]) for x in found], pa.int64()), "weight": pa.array([int(w[x[0]].sum()) for x in found], pa.int64()),
             "ids": pa.array([reps[x[0]].astype("<i8").tobytes() for x in found], pa.binary()),
             "weights": pa.array([w[x[0]].astype("<i8").tobytes() for x in found], pa.binary()),
             "vecs": pa.array([vecs[x[0]].astype("<f8").tobytes() for x in found], pa.binary()),
             "centre": pa.array([c.tolist() for c in centres], pa.list_(pa.float64())), "radius": pa.array(radii, pa.float64())}
        )

    return run


def _above(table: pa.Table) -> pa.Table:
    """A group's centre and radius from those of its leaves."""
    centres, radii, w = matrix(table.column("centre")), table.column("radius").to_numpy(), table.column("weight").to_numpy()
    centre = (centres * w[:, None]).sum(axis=0) / w.sum()
    cols = {
        "part": table.column("part").slice(0, 1).combine_chunks(), "node": table.column("parent").slice(0, 1).combine_chunks(),
        "weight": pa.array([int(w.sum())], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
        "radius": pa.array([float((np.linalg.norm(centres - centre, axis=1) + radii).max())], pa.float64()),
    }
    return pa.Table.from_pydict(cols)


def build(points: DataFrame, leaf: int) -> Tree:
    """The tree of a stored table (part, rep, w, vec) of distinct vectors, a root per part."""
    kind, dim = points.schema["part"].dataType.simpleString(), points.select(F.size("vec")).first()
    names = f"part {kind}, node long, rep long, w long, vec array<double>"
    open_, done, level = points.select("part", F.lit(1).cast("long").alias("node"), "rep", "w", F.col("vec").cast("array<double>").alias("vec")), [], 0
    while True:
        sizes = materialize(open_.groupBy("part", "node").agg(F.count(F.lit(1)).alias("n")), "node-sizes")
        big = sizes.where(F.col("n") > max(leaf, GROUP_ROWS))
        if big.isEmpty():
            done.append(open_.withColumn("level", F.lit(level)))
            break
        keys = ["part", "node"]
        done.append(open_.join(sizes.where(F.col("n") <= max(leaf, GROUP_ROWS)).select(*keys), keys, "left_semi").withColumn("level", F.lit(level)))
        # some points of a node: a limit per group, kept before the shuffle
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("rep"), "rep"))
        pivots = (
            open_.withColumn("nth", first).where(F.col("nth") <= FANOUT).join(big, keys)
            .groupBy(*keys).agg(F.collect_list("vec").alias("pivots"), F.ceil(F.first("n") / GROUP_ROWS).cast("int").alias("salts"))
            .withColumn("by_hash", F.lit(max(0, level + 1 - MAX_LEVEL)))
        )
        # the points of a large node are dealt out over tasks, its pivots repeated for each
        salted = open_.join(pivots.select(*keys, "salts"), keys).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int"))
        told = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        told = told.select(F.col("part").alias("p_part"), F.col("node").alias("p_node"), F.col("salt").alias("p_salt"), "pivots", "by_hash")
        moved = salted.select(*open_.columns, "salt").groupBy(*keys, "salt").cogroup(told.groupBy("p_part", "p_node", "p_salt")).applyInArrow(
            lambda a, b: _to_pivots(a, b).drop_columns(["salt"]), names
        )
        open_, level = materialize(moved, "tree-level"), level + 1
    # what one task holds is cut into leaves by one task
    rest = done[0]
    for other in done[1:]:
        rest = rest.union(other)
    schema = (
        f"part {kind}, node long, level int, n long, weight long, ids binary, weights binary, vecs binary, centre array<double>, radius double"
    )
    leaves = materialize(rest.groupBy("part", "node").applyInArrow(_packed(leaf), schema), "leaves")
    return Tree(leaves, leaves.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], dim[0] if dim else 0, kind)


class Groups(NamedTuple):
    """Consecutive leaves of the tree, so many that a group's vectors are a task's load.

    ``of_leaf``: part, node, grp, n, centre, radius. ``pairs``: part, a, b, low, high: bounds of the
    distances between the points of two groups, both ways. ``most`` points make a group."""

    of_leaf: DataFrame
    pairs: DataFrame
    most: int


def group_leaves(tree: Tree) -> Groups:
    leaves, points = tree.leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    most = max(1, min(GROUP_BYTES // (8 * max(1, tree.dim)), max(LEAST_POINTS, -(-points // GROUPS))))
    per_group = max(1, most * leaves // max(1, points))
    # leaves side by side in the tree are side by side in this order
    place = F.expr(f"shiftleft(node, {FANOUT_BITS} * ({tree.depth} - level))")
    order = with_ids(tree.leaves.select(*KEYS, place.alias("place"), "n", "weight", "centre", "radius"), "nth", ["part", "place"])
    of_leaf = materialize(order.select(*KEYS, F.floor(F.col("nth") / per_group).alias("grp"), "n", "weight", "centre", "radius"), "groups")
    balls = of_leaf.select("part", F.col("grp").alias("parent"), "weight", "centre", "radius").groupBy("part", "parent").applyInArrow(
        _above, f"part {tree.part_type}, node long, weight long, centre array<double>, radius double"
    )
    balls = materialize(balls, "group-balls")
    a, b = (balls.select("part", F.col("node").alias(c), F.col("centre").alias(f"{c}_centre"), F.col("radius").alias(f"{c}_radius")) for c in "ab")
    met = a.join(b, "part").withColumn("gap", _apart("a_centre", "b_centre"))
    gap, both = F.col("gap"), F.col("a_radius") + F.col("b_radius")
    pairs = met.select("part", "a", "b", (gap - both - SLACK).alias("low"), (gap + both + SLACK).alias("high"))
    return Groups(of_leaf.drop("weight"), materialize(pairs, "group-pairs"), most)


def in_groups(groups: Groups, blocks: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on the blocks (part, node, ...) of each group, with the centres and radii of their leaves."""
    spark = blocks.sparkSession
    n = max(spark.sparkContext.defaultParallelism, groups.pairs.where("a = b").count())
    rows = blocks.join(groups.of_leaf, KEYS).repartition(min(n, MOST_PARTITIONS), "part", "grp")
    return rows.groupBy("part", "grp").applyInArrow(run, schema)


def search(
    groups: Groups, seekers: DataFrame, blocks: DataFrame, own: bool, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``run`` on seekers and the blocks of one group, for all groups that may matter to them.

    ``seekers`` (part, node, m, reach, ...) are ``m`` points of a leaf that look for something within
    ``reach``, ``blocks`` (part, node, ...) what they look through. Groups with few seekers
    look together, so that each group is sent as often as there are loads of seekers. A group looks
    through itself only with ``own``. ``run`` gets the columns of the blocks with ``b_`` in front.
    """
    of_leaf = groups.of_leaf
    left = materialize(seekers.join(of_leaf, KEYS), "seekers")
    wants = left.groupBy("part", F.col("grp").alias("a")).agg(F.max("reach").alias("reach"), F.sum("m").alias("m"))
    wants = materialize(wants, "wants")
    loads, total = wants.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    pack = max(1, groups.most * loads // max(1, total))
    met = groups.pairs.join(wants, ["part", "a"]).where("low <= reach")
    met = met if own else met.where("a != b")
    tiles = materialize(met.select("part", F.floor(F.col("a") / pack).alias("pack"), "b").distinct(), "tiles")
    n = min(MOST_PARTITIONS, max(blocks.sparkSession.sparkContext.defaultParallelism, tiles.count()))
    heads = left.withColumn("pack", F.floor(F.col("grp") / pack)).join(tiles, ["part", "pack"])
    others = blocks.join(of_leaf, KEYS).withColumnRenamed("grp", "b").join(tiles, ["part", "b"])
    others = others.select(*[F.col(c).alias(f"b_{c}") for c in others.columns])
    return (
        heads.repartition(n, "part", "pack", "b").groupBy("part", "pack", "b")
        .cogroup(others.repartition(n, "b_part", "b_pack", "b_b").groupBy("b_part", "b_pack", "b_b"))
        .applyInArrow(run, schema)
    )


class Points(NamedTuple):
    """Points of several leaves in a task: the leaf rows' node numbers, balls and first points, and the joined vectors."""

    node: np.ndarray
    grp: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    vecs: np.ndarray

    @property
    def leaf(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.node)), np.diff(self.starts))


def joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    """The packed arrays of a column, one after the other."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def points_of(table: pa.Table, dim: int, prefix: str = "", group: str = "grp") -> Points:
    ids = [len(x) // 8 for x in table.column(f"{prefix}ids").to_pylist()]
    return Points(
        table.column(f"{prefix}node").to_numpy(), table.column(f"{prefix}{group}").to_numpy(), matrix(table.column(f"{prefix}centre")),
        table.column(f"{prefix}radius").to_numpy(), np.concatenate([[0], np.cumsum(ids)]).astype(np.int64),
        joined(table, f"{prefix}ids", "<i8"), joined(table, f"{prefix}vecs", "<f8").reshape(-1, dim),
    )


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products: fast, and right but for a rounding that ``rounding`` bounds."""
    out = x @ y.T
    out *= -2
    out += np.einsum("ij,ij->i", x, x)[:, None]
    out += np.einsum("ij,ij->i", y, y)[None, :]
    return np.maximum(out, 0, out=out)


def rounding(x: np.ndarray, y: np.ndarray) -> float:
    largest = max((float(np.einsum("ij,ij->i", v, v).max()) for v in (x, y) if len(v)), default=0.0)
    return 1e-14 * (x.shape[1] + 4) * largest


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the same rows of y, by differences."""
    out = np.empty(len(x))
    for at in range(0, len(x), 50_000):
        gap = x[at : at + 50_000] - y[at : at + 50_000]
        out[at : at + 50_000] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def leaf_gaps(a: Points, b: Points) -> np.ndarray:
    """No point of a leaf of a is nearer to one of a leaf of b."""
    apart = np.sqrt(squares(a.centre, b.centre))
    off = np.sqrt(rounding(a.centre, b.centre))
    return apart - off - a.radius[:, None] - b.radius[None, :] - SLACK


def each_pair_once(p: Points, may: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) of the same points that cover the pairs of leaves in ``may``, which is symmetric, one way only.

    The first tiles have few columns, for callers that leave out what earlier tiles have settled.
    """
    if may.mean() <= 0.5:
        yield from to_compare(p, p, np.triu(may))
        return
    c, wide, every = 0, FIRST_COLUMNS, np.arange(len(p.ids))
    while c < len(every):
        some = every[c : c + wide]
        step = max(1, TILE_CELLS // len(some))
        for r in range(c, len(every), step):
            yield every[r : r + step], some
        c, wide = c + wide, min(TILE_COLUMNS, wide * MORE_COLUMNS)


def to_compare(a: Points, b: Points, may: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that cover the pairs of leaves in ``may``, a bounded number of distances each."""
    if not may.any():
        return
    many = may.mean() > 0.5
    every = np.arange(len(b.ids))
    todo = [(np.flatnonzero(may.any(axis=1)[a.leaf]), every)] if many else (
        (np.arange(a.starts[i], a.starts[i + 1]), every[may[i][b.leaf]]) for i in np.flatnonzero(may.any(axis=1))
    )
    for rows, cols in todo:
        for c in range(0, len(cols), TILE_COLUMNS):
            some = cols[c : c + TILE_COLUMNS]
            step = max(1, TILE_CELLS // len(some))
            for r in range(0, len(rows), step):
                yield rows[r : r + step], some


@F.arrow_udf(ArrayType(LongType()))
def unpacked_ids(ids: pa.Array) -> pa.Array:
    """The points of packed leaves."""
    return pa.array([np.frombuffer(x.as_py(), "<i8") for x in ids], pa.list_(pa.int64()))
