"""N-gram Jaccard self-join: count vectors in R-trees, exact, as components of linked documents.

A document's set holds 64-bit hashes of its distinct shingles of ``words`` words. Two sets link when
``100 * common >= percent * united``, which for sizes a and b is
``(100 + percent) * common >= percent * (a + b)``. op1 has 4 words and 85 percent, the pipeline 5 and 80.

1. One pass over the texts gives per document the set's size and digest, its count vector (members
   per hash group: a point), and the keys by which it can meet a partner: linked sets share one of
   the first ``n - ceil(percent / 100 * n) + 1`` members in any order common to all. The order here is by hash,
   with members that a sample shows to be frequent put last; the sample can only cost time. Equal
   sets collapse to the one with the smallest id.
2. Keys are range-partitioned with the ids behind them and streamed: every document is paired with
   the first one of its run, runs cut by a partition border are stitched, lone keys vanish. No key
   gathers in one task.
3. Pairs survive if the summed coordinate minima of their points, which bound the common members,
   suffice; survivors are verified on their sets. Links make components. Coordinates stop at 255, and
   what lies above is bounded by its sum, so a point is GROUPS bytes whatever the size of the set.
4. Keys that still hold several components, one of those with the same members, are joined again in R-trees over their points, boxes
   against boxes and then points against points, only across components. A key with more than
   ``TILE_ROWS`` members is dealt out in tiles, and a tile gives its survivors out piece by piece.
   Survivors are verified, and all links make the final components. So every linked pair is either verified or already inside one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from callgrain.llm.common import SPACE_CHARS, grouped, keyed_text, parts_for, stored, text_slices
from callgrain.plans.components import connected_components
from callgrain.plans.skew import skew_join

WORDS = 4  # of a shingle, unless the caller says otherwise
PERCENT = 85  # similarity from which sets link, likewise
GROUPS = 256
LEAF, FAN = 16, 16
TILE_ROWS = 4096
SAMPLE_SHARE = 64  # one document in so many tells which members are frequent
SAMPLE_LEAST = 3
FREQUENT = 1 << 16  # frequent members kept: 512 KB sent to the tasks
KEYS_PER_PART = 1_000_000
BATCH_BYTES = 1 << 20
PAIRS_OUT = 1 << 18  # survivors of a tile held before they are given out

_SPACES = np.zeros(256, bool)
_SPACES[[ord(c) for c in SPACE_CHARS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum([len(r) for r in raw])
        space = _SPACES[data]
        inside = np.flatnonzero(~space)
        if not len(inside):
            return [np.zeros(0, np.uint64) for _ in texts]
        first = np.append(True, np.diff(inside) > 1)
        begins = np.flatnonzero(first)  # of words, among the inside bytes
        starts, lengths = inside[begins], np.diff(np.append(begins, len(inside)))
        # polynomial hash of each word: bytes times powers of an odd number
        powers = np.ones(int(lengths.max()), np.uint64)
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _PRIME))
        place = np.arange(len(inside)) - np.repeat(begins, lengths)
        word = np.add.reduceat(_mix(data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], begins)
        word = _mix(word ^ (lengths.astype(np.uint64) << np.uint64(32)))
        owner = np.searchsorted(ends, starts, side="right")
        counts = np.bincount(owner, minlength=len(texts))
        out, at = [], 0
        for n in counts.tolist():
            w = word[at : at + n]
            at += n
            take = min(n, words)
            h = np.zeros(max(0, n - take + 1) if n else 0, np.uint64)
            for i in range(take):
                h = _mix(h * _PRIME + w[i : i + len(h)] + np.uint64(i))
            out.append(np.unique(_mix(h ^ np.uint64(take))))
        return out


def _batched(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for texts in text_slices(column):
        for group in grouped(texts, BATCH_BYTES):
            yield from shingle_sets(group, words)


def count_vector(members: np.ndarray) -> np.ndarray:
    """Members per group, at most 255 of each."""
    counts = np.bincount((members >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8)


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _common(p: np.ndarray, q: np.ndarray, over_p: np.ndarray, over_q: np.ndarray) -> np.ndarray:
    """The most members that sets of these points can share; ``over`` is what lies above the points."""
    return np.minimum(p, q).sum(axis=-1, dtype=np.int64) + np.minimum(over_p, over_q)


def _over(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return sizes - points.sum(axis=1, dtype=np.int64)


def keys(members: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The members by which a linked partner must be met."""
    n = len(members)
    need = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        often = frequent[at] == members
        if often.any():
            members = np.concatenate([members[~often], members[often]])
    return members[:need]


def _profiles(frequent: np.ndarray, words: int, percent: int):
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
         ("point", pa.binary()), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for m in _batched(batch.column(1), words):
                    digest = (int(m.sum()), int(_mix(m + np.uint64(7)).sum())) if len(m) else (0, 0)
                    rows.append((len(m), *np.array(digest, np.uint64).view(np.int64).tolist(), count_vector(m).tobytes(), keys(m, frequent, percent).view(np.int64)))
            cols = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))] if rows else None
            if cols:
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _members(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([m.tobytes() for m in _batched(batch.column(1), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "members"])

    return run


def _frequent_members(rows: DataFrame, words: int) -> np.ndarray:
    """The most frequent members of a sample of the documents, at most FREQUENT of them."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in _batched(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64))], names=["member"])

    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0)
    counted = sample.mapInArrow(explode, "member long").groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where(F.col("n") >= SAMPLE_LEAST).orderBy(F.desc("n"), "member").limit(FREQUENT).collect()
    return np.sort(np.array([r["member"] for r in top], np.int64).view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) to (key, id, head, edge): runs of several ids, and the partition's
    first and last run whatever their length (edge), since they may go on next door."""
    names = ["key", "id", "head", "edge"]

    def rows(key: np.ndarray, name: np.ndarray, edge: np.ndarray) -> pa.RecordBatch | None:
        new = np.append(True, (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        keep = (np.repeat(size, size) > 1) | edge
        head = np.repeat(name[begin], size)
        if not keep.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, name, head, edge)], names=names)

    def distinct(key: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.zeros(0, bool)
        return key[new], name[new]

    held, first = None, None  # rows of the last key so far, not yet known to be complete
    for batch in batches:
        key, name = (batch.column(i).to_numpy() for i in (0, 1))
        if held is not None:
            key, name = np.concatenate([held[0], key]), np.concatenate([held[1], name])
        key, name = distinct(key, name)
        if not len(key):
            continue
        if first is None:
            first = key[0]
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            out = rows(key[:cut], name[:cut], key[:cut] == first)
            if out is not None:
                yield out
        held = key[cut:], name[cut:]
    if held is not None:
        out = rows(*held, np.ones(len(held[0]), bool))
        if out is not None:
            yield out


def _enough(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return (100 + percent) * common >= percent * (a + b)


class RTree:
    """Points packed bottom-up in the order of size and first coordinates; boxes keep their upper
    corner, which bounds summed minima, and their least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> None:
        self.percent = percent
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.over = _over(self.points, self.sizes)
        self.levels = []  # from the leaves up: upper corners, least sizes, largest rest
        high, least, over, width = self.points, self.sizes, self.over, LEAF
        while True:
            begin = np.arange(0, len(high), width)
            high, least, over = np.maximum.reduceat(high, begin), np.minimum.reduceat(least, begin), np.maximum.reduceat(over, begin)
            self.levels.append((high, least, over))
            if len(high) == 1:
                return
            width = FAN

    def join(self, other: RTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (self, other) of points whose summed minima suffice, leaf pair by leaf pair;
        of a tree with itself each pair once, and none of a point with itself."""
        alone = self is other
        top = max(len(self.levels), len(other.levels))
        level = lambda t, i: t.levels[min(i, len(t.levels) - 1)]
        u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for i in range(top - 1, -1, -1):
            (hu, nu, ou), (hv, nv, ov) = level(self, i), level(other, i)
            keep = []
            for s in range(0, len(u), 4096):
                a, b = u[s : s + 4096], v[s : s + 4096]
                keep.append(_enough(_common(hu[a], hv[b], ou[a], ov[b]), nu[a], nv[b], self.percent))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            u, v = u[keep], v[keep]
            if i:
                u, v = self._children(u, v, self, other, i)
                if alone:
                    u, v = u[u <= v], v[u <= v]
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            x, y = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
            common = _common(self.points[x, None, :], other.points[None, y, :], self.over[x, None], other.over[None, y])
            fits = _enough(common, self.sizes[x, None], other.sizes[None, y], self.percent)
            if alone and a == b:
                fits &= np.tri(*fits.shape, -1, dtype=bool).T
            i, j = np.nonzero(fits)
            if len(i):
                yield self.order[a * LEAF + i], other.order[b * LEAF + j]

    @staticmethod
    def _children(u: np.ndarray, v: np.ndarray, left: RTree, right: RTree, level: int) -> tuple[np.ndarray, np.ndarray]:
        def down(nodes: np.ndarray, tree: RTree) -> np.ndarray:
            lower = level > len(tree.levels) - 1  # its root waits
            return nodes[:, None] if lower else nodes[:, None] * FAN + np.arange(FAN)[None, :]

        a, b = down(u, left), down(v, right)
        pairs = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
        size = lambda t: len(t.levels[min(level - 1, len(t.levels) - 1)][0])
        real = (pairs[0] < size(left)) & (pairs[1] < size(right))
        return pairs[0][real], pairs[1][real]


_PAIRS = "a long, b long"


def _tree_pairs(
    sizes: np.ndarray, points: np.ndarray, roots: np.ndarray, chunks: np.ndarray, percent: int
) -> Iterator[np.ndarray]:
    """Surviving index pairs of one tile of more than a leaf, across components, some at a time."""
    sides = [np.flatnonzero(chunks == c) for c in np.unique(chunks)]
    trees = [RTree(points[s], sizes[s], percent) for s in sides]
    found, held = [], 0
    for x, y in trees[0].join(trees[-1]):
        x, y = sides[0][x], sides[-1][y]
        apart = roots[x] != roots[y]
        if apart.any():
            found.append(np.stack([x[apart], y[apart]]))
            held += int(apart.sum())
        if held >= PAIRS_OUT:
            yield np.concatenate(found, axis=1)
            found, held = [], 0
    if found:
        yield np.concatenate(found, axis=1)


def _survivors(percent: int):
    """Tiles, sorted by (key, x, y), to pairs (a, b). A tile of one leaf needs no tree: those of a
    batch are compared together, a pair that meets under several keys once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(ids: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
            names = np.unique(np.sort(ids[pairs], axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1])], names=["a", "b"])

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, x, y, ids, roots, chunks, sizes = (t.column(i).to_numpy() for i in range(7))
            points = _points(t.column(7))
            over = _over(points, sizes)
            new = np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            begin = np.append(np.flatnonzero(new), len(key))
            tile = np.cumsum(new)
            small = np.diff(begin)[tile - 1] <= LEAF
            found = [np.zeros((2, 0), np.int64)]
            for d in range(1, min(LEAF, len(key))):
                at = np.flatnonzero((tile[:-d] == tile[d:]) & (roots[:-d] != roots[d:]) & small[:-d])
                found.append(np.stack([at, at + d]))
            pairs = np.concatenate(found, axis=1)
            names = np.sort(ids[pairs], axis=0)
            pairs = pairs[:, np.unique(names, axis=1, return_index=True)[1]]
            keep = [
                _enough(_common(points[u], points[v], over[u], over[v]), sizes[u], sizes[v], percent)
                for u, v in (pairs[:, s : s + 8192] for s in range(0, pairs.shape[1], 8192))
            ]
            yield named(ids, pairs[:, np.concatenate(keep)] if keep else pairs)
            for i in np.flatnonzero(np.diff(begin) > LEAF).tolist():
                s = slice(begin[i], begin[i + 1])
                for f in _tree_pairs(sizes[s], points[s], roots[s], chunks[s], percent):
                    yield named(ids, begin[i] + f)

        held: list[pa.RecordBatch] = []  # the last tile so far may go on in the next batch
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            last = [t.column(i).to_numpy() for i in range(3)]
            cut = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in last]))) if len(t) else 0
            if cut:
                yield from compare(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and len(t):
            yield from compare(t)

    return run


def _may_link(percent: int):
    @F.arrow_udf(BooleanType())
    def may(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for s in range(0, len(a), 4096):
            p, q = _points(a.slice(s, 4096)), _points(b.slice(s, 4096))
            n, m = n_a.slice(s, 4096).to_numpy(), n_b.slice(s, 4096).to_numpy()
            out.append(_enough(_common(p, q, _over(p, n), _over(q, m)), n, m, percent))
        return pa.array(np.concatenate(out))

    return may


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs whose summed coordinate minima suffice."""
    side = lambda c: points.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent)("p_a", "p_b", "n_a", "n_b")).select("a", "b")


def _linked(percent: int):
    @F.pandas_udf(BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([p, q]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(bool(_enough(common, len(p), len(q), percent)))
        return pd.Series(out, dtype=bool)

    return linked


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, by the intersection of their sets."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(
        texts.join(named, "id", "left_semi").mapInArrow(_members(words), "id long, members binary").dropDuplicates(["id"]), "sets"
    )
    side = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"m_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_linked(percent)("m_a", "m_b")).select("a", "b")


def _labelled(profiles: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    return profiles.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), roots


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are runs of other than the six white-space bytes, A-Z in lower case; with fewer than ``words``
    words the whole sequence is the one shingle. A text without words (or null) has an empty set,
    links with nothing and is its own component. Rows that repeat an id are one document; rows
    without an id link with nothing and have a null component.
    """
    spark = docs.sparkSession
    texts = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("id"), "text")
    some = texts.where("id is not null")
    frequent = _frequent_members(some, words)
    profiles = stored(
        texts.mapInArrow(_profiles(frequent, words, percent), "id long, n long, s1 long, s2 long, point binary, keys array<long>"), "profiles"
    )
    used = profiles.where("id is not null and n > 0")
    classes = used.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    # equal sets hang under their smallest id; a hot class is a few partial minima, and its rows many tasks
    named = skew_join(used.select("id", "s1", "s2", "n"), classes, ["s1", "s2", "n"], ["id"], "inner", rows=used.count())
    copies = stored(named.where("id != rep").select("id", "rep").distinct(), "copies")
    reps = used.join(copies, "id", "left_anti")
    by_key = reps.select(F.explode("keys").alias("key"), "id")
    total = reps.agg(F.sum(F.size("keys"))).first()[0] or 0
    blocks = stored(
        by_key.repartitionByRange(parts_for(total, KEYS_PER_PART, spark), "key", "id")
        .sortWithinPartitions("key", "id")
        .mapInArrow(_runs, "key long, id long, head long, edge boolean"),
        "blocks",
    )
    # a run cut by partition borders has a head in each: they meet under the smallest
    borders = blocks.where("edge").groupBy("key").agg(F.min("head").alias("least"), F.collect_set("head").alias("heads"))
    stitched = borders.select("least", F.explode("heads").alias("head"))
    stars = blocks.select(F.col("head").alias("a"), F.col("id").alias("b")).union(stitched).where("a != b").distinct()
    points = reps.select("id", "n", "point").dropDuplicates(["id"])
    first = stored(_verified(stored(_bounded(stars, points, percent), "star-pairs"), some, words, percent), "links")
    labelled, _ = _labelled(points.select("id"), first)

    labelled = stored(labelled, "labelled")
    members = blocks.select("key", "id").join(labelled.select("id", "root"), "id")
    # keys with the same members make the same pairs: one of them is enough
    same = [F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2")]
    open_keys = members.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"), *same
    ).where("low < high").groupBy("m", "low", "high", "h1", "h2").agg(F.min("key").alias("key"))
    open_keys = open_keys.select("key", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("chunks"))
    spread = members.join(open_keys, "key").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    tiles = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "id", "root", "chunk"
    )
    held = tiles.join(points, "id").select("key", "x", "y", "id", "root", "chunk", "n", "point")
    survivors = (
        held.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
        .mapInArrow(_survivors(percent), _PAIRS).where("a != b").distinct()
    )
    second = _verified(stored(survivors, "tree-pairs"), some, words, percent)
    links = first.union(second).union(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    _, roots = _labelled(points.select("id"), stored(links, "links"))
    return profiles.select("id", F.col("n").alias("n_shingles")).join(roots, "id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("root", "id").alias("component_id")
    )
