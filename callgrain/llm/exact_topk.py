"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merge.

Queries and vectors are dealt into groups of bounded size; a tile is one query group against one
vector group. A tile is a few matrix products in numpy; of each query's scores only the k best leave
it. Per-query lists are then merged in a tree, ``FAN`` vector groups at a time, so that no task ever
holds more than ``FAN * k`` rows of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_ROWS = 1 << 16  # rows of a group at most; 64 dimensions are 32 MB
LEAST_ROWS = 1 << 10
TILE = (256, 8192)  # queries and vectors multiplied at once
FAN = 16
_LONG = (1 << 63) - 1


def _matrix(table: pa.Table, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (each once, sorted) and scaled integer components as doubles."""
    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vecs = np.floor(flat.astype(np.float64).reshape(-1, dim) * scale)
    ids, first = np.unique(ids, return_index=True)
    return ids, vecs[first]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while every partial sum fits their 53 bits, else big integers."""
    if q.size == 0 or v.size == 0 or np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(q) @ whole(v).T, -_LONG, _LONG).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: partial selection by score, ties to smaller ids."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _tile(k: int, scale: int):
    schema = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        part, dim = key[0].as_py(), key[2].as_py()
        if queries.num_rows == 0 or vectors.num_rows == 0:
            return schema.empty_table()
        qid, q = _matrix(queries, dim, scale)
        vid, v = _matrix(vectors, dim, scale)
        out: list[tuple] = []
        for a in range(0, len(qid), TILE[0]):
            some = qid[a : a + TILE[0]]
            best: list[list] = [[] for _ in some]
            for b in range(0, len(vid), TILE[1]):
                ids = vid[b : b + TILE[1]]
                scores = _products(q[a : a + TILE[0]], v[b : b + TILE[1]])
                for i, own in enumerate(some):
                    row, seen = scores[i], ids
                    at = np.searchsorted(ids, own)
                    if at < len(ids) and ids[at] == own:
                        row, seen = np.delete(row, at), np.delete(ids, at)
                    best[i].append(_best(seen, row, k))
            for i, own in enumerate(some):
                ids, scores = _best(*(np.concatenate(x) for x in zip(*best[i], strict=True)), k)
                out.append((np.full(len(ids), own), ids, scores))
        query, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([query, np.full(len(ids), part, np.int32), ids, scores], schema=schema)

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by integer inner product of floor(scale * x).

    A query's own id is no candidate; ties go to the smaller id; with fewer candidates all are
    returned. Vectors that are null, empty or hold null or non-finite components, and rows without
    an id, take no part; vectors of different length are never compared; rows that repeat an id
    count once. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", finite)
    ).withColumn("dim", F.size("vec"))
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    per_group = min(GROUP_ROWS, max(LEAST_ROWS, -(-sizes["n"] // (3 * spark.sparkContext.defaultParallelism))))
    v_groups, q_groups = (max(1, -(-n // rows)) for n, rows in ((sizes["n"], per_group), (sizes["q"], GROUP_ROWS)))
    group = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable.where("asks").select("id", "vec", "dim", group(q_groups).alias("ask"), every(v_groups).alias("part"))
    # aliases: a cogroup mixes up the columns of sides that share attributes
    given = usable.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("dim").alias("dim"), group(v_groups).alias("part"), every(q_groups).alias("ask"))
    tile = ("part", "ask", "dim")
    lists = asked.groupBy(*tile).cogroup(given.groupBy(*tile)).applyInArrow(
        _tile(k, scale), "query_id long, part int, vec_id long, score long"
    )
    groups = v_groups
    while True:
        groups = -(-groups // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if groups == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
