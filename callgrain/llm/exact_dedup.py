"""Exact duplicates through an extendible-hash index whose buckets are owned by tasks.

1. Every normalised text gets a 64-bit hash. The index table (hash, rows, bytes) is written to the
   shared folder; equal texts collapse in the map-side aggregate.
2. A directory over the leading hash bits starts with one bucket and splits overfull buckets,
   doubling itself when a bucket's own depth reaches the directory's. It is built from at most
   2 ** MAX_DEPTH bucket totals, so its size has a fixed bound; beyond it buckets grow.
3. Owner tasks read their buckets sorted by hash and id. Texts of one hash form a chain; a text is
   compared with the chain byte by byte, so a hash collision never joins two texts. A task streams:
   it holds the chain of one hash and the ids of its rows.
4. A hash with more than 1 / HOT_SHARE of the rows is dealt out over several owners, whose chain
   heads are compared once more. There are at most HOT_SHARE such hashes: the bound of the broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import SPACE, stored

MAX_DEPTH = 16
BUCKET_BYTES = 8 << 20
HOT_SHARE = 50_000
LEAST_HOT = 500


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def directory(totals: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket of each directory slot, from the bytes at every prefix of the deepest directory."""
    deepest = len(totals).bit_length() - 1
    depth, buckets = 0, {(0, 0): None}  # (own depth, prefix)
    full = [(0, 0)]
    while full:
        own, prefix = full.pop()
        width = 1 << (deepest - own)
        if totals[prefix * width : (prefix + 1) * width].sum() <= capacity or own == deepest:
            continue
        depth = max(depth, own + 1)  # the directory doubles
        del buckets[own, prefix]
        for half in ((own + 1, 2 * prefix), (own + 1, 2 * prefix + 1)):
            buckets[half] = None
            full.append(half)
    slots = np.zeros(1 << depth, np.int32)
    for number, (own, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (deepest - b[0]))):
        width = 1 << (depth - own)
        slots[prefix * width : (prefix + 1) * width] = number
    return slots


_OWNED = "id long, h long, salt int, text_sha256 string, head long, n long, head_text string"
_OWNED_ARROW = pa.schema(
    [("id", pa.int64()), ("h", pa.int64()), ("salt", pa.int32()), ("text_sha256", pa.string()),
     ("head", pa.int64()), ("n", pa.int64()), ("head_text", pa.string())]
)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, salt, id), nulls last: each with the head of its class and the class size."""
    out: list[list] = [[] for _ in _OWNED_ARROW]
    run, chain, members = None, {}, []

    def finish() -> None:
        if run is None:
            return
        # a dict compares full texts behind its own hash
        facts = list(chain.items())
        for name, c in members:
            text, found = facts[c]
            head, n, digest, first, _ = found
            found[3] = False  # only a dealt-out head carries its text on
            row = (name, *run, digest, head, n, text if first and run[1] >= 0 else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OWNED_ARROW, strict=True)], schema=_OWNED_ARROW)

    for b in batches:
        for h, salt, name, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (h, salt) != run:
                finish()
                run, chain, members = (h, salt), {}, []
            found = chain.get(text)
            if found is None:
                found = chain[text] = [name, 0, hashlib.sha256(text.encode("utf-8")).hexdigest(), True, len(chain)]
            found[1] += 1
            members.append((name, found[4]))
        if len(out[0]) >= 10_000:
            yield batch()
            out = [[] for _ in _OWNED_ARROW]
    finish()
    if out[0]:
        yield batch()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Texts are equal when identical after normalisation; null counts as empty; the smallest doc_id
    stays. Rows that repeat an id are counted each and kept alike. A null id comes after all others;
    a group of null ids alone keeps its rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text")).select(
        F.xxhash64("text").alias("h"), "id", "text"
    )
    index = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 64).alias("size")), "index")
    prefix = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    totals = np.zeros(1 << MAX_DEPTH, np.int64)
    for r in index.groupBy(prefix.alias("p")).agg(F.sum("size").alias("size")).collect():  # at most 2 ** MAX_DEPTH
        totals[r["p"]] = r["size"]
    slots = directory(totals, BUCKET_BYTES)
    depth, buckets = len(slots).bit_length() - 1, int(slots.max()) + 1
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(slots)], "slot int, bucket int")
    slot = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)

    total = index.agg(F.sum("n")).first()[0] or 0
    limit = max(LEAST_HOT, total // HOT_SHARE)
    hot = index.where(F.col("n") > limit).select("h", F.ceil(F.col("n") / limit).cast("int").alias("owners"))
    owned = (
        rows.join(F.broadcast(hot), "h", "left")
        .withColumn("salt", F.when(F.col("owners").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), "owners").cast("int")))
        .withColumn("slot", slot)
        .join(F.broadcast(table), "slot")
        .repartition(max(buckets, spark.sparkContext.defaultParallelism), "bucket", "salt")
        .sortWithinPartitions("h", "salt", F.asc_nulls_last("id"))
        .select("h", "salt", "id", "text")
    )
    owned = stored(owned.mapInArrow(_own, _OWNED), "owned")

    heads = owned.where("head_text is not null").select("h", "salt", "head", "n", "head_text")
    merged = heads.groupBy("h", "head_text").agg(
        F.min("head").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list(F.struct("salt", "head")).alias("at")
    ).select("h", "keep_id", "group_size", F.explode("at").alias("at")).select("h", "at.salt", "at.head", "keep_id", "group_size")
    alone = owned.where("salt < 0").select("id", F.col("head").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    dealt = owned.where("salt >= 0")
    same = (dealt["h"] == merged["h"]) & (dealt["salt"] == merged["salt"]) & dealt["head"].eqNullSafe(merged["head"])
    shared = dealt.join(merged, same).select(dealt["id"], "keep_id", "group_size", "text_sha256")
    return alone.union(shared).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
