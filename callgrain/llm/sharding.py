"""K-d tree sharding by bytes, in DataFrame operations only.

A point is a group of equal texts with the metadata of its first document and the bytes of all, so
that copies share a shard; a group above WHOLE_SHARE of a shard's target is one point per
document instead, else it would break the balance. A node that must give k shards is cut at the
weighted quantile of its widest dimension (in units of the whole table's range) into k // 2 and the
rest, until every leaf is one shard of the target size.

The quantile is exact and needs no sort: the position of a point along a dimension is a 62-bit
number, the dimension's scaled value above a hash of the text that breaks ties. A histogram over its
next 16 bits, summed before the shuffle, names the bin that holds the quantile; four such passes
settle the cut. The driver sees one row per node and pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm.common import stored
from callgrain.plans.ids import with_ids

WHOLE_SHARE = 0.02
SCALE_BITS, TIE_BITS = 30, 32
_BITS = SCALE_BITS + TIE_BITS
_STEP = 16


def _hash_unit(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - TIE_BITS)


def _positions(points: DataFrame, dims: list[str]) -> DataFrame:
    """Adds p_<dim>: the scaled value in the high bits, the tie-breaking hash in the low ones."""
    ends = points.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    out = {}
    for d in dims:
        lo, hi = ends[f"lo_{d}"] or 0, ends[f"hi_{d}"] or 0
        width = float(hi) - float(lo)
        unit = (F.coalesce(F.col(d), F.lit(lo)).cast("double") - lo) / width if width else F.lit(0.0)
        scaled = F.least(F.floor(unit * ((1 << SCALE_BITS) - 1)), F.lit((1 << SCALE_BITS) - 1)).cast("long")
        out[f"p_{d}"] = F.shiftleft(scaled, TIE_BITS).bitwiseOR(F.col("tie"))
    return points.withColumns(out)


def _cuts(points: DataFrame, where: dict[int, float]) -> dict[int, int]:
    """For each node its cut position: the last one of the left part, by the wanted share of bytes."""
    low = {n: 0 for n in where}  # start of the bin that holds the quantile
    left = {n: None for n in where}  # bytes wanted on the left, counted from there
    for shift in (46, 30, 14, 0):
        width = min(_STEP, _BITS - shift) if shift else 14
        inside = F.lit(False)
        for n, start in low.items():
            inside |= (F.col("node") == n) & (F.shiftright("at", shift + width) == (start >> (shift + width)))
        bins = points.where(inside).groupBy("node", F.shiftright("at", shift).alias("bin")).agg(F.sum("bytes").alias("bytes"))
        in_order = Window.partitionBy("node").orderBy("bin")  # at most 2 ** 16 bins of a node
        running = bins.select(
            "node", "bin", "bytes", F.sum("bytes").over(in_order).alias("upto"),
            F.sum("bytes").over(Window.partitionBy("node")).alias("all"),
        )
        wanted = F.lit(None).cast("double")
        for n, share in where.items():
            goal = F.col("all") * F.lit(share) if left[n] is None else F.lit(float(left[n]))
            wanted = F.when(F.col("node") == n, goal).otherwise(wanted)
        reached = running.withColumn("goal", wanted).where(F.col("upto") >= F.col("goal"))
        for r in reached.groupBy("node").agg(F.min_by(F.struct("bin", "bytes", "upto", "goal"), "bin").alias("r")).collect():
            n, b = r["node"], r["r"]
            low[n], left[n] = b["bin"] << shift, b["goal"] - (b["upto"] - b["bytes"])
            if shift == 0 and left[n] < b["bytes"] / 2:  # the point at the quantile goes to the nearer side
                low[n] -= 1
    return low


def shard_points(points: DataFrame, shards: int, dims: list[str]) -> DataFrame:
    """``points`` (bytes, tie and numeric ``dims``) with their shard."""
    placed = stored(_positions(points, dims).withColumn("node", F.lit(0)), "kd-points")
    leaves = {0: (0, shards)}  # node: first shard, number of shards
    number = 1
    node = F.col("node")
    while any(k > 1 for _, k in leaves.values()):
        splitting = {n: k for n, (_, k) in leaves.items() if k > 1}
        found = placed.where(F.col("node").isin(list(splitting))).groupBy("node").agg(
            *[(F.max(f"p_{d}") - F.min(f"p_{d}")).alias(d) for d in dims]
        ).collect()  # one row per node: fewer than the shards
        widest = {r["node"]: max(dims, key=lambda d, r=r: r[d]) for r in found}
        at = F.lit(None).cast("long")
        for n, d in widest.items():
            at = F.when(F.col("node") == n, F.col(f"p_{d}")).otherwise(at)
        here = placed.withColumn("at", at)
        cuts = _cuts(here.where(F.col("at").isNotNull()), {n: (splitting[n] // 2) / splitting[n] for n in widest})
        node = F.col("node")
        for n, k in splitting.items():
            first, _ = leaves.pop(n)
            right = number
            leaves[n], leaves[right] = (first, k // 2), (first + k // 2, k - k // 2)
            number += 1
            if n in cuts:
                node = F.when((F.col("node") == n) & (F.col("at") > cuts[n]), right).otherwise(node)
        placed = here.withColumn("node", node).drop("at")
    shard = F.lit(0)
    for n, (first, _) in leaves.items():
        shard = F.when(F.col("node") == n, first).otherwise(shard)
    return placed.withColumn("shard", shard.cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The law is ``bytes``: shard sizes are near equal, and copies of a text share a shard unless all
    of them together are more than WHOLE_SHARE of a shard's bytes; those are placed each by itself. Dimensions are the id, the characters, and the language and source
    by hash; a missing metadata column or null value counts as the lowest. The size of a null text is
    1. Slots are gapless from 0 in each shard, in the order of doc_id (nulls first) with repeated
    rows side by side.
    """
    have = set(docs.columns)
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = lambda c: _hash_unit(F.col(c)) if c in have else F.lit(0)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"),
        F.length(text).cast("long").alias("chars"), meta("lang").alias("lang"), meta("source").alias("source"),
    )
    rows = stored(rows, "shard-rows")
    first = F.min_by(F.struct("doc_id", "chars", "lang", "source"), F.struct("doc_id", "source", "lang"))
    groups = rows.groupBy("h", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), first.alias("m"))
    all_rows = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    # at most shards / WHOLE_SHARE groups hold more than that share of a shard's bytes
    large = (F.col("n") > 1) & (F.col("bytes") > (all_rows["bytes"] or 0) * WHOLE_SHARE / shards)
    groups = stored(groups.withColumn("large", large), "shard-groups")
    large = F.broadcast(groups.where("large").select("h", "h2"))
    dims = ["doc_id", "chars", "lang", "source"]
    alone = rows.join(large, ["h", "h2"]).select(
        "h", "h2", F.col("doc_id").alias("own_id"), "text_crc32", F.col("size").alias("bytes"),
        _hash_unit(F.col("doc_id")).alias("tie"), *dims,
    )
    grouped = groups.where(~F.col("large")).select(
        "h", "h2", F.lit(None).cast("long").alias("own_id"), F.lit(None).cast("long").alias("text_crc32"), "bytes",
        F.shiftrightunsigned("h", 64 - TIE_BITS).alias("tie"), "m.*",
    )
    points = shard_points(
        grouped.withColumn("grouped", F.lit(True)).unionByName(alone.withColumn("grouped", F.lit(False))), shards, dims
    )
    members = rows.join(large, ["h", "h2"], "left_anti").join(points.where("grouped").select("h", "h2", "shard"), ["h", "h2"])
    placed = members.select("shard", "doc_id", "size", "text_crc32").union(
        points.where(~F.col("grouped")).select("shard", F.col("own_id").alias("doc_id"), F.col("bytes").alias("size"), "text_crc32")
    )
    numbered = with_ids(placed, "row", ["shard", "doc_id", "size", "text_crc32"])
    starts = F.broadcast(numbered.groupBy("shard").agg(F.min("row").alias("start")))  # one row per shard
    return numbered.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
