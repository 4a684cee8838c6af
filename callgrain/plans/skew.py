"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.session import materialize

# Rows that one task joins with ease even if they all have the same key.
ONE_TASK_ROWS = 200_000


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    share: float = 0.001,
    rows: int | None = None,
    part_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Join ``left``, which may have hot keys, to ``right``, which has at most one row per key.

    A key is hot when it holds more than ``share`` of the left rows, so there are at most
    ``1 / share`` of them whatever the size of the data; that list of 8-byte hashes is all that is
    broadcast. The rows of a hot key are dealt out by ``spread_by`` over as many parts as it has
    ``part_rows``, and the matching right row is repeated once per part; all other keys take part
    unchanged. Where the caller knows the number of left rows and one task could take them all,
    the join is a plain one.

    ``left`` is read twice, for the counts of its keys and for the join: hand in a stored table, not
    a long pipeline.
    """
    if rows is not None and rows <= ONE_TASK_ROWS:
        return left.join(right, on, how)
    key_hash = F.xxhash64(*on)
    counts = left.groupBy(key_hash.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if rows is None:
        counts = materialize(counts, "key-counts")
        rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if rows <= ONE_TASK_ROWS:
            return left.join(right, on, how)
    parts_of = F.ceil(F.col("_n") / part_rows).cast("int")
    hot = F.broadcast(
        counts.where(F.col("_n") > max(1000.0, rows * share)).select("_key", parts_of.alias("_parts"))
    )
    dealt = F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int")
    lhs = (
        left.withColumn("_key", key_hash)
        .join(hot, "_key", "left")
        .withColumn("_salt", F.coalesce(dealt, F.lit(0)))
        .drop("_key", "_parts")
    )
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    rhs = (
        right.withColumn("_key", key_hash)
        .join(hot, "_key", "left")
        .withColumn("_salt", F.explode(parts))
        .drop("_key", "_parts")
    )
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")
