"""Consecutive ids without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def with_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Number the rows 0..n-1 in the given order, which must be total.

    The rows are range-sorted and written once, so that the place of a row cannot change between
    counting the partitions and adding up their sizes.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright("_place", _ROW_BITS))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: a bounded table, both for the window and for the broadcast
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + row).alias(id_col), *df.columns
    )


# A sorted head of this size is merged by one task without trouble.
SHALLOW = 100_000


def rows_between(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of ``df`` in a total order.

    A shallow slice is a top-k. For a deep one a top-k would bring everything above the slice to
    one task; there the rows are numbered in parallel and filtered by number.
    """
    if offset + limit <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(limit)
    numbered = with_ids(df, "_row", order)
    return numbered.where(F.col("_row").between(offset, offset + limit - 1)).orderBy("_row").drop("_row")
