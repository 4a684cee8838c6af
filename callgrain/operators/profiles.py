"""Place profiles: what callers of a place ask about most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import trim_ws

# Crop names that say nothing about the crop.
UNSPECIFIC = ("OTHERS", "OTHER")


def _place(c: str) -> Column:
    return F.upper(trim_ws(F.col(c))).alias(c)


def value_counts(df: DataFrame, targets: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Calls per (place, column, value) for the target places; blank values are not counted.

    Rows are first counted on the stored spellings, so that cleaning, the join to the targets and
    everything after it work on one row per distinct combination and a place with a third of all
    calls arrives as a few partial counts.
    """
    stored = df.groupBy(*keys, *value_cols).agg(F.count(F.lit(1)).alias("n"))
    cleaned = stored.select(
        *[_place(k) for k in keys],
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("kind"), trim_ws(F.col(v)).alias("value")) for v in value_cols])
        ).alias("kv"),
        "n",
    ).select(*keys, "kv.kind", "kv.value", "n")
    wanted = targets.select(*[_place(k) for k in keys]).distinct()
    return (
        cleaned.where(F.col("value") != "")
        .join(wanted, keys, "left_semi")
        .groupBy(*keys, "kind", "value")
        .agg(F.sum("n").alias("n"))
    )


def leading_values(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent values per place and column; equal counts in value order."""
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_with_fallback(leaders: DataFrame, keys: list[str], others: tuple[str, ...] = UNSPECIFIC) -> DataFrame:
    """The top value, or the second one where the top is unspecific and a second exists."""
    first = F.max(F.when(F.col("rank") == 1, F.col("value")))
    second = F.max(F.when(F.col("rank") == 2, F.col("value")))
    top = F.when(F.upper(first).isin(list(others)) & second.isNotNull(), second).otherwise(first)
    return leaders.where(F.col("rank") <= 2).groupBy(*keys, "kind").agg(top.alias("top"))


def place_profile(
    df: DataFrame,
    targets: DataFrame,
    keys: list[str],
    crop_col: str = "Crop",
    type_col: str = "QueryType",
    others: tuple[str, ...] = UNSPECIFIC,
) -> DataFrame:
    """Top crop (with fallback) and top query type of every target; a place without calls shows N/A."""
    leaders = leading_values(value_counts(df, targets, keys, [crop_col, type_col]), keys, 2)
    # one pass over the leaders for both columns: only the crop is allowed to fall back
    allowed = F.when(F.col("kind") == crop_col, F.lit(True)).otherwise(F.col("rank") == 1)
    tops = (
        top_with_fallback(leaders.where(allowed), keys, others)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("kind") == crop_col, F.col("top"))).alias("top_crop"),
            F.max(F.when(F.col("kind") == type_col, F.col("top"))).alias("top_query_type"),
        )
    )
    places = targets.select(*[_place(k) for k in keys]).distinct()
    return places.join(tops, keys, "left").select(
        *keys,
        F.coalesce("top_crop", F.lit("N/A")).alias("top_crop"),
        F.coalesce("top_query_type", F.lit("N/A")).alias("top_query_type"),
    )


def place_top(
    df: DataFrame, targets: DataFrame, keys: list[str], col: str,
    others: tuple[str, ...] = (),
) -> DataFrame:
    """Top value of one column per target place, N/A for a place without values; with ``others`` the
    fallback applies."""
    leaders = leading_values(value_counts(df, targets, keys, [col]), keys, 2 if others else 1)
    places = targets.select(*[_place(k) for k in keys]).distinct()
    return places.join(top_with_fallback(leaders, keys, others), keys, "left").select(
        *keys, F.coalesce("top", F.lit("N/A")).alias(col)
    )


def top_value_is(
    df: DataFrame, place: str, col: str, value: str, exclude: tuple[str, ...] = ("Others",)
) -> DataFrame:
    """Places whose most frequent value, the excluded ones aside, is ``value``; by call volume."""
    per_value = df.groupBy(place, col).agg(F.count(F.lit(1)).alias("n"))
    counted = F.col(col).isNotNull() & (trim_ws(F.col(col)) != "") & ~F.col(col).isin(list(exclude))
    return (
        per_value.groupBy(place)
        .agg(
            F.sum("n").alias("calls"),
            F.coalesce(F.sum(F.when(F.col(col) == value, F.col("n"))), F.lit(0)).alias("value_calls"),
            F.min(F.when(counted, F.struct((-F.col("n")).alias("neg"), F.col(col).alias("v")))).alias("top"),
        )
        .where(F.col("top.v") == value)
        .orderBy(F.desc("calls"), place)
        .select(place, "calls", "value_calls")
    )
