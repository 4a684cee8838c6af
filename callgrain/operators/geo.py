"""Counts and measures on boundary features, and the colour scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.functions.text import norm_key


def geo_counts(features: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every feature with the number of calls of its place; 0 where there are none.

    Spellings that share a key are added up. Calls are counted on the stored spelling first, so
    the key rewrite runs once per spelling. Which side is broadcast is left to the sizes.
    """
    stored = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    marks = [f"_key_{k}" for k in keys]
    counts = stored.groupBy(*[norm_key(F.col(k)).alias(m) for k, m in zip(keys, marks)]).agg(
        F.sum("n").alias("count")
    )
    keyed = features.select("*", *[norm_key(F.col(k)).alias(m) for k, m in zip(keys, marks)])
    return keyed.join(counts, marks, "left").select(
        *features.columns, F.coalesce("count", F.lit(0)).alias("count")
    )


def geo_measure(features: DataFrame, measure: DataFrame, feature_col: str, matched_col: str) -> DataFrame:
    """Features with the measures matched to their name; a feature with two measures appears twice."""
    values = measure.withColumnRenamed(matched_col, "_name")
    return features.join(values, F.col(feature_col) == F.col("_name"), "left").drop("_name")


def value_range(df: DataFrame, col: str) -> DataFrame:
    """Low and high end of the colour scale; 0 and 1 for an empty table."""
    return df.agg(
        F.coalesce(F.min(col), F.lit(0)).cast("double").alias("low"),
        F.coalesce(F.max(col), F.lit(1)).cast("double").alias("high"),
    )


def bin_linear(df: DataFrame, col: str, n: int = 9, bin_col: str = "bin") -> DataFrame:
    """Colour step 1..n of each value between the smallest and the largest; null stays null.

    The largest value belongs to the last step, also where all values are equal.
    """
    # the same subquery twice: Spark runs it once
    ends = value_range(df, col).select(F.struct("low", "high")).scalar()
    low, high = ends["low"], ends["high"]
    v = F.col(col)
    step = F.floor((v - low) * F.lit(n) / F.nullif(high - low, F.lit(0.0))).cast("int") + 1
    return df.withColumn(
        bin_col, F.when(v.isNotNull(), F.coalesce(F.least(step, F.lit(n)), F.lit(n)))
    )
