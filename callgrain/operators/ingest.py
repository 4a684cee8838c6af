"""Table preparation: slices, completeness, duplicates, merging, sampling, keyword lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.functions.text import trim_ws
from callgrain.plans.ids import rows_between


def slice_rows(df: DataFrame, filters: dict, order: list, offset: int, limit: int) -> DataFrame:
    """Rows that equal every filter value, from ``offset`` on, at most ``limit``, in a total order."""
    out = reduce(lambda acc, kv: acc.where(F.col(kv[0]) == F.lit(kv[1])), filters.items(), df)
    return rows_between(out, order, offset, limit)


def missing_offsets(spark: SparkSession, manifest: DataFrame, total: int, limit: int) -> DataFrame:
    """Page offsets expected for ``total`` records but absent from the manifest."""
    expected = spark.range(0, total, limit).withColumnRenamed("id", "offset")
    return expected.join(manifest.select(F.col("offset").cast("bigint")), "offset", "left_anti")


def page_progress(spark: SparkSession, manifest: DataFrame, total: int, limit: int) -> DataFrame:
    """Pages done, expected and missing."""
    expected = spark.range(0, total, limit).withColumnRenamed("id", "offset")
    done = manifest.select(F.col("offset").cast("bigint")).distinct().withColumn("got", F.lit(1))
    joined = expected.join(done, "offset", "left")
    return joined.agg(
        F.count("got").alias("done"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("got").isNull()).alias("missing"),
    )


def dedup(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row of every set of equal rows; with ``cols`` only these columns are kept and compared."""
    return (df.select(*cols) if cols else df).distinct()


def merge_years(dfs: list[DataFrame], state: str | None = None, state_col: str = "StateName") -> DataFrame:
    """Stack the yearly tables by column name; with ``state`` keep that state only."""
    merged = reduce(lambda a, b: a.unionByName(b), dfs)
    if state is None:
        return merged
    return merged.where(F.upper(trim_ws(F.col(state_col))) == state.strip().upper())


def sample_n(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer), uniform and repeatable: those with the smallest key hash.

    A plain sort-and-limit would have every task hand over n rows to one merging task. Counting the
    hashes by their first four digits (at most 65,536 groups) finds the digit range that holds the
    n smallest; only about n rows pass and are sorted.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    head = F.substring(digest, 1, 4)
    histogram = df.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("m"))
    # a window over at most 65,536 rows
    upto = histogram.withColumn("upto", F.sum("m").over(Window.orderBy("head")))
    cut = upto.where(F.col("upto") - F.col("m") < n).agg(F.max("head")).scalar()
    return (
        df.withColumn("_digest", digest)
        .where(F.substring("_digest", 1, 4) <= cut)
        .orderBy("_digest", *key)
        .limit(n)
        .drop("_digest")
    )


def keyword_match(title: Column, must: str, any_of: list[str] | None = None) -> Column:
    text = F.lower(title)
    hit = F.contains(text, F.lit(must.lower()))
    if any_of:
        hit = hit & reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in any_of])
    return hit


def keyword_catalog(df: DataFrame, title: str, id_col: str, must: str, any_of: list[str]) -> DataFrame:
    """Entries, counted once per id, whose title has the keyword, and those that also have one of the others."""
    per_id = df.groupBy(id_col).agg(
        F.bool_or(keyword_match(F.col(title), must)).alias("hit"),
        F.bool_or(keyword_match(F.col(title), must, any_of)).alias("both"),
    )
    return per_id.agg(
        F.count_if("hit").alias("with_keyword"), F.count_if("both").alias("with_keyword_and_other")
    )
