"""The stored call table: typed, one folder per year, sorted inside for skipping.

A delivery replaces the years that it holds and no others. Inside a year the rows are range-sorted by
month and place, so a file, and a row group in it, spans few months and states: a filter on Year
leaves folders unread, one on Month or StateName leaves files and row groups unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions.text import norm_query
from callgrain.schema import typed_view
from callgrain.session import materialize

YEAR = "Year"
# The columns that rows are sorted by within a year, as far as a table has them.
SORTED = ("Month", "StateName", "DistrictName")
NORM = "QueryNorm"


def write_calls(calls: DataFrame, path: str, text_col: str | None = None, parts: int | None = None) -> None:
    """Stores the calls of all years in ``calls``; a year stored before is replaced, others stay.

    With ``text_col`` the normalised question is stored too, as ``QueryNorm``, so that no reader has
    to work it out again. Calls without a readable year have a folder of their own.
    """
    typed = typed_view(calls)
    if text_col:
        # written first: in the same step as a sort the rewrite would run once for the sort's sample
        # of the rows and once for the rows
        typed = materialize(typed.withColumn(NORM, norm_query(F.col(text_col))), "typed")
    order = [F.col(c) for c in (YEAR, *(c for c in SORTED if c in typed.columns))]
    # the hash splits a month and place that alone would fill a range
    spread = F.xxhash64(*[c for c in typed.columns if c != YEAR])
    (
        typed.repartitionByRange(*([parts] if parts else []), *order, spread)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(YEAR)
        .parquet(path)
    )


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """All stored calls; filters on Year, Month and places reach the scan."""
    return spark.read.parquet(path)


def years(spark: SparkSession, path: str) -> DataFrame:
    """(Year, n_files, n_rows) of what is stored."""
    rows = read_calls(spark, path).select(YEAR, F.col("_metadata.file_path").alias("file"))
    per_file = rows.groupBy(YEAR, "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(YEAR).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"))
