"""Distinct rows of a stream with state bounded by the watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Batches whose progress a query remembers unless told otherwise.
KEPT_PROGRESS = 100


def distinct_stream(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, key: list[str], time_col: str,
    delay: str, max_files: int | None = None, time_format: str | None = None,
) -> list[dict]:
    """Loads the Parquet files of ``source`` not loaded before and stores each row's first copy.

    Rows are equal when ``key`` is. ``time_col`` is parsed to a time (``time_format`` as in
    ``to_timestamp``), ``delay`` is how long after a row's time a copy of it may still come: for so
    long, and no longer, its key is held. A row that comes later than that, or has no readable time,
    is not dropped: after the run such rows are compared with all that is stored, and those that are
    no copies are stored too.

    Returns per batch the rows in, the keys held, the late rows and those without a readable time.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = F.col(time_col)
    when = F.try_to_timestamp(text, F.lit(time_format)) if time_format else text.try_cast("timestamp")
    rows = reader.parquet(source).withColumn("_when", when)
    # the watermark operator sees all rows; the duplicates' one leaves the late ones out
    marked = rows.withWatermark("_when", delay).observe("times", F.count_if(F.col("_when").isNull()).alias("unreadable"))
    kept = marked.where(F.col("_when").isNotNull()).dropDuplicatesWithinWatermark(key)
    query = (
        kept.drop("_when").writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = query.recentProgress
    batches = [
        {"batch": p.batchId, "rows_in": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
         "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
         "unreadable": p.observedMetrics["times"]["unreadable"] if "times" in p.observedMetrics else 0}
        for p in seen
    ]
    # the progress of old batches is forgotten, so where there were many the rest is looked for
    if any(b["late_rows"] or b["unreadable"] for b in batches) or (seen and seen[0].batchId > 0 and len(seen) >= KEPT_PROGRESS):
        _store_rest(spark, source, schema, out, key)
    return batches


def _store_rest(spark: SparkSession, source: str, schema: StructType, out: str, key: list[str]) -> None:
    """Rows that the watermark left out and that are no copy of a stored one, each once."""
    stored = distinct_rows(spark, out, schema)
    all_rows = spark.read.schema(schema).parquet(source)
    same = F.lit(True)
    for k in key:
        same = same & all_rows[k].eqNullSafe(stored[k])
    missing = all_rows.join(stored, same, "left_anti").dropDuplicates(key)
    missing.write.mode("append").parquet(f"{out}/late")


def distinct_rows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All rows stored so far, those that came too late among them."""
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    try:
        return rows.unionByName(spark.read.schema(schema).parquet(f"{out}/late"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
