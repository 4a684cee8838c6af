"""Resumable ingest of page files as a stream, and counts kept up to date behind it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callgrain.sources.transcripts import BAD_RECORD, is_header, page_offset


def ingest(
    spark: SparkSession,
    pages: str,
    out: str,
    checkpoint: str,
    schema: StructType,
    dedup_cols: list[str] | None = None,
    event_time: str | None = None,
    multi_line: bool = True,
    max_files: int | None = None,
) -> None:
    """Load the page files not loaded before, then stop; run again after new pages have arrived.

    The checkpoint, which belongs to ``out``, remembers the files; each batch is written to folders
    of its own number, so a run that broke off repeats a batch over itself and neither loses nor
    doubles a page. ``max_files`` bounds a batch.

    A page is good if it has a header line with the names of ``schema``. All records of another
    page (an error message instead of CSV, in whatever number of lines), rows of the wrong length
    and, with ``event_time``, rows with an unreadable time go to quarantine with their text and
    the page's offset. A page delivered again is read if its file has a new name.

    Equal rows are kept once over all time. Nothing is held in state: a batch is compared with the
    32-byte digests of the rows stored so far, with ``event_time`` only with those of the days that
    the batch spans, as equal rows are of the same day.
    """
    flagged = StructType([*schema.fields, StructField(BAD_RECORD, StringType(), True)])
    names = schema.fieldNames()
    reader = (
        spark.readStream.schema(flagged)
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("multiLine", multi_line)
        .option("columnPruning", False)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    rows = reader.csv(pages).select("*", path.alias("_path"), page_offset(path).alias("page_offset"))
    day = _day(event_time)
    bad_time = F.col(event_time).isNotNull() & day.isNull() if event_time else F.lit(False)
    days = ["event_date"] if event_time else []

    def load(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_header", F.col(BAD_RECORD).isNull() & is_header(names)).persist(StorageLevel.DISK_ONLY)
        # a page is of bounded size, so no path is hot
        good_pages = batch.where("_header").select("_path").distinct().withColumn("_page", F.lit(True))
        records = batch.where(~F.col("_header")).join(good_pages, "_path", "left")
        bad = F.col("_page").isNull() | F.col(BAD_RECORD).isNotNull() | bad_time
        text = F.coalesce(BAD_RECORD, F.to_csv(F.struct(*names)))
        records.where(bad).select(text.alias("record"), "page_offset", F.col("_page").isNull().alias("bad_page")).write.mode(
            "overwrite"
        ).parquet(f"{out}/quarantine/batch={number}")
        digest = F.unhex(F.sha2(F.to_json(F.struct(*(dedup_cols or names))), 256))
        new = records.where(~bad).select(*names, "page_offset", digest.alias("_digest"), day.alias("event_date"))
        new = new.dropDuplicates(["_digest"])
        if number > 0:
            seen = spark.read.parquet(f"{out}/rows").where(F.col("batch") < number)
            if event_time:
                lo, hi = batch.agg(F.min(day), F.max(day)).first()
                seen = seen.where(F.col("event_date").between(lo, hi) | F.col("event_date").isNull())
            new = new.join(seen.select("_digest"), "_digest", "left_anti")
        # a day's rows come together, or each task would write a file for each day
        new = new.hint("rebalance", "event_date") if event_time else new.drop("event_date")
        new.write.mode("overwrite").partitionBy(*days).parquet(f"{out}/rows/batch={number}")
        batch.unpersist()

    query = (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _day(event_time: str | None) -> Column:
    if event_time is None:
        return F.lit(None).cast("date")
    return F.col(event_time).try_cast("timestamp").cast("date")


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The good rows loaded so far."""
    return spark.read.parquet(f"{out}/rows").drop("_digest", "batch", "event_date")


def quarantined(spark: SparkSession, out: str) -> DataFrame:
    """(record, page_offset, bad_page) of what was rejected so far; ``bad_page`` marks records of
    pages that were rejected whole."""
    return spark.read.parquet(f"{out}/quarantine").drop("batch")


def running_counts(spark: SparkSession, out: str, by: list[str], counts: str, checkpoint: str) -> DataFrame:
    """Rows per key of all that ``ingest`` has stored, as a complete-mode stream.

    A run reads the folders stored since the last one and adds them to the counts in its state, one
    row per key; it returns the counts of its last batch. Run it between runs of ``ingest``.
    """
    rows = f"{out}/rows"
    stream = spark.readStream.schema(spark.read.parquet(rows).schema).parquet(rows)
    query = (
        stream.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("count"))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{counts}/batch={n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    versions = spark.read.parquet(counts)
    last = versions.agg(F.max("batch")).scalar()
    return versions.where(F.col("batch") == last).drop("batch")
