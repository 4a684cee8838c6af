from callgrain.streaming import ingest as I
from pyspark.sql.types import StringType, StructField, StructType

SCHEMA = StructType([StructField("id", StringType()), StructField("ts", StringType())])


def test_a_batch_writes_few_files_a_day(spark, tmp_path):
    """The rows of a day come together, whatever the number of tasks; none is lost."""
    base = str(tmp_path)
    rows = [(str(i), f"2024-01-{i % 5 + 1:02d} 00:00:00") for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.option("header", True).csv(f"{base}/pages/offset=0")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.ingest(spark, f"{base}/pages", base, f"{base}/checkpoint", SCHEMA, event_time="ts")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r["id"], r["ts"]) for r in I.ingested(spark, base).select("id", "ts").collect()) == sorted(rows)
    assert len(list((tmp_path / "rows").rglob("*.parquet"))) == 5
