from callgrain.streaming import distinct as D
from pyspark.sql.types import StringType, StructField, StructType

SCHEMA = StructType([StructField("id", StringType()), StructField("ts", StringType())])


def deliver(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return D.distinct_stream(spark, f"{base}/in", SCHEMA, f"{base}/out", f"{base}/check", ["id", "ts"], "ts", "2 days")


def day(n, i=0):
    return f"2024-01-{n:02d} 00:00:{i:02d}"


def test_equals_batch_with_late_and_unreadable_rows(spark, tmp_path):
    base, all_rows, held = str(tmp_path), [], []
    for delivery in (
        [(str(i), day(1, i)) for i in range(20)],
        [(str(i), day(1, i)) for i in range(5)] + [(str(i), day(9, i)) for i in range(30)],  # copies, then a jump in time
        [(str(i), day(20, i)) for i in range(10)],
        [("late", day(2)), ("late", day(2)), ("3", day(1, 3)), ("bad", "no time"), ("bad", "no time"), ("5", day(20, 5)), ("none", None)],
    ):
        all_rows += delivery
        held += deliver(spark, base, delivery)
    got = [tuple(r) for r in D.distinct_rows(spark, f"{base}/out", SCHEMA).collect()]
    assert len(got) == len(set(got)) and set(got) == set(all_rows)
    # state follows the watermark instead of the rows seen
    assert any(b["late_rows"] for b in held) and any(b["unreadable"] for b in held)
    assert held[-1]["state_rows"] < len(set(all_rows))


def test_state_is_bounded(spark, tmp_path):
    states = []
    for n in range(3):
        states += deliver(spark, str(tmp_path), [(str(i), day(1 + 9 * n, i)) for i in range(50)])
    assert max(b["state_rows"] for b in states) <= 100
