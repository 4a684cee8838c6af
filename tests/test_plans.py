import random

from pyspark.sql import functions as F

from callgrain.plans import skew
from callgrain.plans.components import connected_components
from callgrain.plans.ids import with_ids
from callgrain.plans.skew import skew_join


def test_skew_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 1000)
    left = spark.range(12000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how, rows in (("left", None), ("inner", None), ("left", 12000)):
        plain = left.join(right, "k", how).select("id", "k", "v")
        got = skew_join(left, right, ["k"], ["id"], how, rows=rows, part_rows=500).select("id", "k", "v")
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_skew_join_deals_out_hot_key(spark):
    left = spark.range(300000).select("id", F.lit(7).alias("k"))
    right = spark.createDataFrame([(7, 1)], "k int, v int")
    small = skew_join(left, right, ["k"], ["id"], rows=skew.ONE_TASK_ROWS)
    assert "_salt" not in small._jdf.queryExecution().analyzed().toString()
    assert "_salt" in skew_join(left, right, ["k"], ["id"])._jdf.queryExecution().analyzed().toString()
    assert skew_join(left.limit(5), right, ["k"], ["id"]).count() == 5


def test_skew_join_balances_a_third_of_all_rows(spark):
    left = spark.range(3_000_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(left, right, ["k"], ["id"], part_rows=20_000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3_000_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_ids(spark):
    words = [f"w{random.Random(i).random()}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["i"] for r in with_ids(df, "i", ["w"]).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)]  # a chain
    edges += [(100, i) for i in range(101, 160)]  # a star
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(n, n) == find(n) for n in parent)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
