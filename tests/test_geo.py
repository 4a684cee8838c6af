from callgrain.operators import geo as G


def test_counts_add_up_spellings(spark):
    features = spark.createDataFrame([("UP", "Agra City", 1), ("UP", "Banda", 2), (None, None, 3)], "S string, D string, i int")
    calls = spark.createDataFrame([(" up", "AGRACITY"), ("UP", "Agra  City"), ("MP", "Agra City")], "S string, D string")
    got = {r["i"]: r["count"] for r in G.geo_counts(features, calls, ["S", "D"]).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_measure_keeps_fan_out(spark):
    f = spark.createDataFrame([("a",), ("b",)], "name string")
    m = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "match string, value double")
    got = sorted((r["name"], r["value"]) for r in G.geo_measure(f, m, "name", "match").collect() if r["value"])
    assert got == [("a", 1.0), ("a", 2.0)] and G.geo_measure(f, m, "name", "match").count() == 3


def test_bins(spark):
    df = spark.createDataFrame([(0,), (10,), (89,), (90,), (None,)], "v int")
    assert [r["bin"] for r in G.bin_linear(df, "v").orderBy("v").collect()] == [None, 1, 2, 9, 9]
    same = spark.createDataFrame([(7,), (7,)], "v int")
    assert {r["bin"] for r in G.bin_linear(same, "v").collect()} == {9}
    empty = G.value_range(df.where("v > 100"), "v").first()
    assert tuple(empty) == (0.0, 1.0)
