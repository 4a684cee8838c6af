from callgrain.operators import profiles as P

CALLS = [
    *[("A", "x", "Others", "q1")] * 5, *[("A", "x", " Wheat ", "q2")] * 3,  # falls back
    *[("A", "y", "OTHER", "q1")] * 2,  # nothing to fall back to
    *[("B", "x", "Others", "q")] * 3, *[("B", "x", "Other", "q")] * 2, ("B", "x", "Rice", "q"),  # second is OTHER too
    *[("b ", "z", "Rice", "q")] * 2, *[("B", "z", "Maize", "p")] * 2,  # tie by name
    ("A", "w", "", None),
]
TARGETS = [("a", "X"), ("A", "Y"), ("B", "X"), ("B", "Z"), ("A", "W"), ("A", "NONE")]


def test_profile(spark):
    df = spark.createDataFrame(CALLS, "StateName string, DistrictName string, Crop string, QueryType string")
    targets = spark.createDataFrame(TARGETS, "StateName string, DistrictName string")
    rows = P.place_profile(df, targets, ["StateName", "DistrictName"]).collect()
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    assert got == {
        ("A", "X"): ("Wheat", "q1"), ("A", "Y"): ("OTHER", "q1"), ("B", "X"): ("Other", "q"),
        ("B", "Z"): ("Maize", "p"), ("A", "W"): ("N/A", "N/A"), ("A", "NONE"): ("N/A", "N/A"),
    }


def test_top_value_is(spark):
    rows = [*[("h", "Others")] * 9, *[("h", "Wheat")] * 3, ("h", "Rice"), *[("k", "Rice")] * 4, ("k", "Wheat"), ("m", "Wheat")]
    df = spark.createDataFrame(rows, "d string, c string")
    assert [tuple(r) for r in P.top_value_is(df, "d", "c", "Wheat").collect()] == [("h", 13, 3), ("m", 1, 1)]
