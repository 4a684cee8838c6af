from pyspark.sql import functions as F

from callgrain.operators import explore as E
from callgrain.operators import ingest as I
from callgrain.plans import ids as ids_plan
from callgrain.schema import TRANSCRIPT_SCHEMA, typed_view

CALLS = (
    "id int, StateName string, DistrictName string, Crop string, QueryType string, Month string, QueryText string, KccAns string"
)


def calls(spark):
    return spark.createDataFrame(
        [
            (1, "UP", "AGRA", " Wheat", "Weather", "1", "Weather in Agra?", "Rain tomorrow"),
            (2, "UP", "AGRA", "Paddy", "Government Schemes", " 2", "PM Kisan status", "paid कि"),
            (3, "UP", None, "Wheat", "Weather", "x", "the weather of agra", None),
            (4, "MP", "SAGAR", "", "Plant", "2", None, "nothing"),
            (5, None, "SAGAR", "Wheat", None, None, "???", ""),
        ],
        CALLS,
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(spark):
    df = calls(spark)
    assert ids(E.facet_filter(df)) == [1, 2, 3, 4, 5]
    assert ids(E.facet_filter(df, {"StateName": ["UP"], "Crop": []}, month=2)) == [2]
    assert ids(E.facet_filter(df, {"StateName": ["UP", "MP"]})) == [1, 2, 3, 4]
    assert ids(E.facet_filter(df, {"DistrictName": ["AGRA"] + [f"d{i}" for i in range(1500)]})) == [1, 2]
    assert ids(E.facet_filter(df, search=" WEATHER|rain ")) == [1, 3]
    assert ids(E.facet_filter(df, search="?", regex=False)) == [1, 5]
    assert ids(E.facet_filter(df, search="  ")) == [1, 2, 3, 4, 5]


def test_facets(spark):
    df = calls(spark)
    assert [r[0] for r in E.facet_values(df, "Crop").collect()] == ["Paddy", "Wheat"]
    assert [r[0] for r in E.facet_months(df).collect()] == [1, 2]
    assert E.default_option(df, "QueryType", ["government", "scheme"]).first()[0] == "Government Schemes"
    assert E.default_option(df, "QueryType", ["nothing"]).first() is None
    assert E.overview(df, F.col("StateName") == "UP").first().asDict() == {"total_rows": 5, "filtered_rows": 3}


def test_counts(spark):
    df = calls(spark)
    rows = [tuple(r) for r in E.count_by(df, ["DistrictName"]).collect()]
    assert rows == [("AGRA", 2), ("SAGAR", 2), (None, 1)]
    assert sum(n for _, n in rows) == df.count()
    assert len(E.count_by(df, ["DistrictName"], 1).collect()) == 1


def test_question_groups(spark):
    df = calls(spark)
    assert [tuple(r) for r in E.top_query_texts(df).collect()] == [("weather agra", 2), ("status pmksn", 1)]
    got = [tuple(r) for r in E.descriptive_answers(df).collect()]
    assert got == [("weather agra", 2, 13, 6.5), ("status pmksn", 1, 11, 11.0)]
    assert [r["id"] for r in E.longest_answers(df, ["id"], 2, cols=("id",)).collect()] == [1, 2]
    samples = E.group_samples(df, "weather agra", ["id"], width=4).collect()
    assert [tuple(r) for r in samples] == [("Weat", "Rain"), ("the ", None)]


def test_pages(spark, monkeypatch):
    df = spark.range(103)
    assert [r[0] for r in E.page(df, ["id"], 5, 25).collect()] == [100, 101, 102]
    assert E.page_count(df, 25).first()["n_pages"] == 5
    assert E.page_count(df.where("id < 0"), 25).first()["n_pages"] == 1
    monkeypatch.setattr(ids_plan, "SHALLOW", 30)
    whole = [r[0] for k in range(1, 6) for r in E.page(df, ["id"], k, 25).collect()]
    assert whole == list(range(103))


def test_table_operators(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, None), (None, None)], "k string, v int")
    assert I.dedup(df).count() == 3 == I.dedup(I.dedup(df)).count()
    sample = I.sample_n(spark.range(5000), ["id"], 137, seed=3)
    assert sample.count() == 137 == sample.distinct().count()
    assert sorted(r[0] for r in sample.collect()) == sorted(
        r[0] for r in I.sample_n(spark.range(5000).repartition(7), ["id"], 137, seed=3).collect()
    )
    assert I.sample_n(spark.range(10), ["id"], 50).count() == 10
    manifest = spark.createDataFrame([(0,), (20,), (20,)], "offset int")
    assert sorted(r[0] for r in I.missing_offsets(spark, manifest, 45, 10).collect()) == [10, 30, 40]
    assert I.page_progress(spark, manifest, 45, 10).first().asDict() == {"done": 2, "total": 5, "missing": 3}
    titles = spark.createDataFrame([(1, "Kisan Yojana"), (1, "kisan"), (2, "KISAN mela"), (3, "other")], "id int, t string")
    got = I.keyword_catalog(titles, "t", "id", "kisan", ["scheme", "yojana"]).first()
    assert tuple(got) == (2, 1)
    y1 = spark.createDataFrame([(" up ", 1)], "StateName string, v int")
    y2 = spark.createDataFrame([(2, "MP"), (3, "Up")], "v int, StateName string")
    assert sorted(r["v"] for r in I.merge_years([y1, y2], "UP").collect()) == [1, 3]
    assert I.merge_years([y1, y2]).count() == 3
    sliced = I.slice_rows(spark.range(50).withColumn("g", F.col("id") % 2), {"g": 1}, ["id"], 3, 2)
    assert [r["id"] for r in sliced.collect()] == [7, 9]


def test_typed_view(spark):
    row = ["x"] * 13
    row[0], row[10], row[11], row[12] = " UP ", "2024-05-01T10:00:00", "2024", "bad"
    got = typed_view(spark.createDataFrame([tuple(row)], TRANSCRIPT_SCHEMA)).first()
    assert got["StateName"] == "UP" and got["Year"] == 2024 and got["Month"] is None and got["CreatedOn"].hour == 10
