import glob
import os

from callgrain.operators import explore
from callgrain.sources import call_store as S
from pyspark.sql import functions as F

ROWS = [(str(1990 + y), str(m), s, f"{s}-d", f"q {m}") for y in range(3) for m in range(1, 13) for s in (" ASIA ", "EUROPE") for _ in range(5)]


def calls(spark, rows=ROWS):
    return spark.createDataFrame(rows, "Year string, Month string, StateName string, DistrictName string, QueryText string")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/Year=*/*.parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_year_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/calls"
    S.write_calls(calls(spark), path, "QueryText")
    before = files(path)
    S.write_calls(calls(spark, [r for r in ROWS if r[0] == "1991"][:7]), path, "QueryText")
    after = files(path)
    others = {f for f in before if "Year=1991" not in f}
    assert others and all(after[f] == before[f] for f in others)
    assert not {f for f in before if "Year=1991" in f} & set(after)
    got = {r["Year"]: r["n_rows"] for r in S.years(spark, path).collect()}
    assert got == {1990: 120, 1991: 7, 1992: 120}
    assert {r["StateName"] for r in S.read_calls(spark, path).collect()} == {"ASIA", "EUROPE"}


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/calls"
    S.write_calls(calls(spark), path)
    found = explore.facet_filter(S.read_calls(spark, path), {"Year": [1990]}, month=3)
    p = plan(found)
    assert "PartitionFilters: [isnotnull(Year" in p or "PartitionFilters: [(Year" in p
    assert "EqualTo(Month,3)" in p.split("PushedFilters")[1]
    assert found.count() == 10


def test_files_hold_few_months(spark, tmp_path):
    path = f"{tmp_path}/calls"
    many = [r for r in ROWS for _ in range(20)]
    S.write_calls(calls(spark, many), path, parts=8)
    spans = S.read_calls(spark, path).groupBy(F.col("_metadata.file_path")).agg(F.count_distinct("Month").alias("m")).collect()
    assert len(spans) >= 8 and max(r["m"] for r in spans) < 8


def test_unreadable_years_and_empty(spark, tmp_path):
    path = f"{tmp_path}/calls"
    S.write_calls(calls(spark, [("x", "1", "A", "d", None), (None, "z", "A", "d", "q")]), path, "QueryText")
    rows = S.read_calls(spark, path).collect()
    assert [r["Year"] for r in rows] == [None, None] and {r["Month"] for r in rows} == {1, None}


def test_samples_by_the_stored_text(spark, tmp_path):
    path = f"{tmp_path}/calls"
    df = calls(spark).withColumnRenamed("DistrictName", "KccAns")
    S.write_calls(df, path, "QueryText")
    stored = S.read_calls(spark, path)
    group = stored.first()["QueryNorm"]
    key = ["Year", "Month", "StateName"]
    a = explore.group_samples(stored, group, key, norm_col="QueryNorm")
    assert sorted(map(str, a.collect())) == sorted(map(str, explore.group_samples(stored, group, key).collect())) and a.count() > 0
    assert "regexp_replace" not in plan(a)
