import json

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from callgrain.sources import geo as G
from callgrain.sources import transcripts as S
from callgrain.streaming import ingest as stream

SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b", "c")])
GOOD = 'a,b,c\n1,x,y\n1,x,y\n2,"two\nlines","say ""hi"""\n3,only\n4,x,y,z\n5,कि,\n'


@pytest.fixture
def csv(tmp_path):
    p = tmp_path / "in" / "t.csv"
    p.parent.mkdir()
    p.write_text(GOOD + "6,cu", encoding="utf-8")
    return str(p)


def test_csv_drops_rows_of_wrong_length(spark, csv):
    df = S.read_transcripts(spark, csv, "csv", SCHEMA)
    assert df.count() == 4  # a count alone must not let them through
    assert sorted(r["a"] for r in df.select("a").collect()) == ["1", "1", "2", "5"]
    assert df.where("a = '2'").first()["b"] == "two\nlines" and df.where("a = '2'").first()["c"] == 'say "hi"'


def test_quarantine(spark, csv):
    good, bad = S.split_malformed(spark, csv, SCHEMA)
    assert good.count() == 4 and bad.count() == 3
    assert sorted(r["record"] for r in bad.collect()) == ["3,only", "4,x,y,z", "6,cu"]


def test_header_names(spark, tmp_path):
    (tmp_path / "h.csv").write_text("State Name,b\nx,1\n")
    assert S.read_transcripts(spark, str(tmp_path / "h.csv"), "csv").columns == ["State_Name", "b"]


def pages(tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "offset_0000000.csv").write_text("a,b,c\n1,x,y\n2,x,y\n")
    (d / "offset_0000002.csv").write_text("a,b,c\n3,x,y\n4,x,y\n")
    (d / "offset_0000004.csv").write_text(' \n {"error":"limit, reached"}')
    (d / "note.txt").write_text("a,b,c\n9,9,9\n")
    return d


def test_pages(spark, tmp_path):
    d = str(pages(tmp_path))
    rows = S.drop_error_pages(spark, d, SCHEMA).collect()
    assert sorted((r["a"], r["page_offset"]) for r in rows) == [("1", 0), ("2", 0), ("3", 2), ("4", 2)]
    manifest = S.page_manifest(spark, d).collect()
    assert sorted((r["offset"], r["is_error"]) for r in manifest) == [(0, False), (2, False), (4, True)]


def rows_of(spark, out):
    return sorted(r["a"] for r in stream.ingested(spark, out).collect())


def test_ingest_resumes(spark, tmp_path):
    d = pages(tmp_path)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA)
    assert rows_of(spark, out) == ["1", "2", "3", "4"]
    (d / "offset_0000006.csv").write_text("a,b,c\n4,x,y\n5,x,y\n6,x\n")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA)
    stream.ingest(spark, str(d), out, ckpt, SCHEMA)
    assert rows_of(spark, out) == ["1", "2", "3", "4", "5"]
    bad = {r["record"]: (r["page_offset"], r["bad_page"]) for r in stream.quarantined(spark, out).collect()}
    assert bad["6,x"] == (6, False) and any("error" in b for b in bad)


def test_ingest_keeps_error_pages_and_takes_their_repair(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    (d / "offset_0000000.csv").write_text("a,b,c\n1,x,y\n")
    (d / "offset_0000002.csv").write_text('{"error":"no"}')
    (d / "offset_0000004.csv").write_text("{\n wait, a, while\n}")
    (d / "offset_0000006.csv").write_text("a, B ,c\n")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA)
    assert rows_of(spark, out) == ["1"]
    bad = [r for r in stream.quarantined(spark, out).collect() if r["bad_page"]]
    assert {r["page_offset"] for r in bad} == {2, 4} and len(bad) == 4
    (d / "offset_0000002_again.csv").write_text("a,b,c\n2,x,y\n1,x,y\n")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA)
    assert rows_of(spark, out) == ["1", "2"]


def test_ingest_by_day(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    (d / "offset_0.csv").write_text("a,b,c\n1,2020-01-01 10:00:00,y\n2,,y\n3,soon,y\n")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA, event_time="b")
    (d / "offset_3.csv").write_text("a,b,c\n1,2020-01-01 10:00:00,y\n2,,y\n4,2020-01-02 10:00:00,y\n")
    stream.ingest(spark, str(d), out, ckpt, SCHEMA, event_time="b")
    assert rows_of(spark, out) == ["1", "2", "4"]
    assert [r["record"] for r in stream.quarantined(spark, out).collect()] == ["3,soon,y"]


def test_running_counts(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i in range(3):
        (d / f"offset_{i}.csv").write_text(f"a,b,c\n{i},x,y\n{i},z,y\n")
        stream.ingest(spark, str(d), out, ckpt, SCHEMA)
        counts = stream.running_counts(spark, out, ["b"], str(tmp_path / "n"), str(tmp_path / "n-ckpt"))
        assert {r["b"]: r["count"] for r in counts.collect()} == {"x": i + 1, "z": i + 1}


def test_sink_keeps_blanks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'q"x', "l\nm")], SCHEMA)
    S.write_csv(df, str(tmp_path / "o"))
    assert S.read_transcripts(spark, str(tmp_path / "o"), "csv", SCHEMA).collect() == df.collect()
    with pytest.raises(Exception):
        S.write_csv(df, str(tmp_path / "o"))


def test_features(spark, tmp_path):
    props = [
        {"StateName": "S", "DistrictName": "D"}, {"STATE_NAME": "S2", "DISTRICT": "D2"},
        {"StateName": "", "state": "S3", "district": "D3"}, {"NAME_1": "S4", "NAME_2": "D4"}, {"x": "y"},
    ]
    features = [
        {"type": "Feature", "properties": p, "geometry": {"type": "Point", "coordinates": [1, 2.5]}} for p in props
    ]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    df = G.read_features(spark, str(tmp_path / "f.json"))
    assert [(r[0], r[1]) for r in df.collect()] == [("S", "D"), ("S2", "D2"), ("S3", "D3"), ("S4", "D4"), (None, None)]
    assert json.loads(df.first()["geometry"]) == features[0]["geometry"]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(f) for f in features))
    lines = G.read_features(spark, str(tmp_path / "l.json"), layout="lines")
    assert lines.select("StateName", "DistrictName").collect() == df.select("StateName", "DistrictName").collect()


def test_overrides_and_measure(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"hissar": "hisar", "x": "y"}, indent=2))
    df = G.read_overrides(spark, str(tmp_path / "o.json"), "json-document")
    assert sorted(map(tuple, df.collect())) == [("hissar", "hisar"), ("x", "y")]
    G.write_overrides(df, str(tmp_path / "t"))
    assert sorted(map(tuple, G.read_overrides(spark, str(tmp_path / "t"), "parquet").collect())) == [("hissar", "hisar"), ("x", "y")]
    (tmp_path / "m.csv").write_text("any title,spend\nAgra,1.5\n")
    assert G.read_measure(spark, str(tmp_path / "m.csv")).first().asDict() == {"District": "Agra", "value": 1.5}


def test_unterminated_last_line(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    files = {
        "whole.csv": "a,b\n1,x\n2,y\n", "cut.csv": "a,b\n3,x\n4,yy", "cut_field.csv": "a,b\r\n5,x\r\n6", "head_only.csv": "a,b\n",
        "cut_head.csv": "a,", "empty.csv": "", "mark.csv": "﻿a,b\n7,x\n8,é", "mark_whole.csv": "﻿a,b\n9,é\n", "odd.csv": 'a,b\n10,"x, y"\n11\n12,p,q\n',
        "long.csv": "a,b\n" + "".join(f"{i},z\n" for i in range(1000, 3000)) + "9999,z",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    good, bad = S.read_complete(spark, str(tmp_path), schema)
    got = {(r["a"], r["b"]) for r in good.collect()}
    assert got == {("1", "x"), ("2", "y"), ("3", "x"), ("5", "x"), ("7", "x"), ("9", "é"), ("10", "x, y")} | {(str(i), "z") for i in range(1000, 3000)}
    rejected = {(r["record"], r["unterminated"]) for r in bad.collect()}
    assert rejected == {("4,yy", True), ("6", True), ("a,", True), ("8,é", True), ("11", False), ("12,p,q", False), ("9999,z", True)}


def test_unterminated_line_of_a_split_file(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    (tmp_path / "one.csv").write_text("a,b\n" + "".join(f"{i},z{i}\n" for i in range(5000)) + "x,y")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        good, bad = S.read_complete(spark, str(tmp_path), schema)
        assert good.count() == 5000 and [r["record"] for r in bad.collect()] == ["x,y"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
