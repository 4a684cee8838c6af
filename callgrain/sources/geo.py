"""Boundary features, two-column measures and name overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Property names under which boundary files keep their place names, by preference.
STATE_KEYS = ["StateName", "STATE_NAME", "state", "NAME_1"]
DISTRICT_KEYS = ["DistrictName", "DISTRICT", "district", "NAME_2"]

_FEATURE = "properties map<string,string>, geometry string"
_COLLECTION = "features array<struct<properties:map<string,string>,geometry:string>>"


def read_features(
    spark: SparkSession,
    path: str,
    name_keys: dict[str, list[str]] | None = None,
    layout: str = "collection",
) -> DataFrame:
    """GeoJSON features: one column per name, all properties as a map, the geometry as JSON text.

    ``collection`` reads a FeatureCollection document, which one task has to parse as a whole;
    ``lines`` reads one feature per line and splits like any text file.
    """
    keys = name_keys or {"StateName": STATE_KEYS, "DistrictName": DISTRICT_KEYS}
    if layout == "lines":
        features = spark.read.schema(_FEATURE).json(path)
    else:
        doc = spark.read.schema(_COLLECTION).option("multiLine", True).json(path)
        features = doc.select(F.explode("features").alias("f")).select("f.*")
    names = [
        F.coalesce(*[F.nullif(F.col("properties")[k], F.lit("")) for k in options]).alias(name)
        for name, options in keys.items()
    ]
    return features.select(*names, "properties", "geometry")


def read_measure(spark: SparkSession, path: str, name_col: str = "District", value_col: str = "value") -> DataFrame:
    """A table of names and numbers, columns taken by position whatever their titles."""
    return spark.read.option("header", True).schema(f"`{name_col}` string, `{value_col}` double").option(
        "enforceSchema", True
    ).csv(path)


def read_overrides(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """(raw, official) pairs from JSON maps, one document per file or one map per line, or from the table form."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("raw", "official")
    text = spark.read.text(path, wholetext=fmt == "json-document")
    pairs = F.from_json("value", "map<string,string>")
    return text.select(F.explode(pairs).alias("raw", "official"))


def write_overrides(df: DataFrame, path: str) -> None:
    """Store the pairs as a table; a later official name for the same raw name needs a new table."""
    df.select("raw", "official").write.mode("errorifexists").parquet(path)
