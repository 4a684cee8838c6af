"""The transcript table: raw text columns and the typed view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callgrain.functions.text import trim_ws

# The 13 columns of the published transcript files, in file order.
TRANSCRIPT_COLUMNS = [
    "StateName", "DistrictName", "BlockName", "Season", "Sector", "Category", "Crop",
    "QueryType", "QueryText", "KccAns", "CreatedOn", "Year", "Month",
]

TRANSCRIPT_SCHEMA = StructType([StructField(c, StringType(), True) for c in TRANSCRIPT_COLUMNS])

FACETS = ("StateName", "DistrictName", "Crop", "QueryType")


def typed_view(df: DataFrame) -> DataFrame:
    """Trim the facet columns and give Year, Month and CreatedOn their types; bad values are null.

    Run once after ingest and stored, this makes facet and month filters plain column predicates,
    which reach the Parquet scan.
    """
    casts = {"Year": "int", "Month": "bigint", "CreatedOn": "timestamp"}
    out = []
    for name in df.columns:
        if name in FACETS:
            out.append(trim_ws(F.col(name)).alias(name))
        elif name in casts:
            out.append(F.col(name).try_cast(casts[name]).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
