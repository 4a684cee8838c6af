"""The given tables seen as transcripts: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callgrain.plans.spread import spread
from callgrain.session import new_dir

# Pages carry text only; the types are given after the load.
EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}
EVENT_SCHEMA = StructType([StructField(c, StringType()) for c in EVENT_TYPES])
PAGE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls: place, crop, topic and time."""
    orders, customer, nation, region = (
        table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("r_name").alias("StateName"),
            F.col("n_name").alias("DistrictName"),
            F.col("c_mktsegment").alias("Crop"),
            F.col("o_orderpriority").alias("QueryType"),
            F.year("o_orderdate").cast("bigint").alias("Year"),
            F.month("o_orderdate").cast("string").alias("Month"),
        )
    )


def calls_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, the assistant's next turn as the answer."""
    turns = spread(table(spark, sf_dir, "conversations"))
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("QueryText"))
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("KccAns")
    )
    return asked.join(given, ["conv_id", "turn"], "left")


def docs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions."""
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("lang").alias("StateName"),
        F.col("source").alias("DistrictName"),
        F.col("text").alias("QueryText"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as district features, spelled unlike the calls."""
    return places(spark, sf_dir).select(
        F.col("r_name").alias("StateName"),
        F.concat(F.lit(" "), F.lower("n_name")).alias("DistrictName"),
        "n_nationkey",
    )


def edited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a fixed kind of slip: last letter lost, blank lost, first letter doubled."""
    name = F.col("p_name")
    kind = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select(
        F.when(kind == 0, F.substr(name, F.lit(1), F.length(name) - 1))
        .when(kind == 1, F.replace(name, F.lit(" "), F.lit("")))
        .otherwise(F.concat(F.substring(name, 1, 1), name))
        .alias("target")
    )


def name_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        edited_names(spark, sf_dir)
        .where(F.startswith("target", F.lit("hh")))
        .select(F.col("target").alias("raw"), F.lit("old bolt").alias("official"))
        .distinct()
    )


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as CSV lines, some cut short and some with a field too many."""
    calls = calls_dim(spark, sf_dir)
    names = ["row_id", "StateName", "DistrictName", "Crop", "QueryType", "Year", "Month"]
    full = F.concat_ws(",", *names)
    cut = F.concat_ws(",", *names[:5])
    return calls.select(
        F.when(F.col("row_id") % 50 == 0, cut)
        .when(F.col("row_id") % 70 == 0, F.concat(full, F.lit(",extra")))
        .otherwise(full)
        .alias("line")
    )


def event_pages(events: DataFrame, out: str) -> str:
    """Events cut into pages by event_id, one folder per page offset."""
    offset = F.floor(F.col("event_id") / PAGE_ROWS) * PAGE_ROWS
    (
        events.select(*[F.col(c).cast("string") for c in EVENT_TYPES], offset.alias("offset"))
        .repartition("offset")
        .write.mode("append")
        .option("header", True)
        .option("escape", '"')
        .partitionBy("offset")
        .csv(out)
    )
    return out


def error_pages(offsets: DataFrame, out: str, lines: list[str]) -> str:
    """The same error message, not CSV, as the body of the page at each ``offset``."""
    (
        offsets.select("offset", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("i", "body"))
        .repartition("offset")
        .sortWithinPartitions("offset", "i")
        .select("body", "offset")
        .write.mode("append")
        .option("quote", "")
        .option("sep", "\x01")
        .partitionBy("offset")
        .csv(out)
    )
    return out


def typed_events(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in EVENT_TYPES.items()})


def fresh_pages(spark: SparkSession, sf_dir: str) -> str:
    return event_pages(table(spark, sf_dir, "events"), new_dir(spark, "pages"))


def letter_model():
    """An embedder that counts the letters a-z: simple enough to be repeated in SQL.

    Defined inside a function so that it travels to the workers by value.
    """
    import numpy as np

    def letters(texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), 26), dtype=np.float64)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            counts[i] = np.bincount(codes, minlength=123)[97:123]
        return counts

    return letters
