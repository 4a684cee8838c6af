"""Transcript files: Parquet, CSV and page files in; CSV out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callgrain.session import materialize

BAD_RECORD = "_malformed"


def _csv_reader(spark: SparkSession, schema: StructType | None, mode: str, multi_line: bool, header: bool = True):
    # columnPruning off: with it, a count or a narrow select would parse fewer fields and let
    # rows of the wrong length through
    reader = (
        spark.read.option("header", header)
        .option("mode", mode)
        .option("multiLine", multi_line)
        .option("columnPruning", False)
        .option("escape", '"')
    )
    return reader.schema(schema) if schema is not None else reader


def read_transcripts(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | None = None,
    multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """Transcripts from Parquet, or from CSV without the rows of the wrong length.

    Blanks in column names become underscores. A quoted line break needs ``multi_line``, which
    reads a file in one task: right for page files of bounded size; switch it off for one huge
    file without such breaks.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = _csv_reader(spark, schema, "DROPMALFORMED", multi_line, header).csv(path)
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def parse_flagged(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = True, header: bool = True
) -> DataFrame:
    """All records of a CSV; those of the wrong length carry their text in an extra column."""
    flagged = StructType([*schema.fields, StructField(BAD_RECORD, StringType(), True)])
    return (
        _csv_reader(spark, flagged, "PERMISSIVE", multi_line, header)
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .csv(path)
    )


def split_malformed(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = True, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, texts of bad rows), for example a last line cut by a broken transfer.

    The two are separate scans; store the flagged table first where both are needed at scale, as
    the streaming ingest does.
    """
    flagged = parse_flagged(spark, path, schema, multi_line, header)
    # the reader refuses a scan of the extra column alone, so the test also looks at a data column
    any_col = F.length(F.concat_ws("", F.col(schema.fields[0].name))) >= 0
    good = flagged.where(F.col(BAD_RECORD).isNull() & any_col).drop(BAD_RECORD)
    bad = flagged.where(F.col(BAD_RECORD).isNotNull() & any_col).select(F.col(BAD_RECORD).alias("record"))
    return good, bad


def read_complete(
    spark: SparkSession, path: str, schema: StructType, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with their file) of CSV files with one record per line.

    A last line that does not end in a line break was cut by a broken transfer. It is rejected even
    if it still has all its fields, as its last field may be cut. No file is read whole: the lines of
    a file and its size in bytes tell whether the last line break is there, and only the ends of
    files, two rows per file, are looked up again.
    """
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    # the order of lines: splits by their start, rows within a task by their number; fixed once written
    placed = F.struct(meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(text.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), placed.alias("place"), "value"), "lines")
    files = lines.groupBy("file").agg(
        F.max("place").alias("last"), F.min("place").alias("first"),
        (F.sum(F.octet_length("value") + 1) - F.max("size")).alias("over"),
    )
    # one byte more than the file has, or three less for the mark at the start that readers skip
    cut = F.col("over").isin(1, -2)
    ends = files.where(cut).select(F.col("last.at").alias("at"), F.lit(True).alias("cut"))
    if header:
        heads = files.where(~cut | (F.col("first") != F.col("last"))).select(F.col("first.at").alias("at"), F.lit(False).alias("cut"))
        ends = ends.unionByName(heads)
    marked = lines.withColumn("at", F.col("place.at")).join(ends, "at", "left").where("value != '' AND (cut IS NULL OR cut)")
    flagged = StructType([*schema.fields, StructField(BAD_RECORD, StringType(), True)])
    line = F.regexp_replace("value", r"\r\z", "")
    parsed = F.from_csv(line, flagged.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD, "escape": '"',
    })
    rows = marked.select("file", "cut", line.alias("line"), parsed.alias("r"))
    bad = F.col("cut").isNotNull() | F.col(f"r.{BAD_RECORD}").isNotNull()
    good = rows.where(~bad).select(*[F.col(f"r.{n}").alias(n) for n in schema.fieldNames()])
    return good, rows.where(bad).select(F.col("line").alias("record"), "file", F.col("cut").isNotNull().alias("unterminated"))


def page_offset(file_path: Column) -> Column:
    """Offset in a page's name: ``offset_0005000.csv``, or ``offset=5000/`` as Spark writes it."""
    return F.regexp_extract(file_path, r"offset[_=](\d+)", 1).try_cast("bigint")


def is_header(names: list[str]) -> Column:
    """Whether a row read without a header is the line of column names, blanks in them as underscores."""
    given = F.concat_ws("\x01", *[F.lower(F.replace(F.trim(F.replace(n, F.lit("\ufeff"), F.lit(""))), F.lit(" "), F.lit("_"))) for n in names])
    return given == F.lit("\x01".join(n.lower() for n in names))


def read_pages(
    spark: SparkSession, pages: str, schema: StructType, with_path: bool = False, multi_line: bool = True
) -> DataFrame:
    """All pages as one table with the offset of each row's page."""
    df = (
        _csv_reader(spark, schema, "DROPMALFORMED", multi_line)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(pages)
    )
    path = F.col("_metadata.file_path")
    extra = [path.alias("page_path")] if with_path else []
    return df.select("*", page_offset(path).alias("page_offset"), *extra)


def page_manifest(spark: SparkSession, pages: str) -> DataFrame:
    """One row per page file: path, offset and whether its body is an error message, not CSV."""
    # a page is one API response, so its size is bounded by the page limit
    bodies = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .text(pages, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    is_error = F.startswith(F.regexp_replace("value", r"(?U)^\s+", ""), F.lit("{"))
    return bodies.select(path.alias("page_path"), page_offset(path).alias("offset"), is_error.alias("is_error"))


def drop_error_pages(spark: SparkSession, pages: str, schema: StructType) -> DataFrame:
    """Rows of the valid pages only."""
    errors = page_manifest(spark, pages).where("is_error").select("page_path")
    rows = read_pages(spark, pages, schema, with_path=True)
    return rows.join(errors, "page_path", "left_anti").drop("page_path")


def write_csv(df: DataFrame, out: str) -> None:
    """CSV with a header line, into a new folder: never over the files being read."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(out)
    )
