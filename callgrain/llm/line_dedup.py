"""Line deduplication across documents, in DataFrame operations only.

1. Lines long enough become (hash, document, position) rows, written once to the shared folder.
2. Rows are range-partitioned by hash and sorted by document and position behind it; one streaming
   pass tells for every row whether its document is the first to hold the hash.
3. A hash with more than 1 / HOT_SHARE of the rows would be one task's burden. Its first document
   comes from an aggregate that is combined before the shuffle; at most HOT_SHARE such hashes exist,
   so their table may be broadcast, and their rows skip the range partitioning.
4. The answer is a compressed keep bitmap per document: the runs of dropped positions. Texts are
   touched again only to apply it.

Documents are told apart by id and text hash, so rows that repeat an id agree with themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm.common import SPACE_CHARS, fresh_name, parts_for, stored

HOT_SHARE = 1000
LEAST_HOT = 500
ROWS_PER_PART = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, runs, n_dropped) for every document that loses lines.

    ``runs`` lists the dropped positions as sorted (first, last) pairs. Rows without an id take no
    part: they neither hold nor lose lines.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(text)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
    )
    # two independent 64-bit hashes stand for the key
    rows = stored(lines.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos"), "lines")
    counted = rows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    total = rows.count()
    hot = stored(counted.where(F.col("n") > max(LEAST_HOT, total // HOT_SHARE)).select("h", "h2", "first_doc"), "hot-lines")

    usual = rows.join(F.broadcast(hot), ["h", "h2"], "left_anti").repartitionByRange(
        parts_for(total, ROWS_PER_PART, spark), "h"
    )
    in_order = Window.partitionBy("h", "h2").orderBy("doc_id", "text_hash", "pos")
    later = usual.withColumn("first_doc", F.first("doc_id").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = rows.join(F.broadcast(hot), ["h", "h2"])
    place = ["doc_id", "text_hash", "pos"]
    # set semantics: a repeated row names the same positions
    dropped = later.where("doc_id != first_doc").select(*place).union(dealt.where("doc_id != first_doc").select(*place)).distinct()

    by_place = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    runs = dropped.withColumn("run", F.col("pos") - F.row_number().over(by_place)).groupBy("doc_id", "text_hash", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    return runs.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"),
        F.sum(F.col("last") - F.col("first") + 1).alias("n_dropped"),
    )


def _kept(lines: str, runs: str) -> Column:
    """The lines outside the dropped runs, joined again: the slices before, between and behind them."""
    head = F.slice(lines, F.lit(1), F.get(runs, F.lit(0))["first"])
    behind = F.transform(
        runs,
        lambda r, i: F.slice(lines, r["last"] + 2, F.coalesce(F.get(runs, i + 1)["first"], F.size(lines)) - r["last"] - 1),
    )
    return F.array_join(F.flatten(F.concat(F.array(head), behind)), "\n")


def clean_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> tuple[DataFrame, str, str]:
    """``docs`` with cleaned texts, and the names of two added columns: lines before, lines dropped.

    Lines whose key (ends stripped, A-Z lower-cased) has ``min_chars`` code points or more and is
    found in two documents or more stay only in the smallest doc_id that holds the key, there as
    often as they occur. A null or empty text is one empty line and stays what it is; a document
    that loses all its lines keeps an empty text. Rows without an id stay as they are. All other
    columns pass through; added names avoid theirs.
    """
    marks = keep_bitmaps(docs, id_col, text_col, min_chars)
    names = {c: fresh_name(docs, f"mark_{c}") for c in marks.columns}
    lines = fresh_name(docs, "lines_of_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = (F.col(id_col) == F.col(names["doc_id"])) & (F.xxhash64(text) == F.col(names["text_hash"]))
    runs, gone = names["runs"], names["n_dropped"]
    marked = docs.join(marks.withColumnsRenamed(names), same, "left").withColumn(lines, _lines(F.col(text_col)))
    out = [
        F.when(F.col(runs).isNull(), F.col(text_col)).otherwise(_kept(lines, runs)).alias(c) if c == text_col else F.col(c)
        for c in docs.columns
    ]
    n_lines = F.size(lines).cast("bigint").alias(lines)
    return marked.select(*out, n_lines, F.coalesce(F.col(gone), F.lit(0)).cast("bigint").alias(gone)), lines, gone


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row of ``docs``, as ``clean_texts`` has it; null texts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cleaned, n_lines, n_dropped = clean_texts(rows, min_chars=min_chars)
    return cleaned.select("doc_id", "text", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))
