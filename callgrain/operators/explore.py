"""Explorer: facets, search, counts, top-k, grouping of question texts, paging, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.text import byte_length, norm_query, preview, trim_ws
from callgrain.plans.ids import rows_between

# Longer lists of wanted values become a joined table instead of an IN expression.
LONG_LIST = 1000


def month_is(c: Column, month: int) -> Column:
    """Month equality; a month that is no whole number never matches."""
    return c.try_cast("bigint") == F.lit(month).cast("bigint")


def text_matches(cols: list[Column], term: str, regex: bool = True) -> Column:
    """True where one of the texts contains the term, ignoring case; null counts as empty."""
    term = term.strip()
    if regex:
        hits = [F.coalesce(c, F.lit("")).rlike("(?iuU)" + term) for c in cols]
    else:
        hits = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower())) for c in cols]
    return reduce(lambda a, b: a | b, hits)


def facet_filter(
    df: DataFrame,
    facets: dict[str, list] | None = None,
    month: int | None = None,
    search: str | None = None,
    regex: bool = True,
    month_col: str = "Month",
    text_cols: tuple[str, ...] = ("QueryText", "KccAns"),
) -> DataFrame:
    """Keep the rows that satisfy every given facet; an empty facet sets no condition."""
    out = df
    for name, wanted in (facets or {}).items():
        if not wanted:
            continue
        if len(wanted) <= LONG_LIST:
            out = out.where(F.col(name).isin(list(wanted)))
        else:
            keys = df.sparkSession.createDataFrame([(w,) for w in set(wanted)], f"`{name}` string")
            out = out.join(keys, name, "left_semi").select(*df.columns)
    if month is not None:
        out = out.where(month_is(F.col(month_col), month))
    if search and search.strip():
        out = out.where(text_matches([F.col(c) for c in text_cols], search, regex))
    return out


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed values of a facet, blanks left out, sorted."""
    # trimmed after the distinct as well as before the final one: the first distinct runs on the
    # stored values, so the regular expression sees each value once per task, not once per row
    stored = df.select(F.col(col).cast("string").alias(col)).distinct()
    values = stored.select(trim_ws(F.col(col)).alias(col)).where(F.col(col) != "")
    return values.distinct().orderBy(col)


def facet_months(df: DataFrame, col: str = "Month") -> DataFrame:
    months = df.select(F.col(col).try_cast("bigint").alias("m")).where(F.col("m").isNotNull())
    return months.distinct().orderBy("m")


def default_option(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """First facet value, in sorted order, that contains all the words."""
    has_all = reduce(lambda a, b: a & b, [F.contains(F.lower(F.col(col)), F.lit(w.lower())) for w in words])
    return facet_values(df, col).where(has_all).orderBy(col).limit(1)


def overview(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before and after the filters, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(keep).alias("filtered_rows"),
    )


def count_by(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """Rows per group, most frequent first; equal counts in key order. Null is a group of its own."""
    out = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), *cols)
    return out.limit(limit) if limit else out


def _without_blank(grouped: DataFrame, key: str) -> DataFrame:
    # The test sits on top of the aggregate on purpose. A test of the key alone would be moved
    # below it and run the whole rewrite chain a second time on every row; naming the count keeps
    # it above, where there is one row per group.
    return grouped.where((F.length(key) > 0) | (F.col("count") < 0))


def top_query_texts(df: DataFrame, limit: int | None = None, text_col: str = "QueryText") -> DataFrame:
    """Calls per normalised question, most frequent first."""
    grouped = (
        df.where(F.col(text_col).isNotNull())
        .groupBy(norm_query(F.col(text_col)).alias("QueryText"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    out = _without_blank(grouped, "QueryText").orderBy(F.desc("count"), "QueryText")
    return out.limit(limit) if limit is not None else out


def descriptive_answers(
    df: DataFrame, limit: int | None = None, text_col: str = "QueryText", answer_col: str = "KccAns"
) -> DataFrame:
    """Per normalised question: calls, longest and mean answer in bytes; longest first."""
    size = byte_length(F.col(answer_col))
    grouped = (
        df.where(F.col(text_col).isNotNull())
        .groupBy(norm_query(F.col(text_col)).alias("QueryText"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max(size).alias("max_ans_len"),
            F.avg(size).alias("avg_ans_len"),
        )
    )
    out = _without_blank(grouped, "QueryText").orderBy(F.desc("max_ans_len"), "QueryText")
    return out.limit(limit) if limit is not None else out


def longest_answers(
    df: DataFrame,
    key: list[str],
    n: int = 20,
    cols: tuple[str, ...] = (
        "StateName", "DistrictName", "Crop", "QueryType", "Month", "QueryText", "KccAns",
    ),
    text_col: str = "QueryText",
    answer_col: str = "KccAns",
) -> DataFrame:
    """The n calls with the longest answers; equal lengths in key order."""
    return (
        df.where(F.col(text_col).isNotNull())
        .withColumn("ans_len", byte_length(F.col(answer_col)))
        .orderBy(F.desc("ans_len"), *key)
        .select(*cols, "ans_len")
        .limit(n)
    )


def group_samples(
    df: DataFrame, group: str, key: list[str], n: int = 25, width: int | None = None,
    text_col: str = "QueryText", answer_col: str = "KccAns", norm_col: str | None = None,
) -> DataFrame:
    """Calls of one normalised question, at most n in key order; width shortens both texts.

    ``norm_col`` names a stored normalised text; without one, every text is normalised again.
    """
    norm = F.col(norm_col) if norm_col else norm_query(F.col(text_col))
    rows = (
        df.where(F.col(text_col).isNotNull() & (norm == F.lit(group)))
        .orderBy(*key)
        .limit(n)
    )
    if width is None:
        return rows.select(text_col, answer_col)
    return rows.select(*[preview(F.col(c), width).alias(c) for c in (text_col, answer_col)])


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``df`` in a total order."""
    return rows_between(df, order, (number - 1) * size, size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """Rows and pages; an empty result still has one page."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"),
        F.greatest(F.ceil(n / F.lit(size)).cast("bigint"), F.lit(1).cast("bigint")).alias("n_pages"),
    )
