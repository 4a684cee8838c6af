"""Search in stored texts without reading every file: a table of trigrams and the files they are in.

A regular expression, or a literal, that matches a text needs certain runs of letters in it; every
run of three or more gives trigrams, and a file without one of them holds no match. Only files that
have all trigrams of an alternative are read, and what they hold is searched as always, so the result
is that of the plain search. An expression that needs no such run reads everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.explore import facet_filter

# Beyond so many files a list of them saves nothing.
MOST_FILES = 10_000
# Signs that are not themselves in an expression, and those after which a letter need not be there.
_SPECIAL, _OPTIONAL = set("\\^$.|?*+()[]{}"), set("?*{")


def folded(c: Column) -> Column:
    """Letters that a search without regard to case takes for one another, as one letter."""
    # The capital dotted i counts as an i, the sigma at the end of a word as any other.
    # The replacement also keeps the optimiser from dropping the step to upper case, which unites more.
    upper = F.replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), F.lit("İ"), F.lit("I"))
    return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a folded text."""
    n = F.length(c) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def needed_runs(term: str, regex: bool = True) -> list[list[str]] | None:
    """Per alternative the runs of plain letters that a match must hold; null if that is not known."""
    term = term.strip()
    if not regex:
        return [[term]]
    if "(" in term or "\\" in term:
        return None  # groups may repeat or turn into something else, escapes stand for classes
    runs, run, out, at = [], "", [], 0
    while at < len(term):
        c, after = term[at], term[at + 1 : at + 2]
        if c == "[":  # a class is one letter out of several
            end = term.find("]", at + 2)
            if end < 0 or "[" in term[at + 1 : end] or "&&" in term[at:end]:
                return None
            runs, run, at = [*runs, run], "", end
        elif c == "|":
            out, runs, run = [*out, [*runs, run]], [], ""
        elif c == "{":
            end = term.find("}", at)
            if end < 0:
                return None
            runs, run, at = [*runs, run], "", end
        elif c in _SPECIAL:
            runs, run = [*runs, run], ""
        elif after and after in _OPTIONAL:
            runs, run = [*runs, run], ""
        else:
            run += c
        at += 1
    return [*out, [*runs, run]]


def build_index(spark: SparkSession, table: str, index: str, text_cols: tuple[str, ...]) -> None:
    """Writes (gram, file) of all texts of a stored table, sorted by gram so that a look-up skips."""
    file = F.col("_metadata.file_path").alias("file")
    rows = spark.read.parquet(table).select(file, F.explode(F.array(*[folded(F.col(c)) for c in text_cols])).alias("text"))
    # distinct within a row first, then over the file before the shuffle
    found = rows.select("file", F.explode(trigrams(F.col("text"))).alias("gram")).distinct()
    found.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("errorifexists").parquet(index)


def candidate_files(spark: SparkSession, index: str, term: str, regex: bool = True) -> list[str] | None:
    """Files that may hold a match; null if any file may."""
    alternatives = needed_runs(term, regex)
    if alternatives is None:
        return None
    files = []
    for runs in alternatives:
        grams = spark.range(1).select(
            F.array_distinct(F.flatten(F.array(*[trigrams(folded(F.lit(r))) for r in runs]))).alias("g")
        ).first()["g"]
        if not grams:
            return None
        having = spark.read.parquet(index).where(F.col("gram").isin(grams)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        files.append(having.where(F.col("n") == len(grams)).select("file"))
    rows = reduce(DataFrame.union, files).distinct().limit(MOST_FILES + 1).collect()  # names of files, not rows of them
    return sorted(r["file"] for r in rows) if len(rows) <= MOST_FILES else None


def search(spark: SparkSession, table: str, index: str, term: str, text_cols: tuple[str, ...], regex: bool = True) -> DataFrame:
    """The rows of the table that ``explore.facet_filter`` finds for the term."""
    files = candidate_files(spark, index, term, regex) if term.strip() else None
    whole = spark.read.parquet(table)
    if files is None:
        rows = whole
    elif files:
        rows = spark.read.schema(whole.schema).option("basePath", table).parquet(*files)
    else:
        rows = whole.limit(0)
    return facet_filter(rows, search=term, regex=regex, text_cols=text_cols)
