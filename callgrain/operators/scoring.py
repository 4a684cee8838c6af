"""Token statistics and the two text scores."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.text import tokens


@cache
def digit_ranges() -> str:
    """The characters that count as digits, as the inside of a regular-expression class.

    Besides decimal digits these are the characters with a digit value of their own, such as
    superscripts and circled digits; the list follows from the Unicode tables.
    """
    extra = [i for i in range(0x110000) if chr(i).isdigit() and unicodedata.category(chr(i)) != "Nd"]
    runs = [i for i in extra if i - 1 not in extra]
    ends = [i for i in extra if i + 1 not in extra]
    return r"\p{Nd}" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(runs, ends))


def count_digits(c: Column) -> Column:
    # the letters leave at the first test, without a look at all the ranges
    return F.regexp_count(c, F.lit(rf"[[^\x00-\x2f\x3a-\xb1]&&[{digit_ranges()}]]"))


def token_stats(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """(token, n): every occurrence counts, ``weight`` times where a row stands for several."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    words = df.select(F.explode(tokens(F.col(col))).alias("token"), *([weight] if weight else []))
    return words.groupBy("token").agg(n.alias("n"))


def rare_limit(n_docs: Column) -> Column:
    """Highest corpus count of a rare token."""
    return F.greatest(F.lit(2), F.floor(n_docs * F.lit(0.0005)).cast("int"))


def count_rare(df: DataFrame, id_col: str, text_col: str, stats: DataFrame, n_docs: Column) -> DataFrame:
    """(id, rare): occurrences of rare tokens per row; rows without any are absent.

    Most token occurrences belong to few tokens. Those with more than one in 10,000 occurrences,
    which cannot be more than 10,000 tokens, leave by a broadcast before anything is shuffled.
    What remains has no hot key: a token that passes the join occurs at most ``rare_limit`` times.
    ``stats`` is read three times, so it should be a stored table.
    """
    limit = rare_limit(n_docs)
    all_n = stats.agg(F.sum("n")).scalar()
    frequent = stats.where(F.col("n") > F.greatest(limit.cast("double"), all_n * F.lit(0.0001)))
    rare = stats.where(F.col("n") <= limit).select("token")
    words = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("token"))
    return (
        words.join(F.broadcast(frequent.select("token")), "token", "left_anti")
        .join(rare, "token", "left_semi")
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("rare"))
    )


def _with_rare(
    df: DataFrame, id_col: str, text_col: str, stats: DataFrame, n_docs: Column
) -> tuple[DataFrame, Column, Column]:
    # the word count is a column of its own, so that the score does not split the text again and again
    out = df.join(count_rare(df, id_col, text_col, stats, n_docs), id_col, "left").withColumn(
        "_words", F.size(tokens(F.col(text_col)))
    )
    n_tok = F.col("_words")
    return out, F.coalesce("rare", F.lit(0)) / F.greatest(n_tok, F.lit(1)), n_tok


def score_specificity(
    df: DataFrame, id_col: str, text_col: str, stats: DataFrame, n_docs: Column, out_col: str = "spec_score"
) -> DataFrame:
    """Specificity of a question: length, digits and the share of rare words; short ones count less."""
    out, rare_share, n_tok = _with_rare(df, id_col, text_col, stats, n_docs)
    text = F.col(text_col)
    score = (
        F.least(F.length(text), F.lit(400)) / 400.0
        + count_digits(text) / 10.0
        + rare_share
    )
    score = F.when(n_tok < 4, score * 0.4).otherwise(score)
    return out.withColumn(out_col, F.when(n_tok > 0, score).otherwise(F.lit(0.0))).drop("rare", "_words")


def score_answer(
    df: DataFrame, id_col: str, text_col: str, stats: DataFrame, n_docs: Column,
    out_col: str = "desc_score", marks_col: str | None = None,
) -> DataFrame:
    """Helpfulness of an answer: length, digits, sentences, separators, rare words; short ones count less.

    Normalised text has lost most sentence marks and all separators; ``marks_col`` counts the two
    in another column, such as the raw answer.
    """
    out, rare_share, _ = _with_rare(df, id_col, text_col, stats, n_docs)
    text, marks = F.col(text_col), F.col(marks_col or text_col)
    length = F.least(F.length(text), F.lit(800))
    score = (
        length / 800.0
        + count_digits(text) / 12.0
        + F.regexp_count(marks, F.lit("[.?!।]")) / 5.0
        + F.regexp_count(marks, F.lit("[/:-]")) / 8.0
        + rare_share
    )
    score = F.when(length < 80, score * 0.5).otherwise(score)
    return out.withColumn(out_col, F.when(F.length(text) > 0, score).otherwise(F.lit(0.0))).drop("rare", "_words")
