"""String and vector similarity as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, row by row of the usual table."""
    letters_b = F.split(b, "")
    first_row = F.array_repeat(F.lit(0), F.length(b) + 1)

    def next_row(prev: Column, letter: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.length(b))
        return F.aggregate(
            pairs,
            F.array(F.lit(0)),
            lambda row, j: F.array_append(
                row,
                F.when(F.element_at(letters_b, j) == letter, F.element_at(prev, j) + 1).otherwise(
                    F.greatest(F.element_at(prev, j + 1), F.element_at(row, F.lit(-1)))
                ),
            ),
        )

    table = F.aggregate(F.split(a, ""), first_row, next_row)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(table, -1)).otherwise(F.lit(0))


def name_ratio(a: Column, b: Column) -> Column:
    """Share of common letters on a 0-100 scale; an empty name scores 0."""
    total = F.length(a) + F.length(b)
    score = F.rint(F.lit(200.0) * lcs_length(a, b) / total).cast("int")
    return F.when((F.length(a) > 0) & (F.length(b) > 0), score).otherwise(F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one of them has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
