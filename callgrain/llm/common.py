"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.session import materialize

# The six white-space bytes of the text rules, as a pattern class and as characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones; other columns cannot clash with ours."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: lost executors repeat tasks, not stages."""
    return materialize(df, label)


def parts_for(rows: int, per_part: int, spark: SparkSession) -> int:
    """Partitions for a shuffle of ``rows``: no part above ``per_part``, none of the cores idle."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_part))


class Growing:
    """A numpy array that grows by doubling, so that appending costs in proportion to what is new."""

    def __init__(self, dtype) -> None:
        self._store, self.size = np.zeros(1 << 12, dtype), 0

    def extend(self, new) -> None:
        while self.size + len(new) > len(self._store):
            self._store = np.concatenate([self._store, np.zeros_like(self._store)])
        self._store[self.size : self.size + len(new)] = new
        self.size += len(new)

    @property
    def values(self) -> np.ndarray:
        return self._store[: self.size]


def grouped(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive groups of about ``most`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def text_slices(column, rows: int = 256) -> Iterator[list[str]]:
    """An Arrow column as Python lists of a few rows each, so that a batch is never held twice."""
    for start in range(0, len(column), rows):
        yield column.slice(start, rows).to_pylist()
