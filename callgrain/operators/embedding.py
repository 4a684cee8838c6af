"""Text embedding: a model of the caller's, or hashed TF-IDF."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.functions.text import one_line, tokens

# the task function travels with the job: workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Embedder = Callable[[list[str]], np.ndarray]


def _run(embedder: Embedder, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at : at + chunk]
                vectors = np.asarray(embedder(part["text"].tolist()), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
                yield pd.DataFrame({"id": part["id"], "embedding": list(vectors)})

    return run


def embed(
    df: DataFrame,
    id_col: str,
    text_col: str,
    embedder: Embedder | None = None,
    dim: int = 256,
    chunk: int = 256,
) -> DataFrame:
    """(id, embedding): one unit vector of 32-bit floats per text.

    ``embedder`` maps a list of at most ``chunk`` one-line texts to a matrix and runs in the tasks.
    Without one, words are hashed to ``dim`` places, weighted by rarity and scaled to unit length,
    all inside the JVM. A null text counts as empty.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), one_line(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    if embedder is not None:
        out = texts.mapInPandas(_run(embedder, chunk), "id bigint, embedding array<float>")
        return out.withColumnRenamed("id", id_col)
    if texts.isEmpty():
        return df.sparkSession.createDataFrame([], f"`{id_col}` bigint, embedding array<float>")
    words = texts.select("id", tokens(F.col("text")).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=dim).transform(words)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="tfidf", outputCol="unit", p=2.0).transform(weighted)
    return unit.select(F.col("id").alias(id_col), vector_to_array("unit", "float32").alias("embedding"))
