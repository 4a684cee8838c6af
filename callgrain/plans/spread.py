"""Use of all cores for a small input with heavy expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Repartition a file scan that has fewer splits than the cluster has cores.

    Text rewriting costs far more than moving the text. A large table has more splits than cores
    and is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
