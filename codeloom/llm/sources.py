"""Stored source files and their current texts, without moving texts between tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_results(rows: DataFrame, columns: list[str], key: str = "file_path", at: str = "loaded_at") -> DataFrame:
    """Keeps for each file what was found in its newest row.

    Texts are examined where they are read, older rows included, and only the
    findings are shuffled: a tenth more examining instead of a shuffle of the
    whole corpus. Of rows with one time the greatest by ``columns`` stays. Rows
    without a path are left out.
    """
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("_kept")
    kept = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best)
    return kept.select(key, *[F.col("_kept")[c].alias(c) for c in columns])


def spread(rows: DataFrame, key: str) -> DataFrame:
    """At least one partition for each core, by hash of ``key``, where a table is read as fewer.

    Examining a text takes far longer than moving it, so a single small file
    shouldn't keep one core busy. Larger tables stay as they are read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
