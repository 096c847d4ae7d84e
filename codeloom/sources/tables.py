"""Stored tables and their current states.

Stored rows repeat: exact copies, older states, late arrivals. The current row
of a key is the one with the greatest ``indexed_at``; a key whose current row
has ``is_deleted`` is gone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table. Parquet keeps column pruning and filter pushdown with Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str = "indexed_at") -> DataFrame:
    """The row with the greatest ``at`` for each key, with ``keys``, ``columns`` and ``at``.

    Partial aggregation drops repeats before the shuffle, so a key with many
    stored rows never meets in one task. A null time is older than any other.
    Of several rows with one key and one time, the greatest by ``columns`` in
    order stays, so the result doesn't depend on the order of rows. Null keys
    form one key. An empty table gives an empty result.
    """
    if not columns:  # a plain maximum, which needs no sort
        return df.groupBy(*keys).agg(F.max(at).alias(at))
    kept = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("_kept")
    best = df.groupBy(*keys).agg(kept)
    return best.select(*keys, *[F.col("_kept")[c].alias(c) for c in columns], F.col("_kept")[at].alias(at))


NODE_COLUMNS = (
    "is_deleted", "name", "kind", "file_path", "line_start", "line_end", "repo_hash", "parent_id",
    "hierarchy_level", "domain", "community_id", "metadata_json",
)


def graph_nodes(spark: SparkSession, sf_dir: str, columns: Sequence[str] = NODE_COLUMNS) -> DataFrame:
    """Current nodes that are not gone, and the shared ones, with ``id`` and ``columns``."""
    wanted = ["is_deleted", *[c for c in columns if c != "is_deleted"]]
    own = current_rows(table(spark, sf_dir, "nodes"), ["id"], wanted).filter(~F.coalesce("is_deleted", F.lit(False)))
    shared = table(spark, sf_dir, "shared_nodes").filter(~F.coalesce("is_deleted", F.lit(False)))
    keep = ["id", *[c for c in wanted if c != "is_deleted"]]
    return own.select(*keep).unionByName(shared.select(*keep))


def graph_edges(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ("weight",)) -> DataFrame:
    """Current edges, one row for each source, target and type, with ``columns``."""
    return current_rows(table(spark, sf_dir, "edges"), ["source", "target", "type"], list(columns))


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source``, ``target`` and ``type`` of all stored edges, as they are read.

    An edge is never deleted and its key never changes, so walks that meet every
    id once need no current rows and no shuffle of all edges.
    """
    return table(spark, sf_dir, "edges").select("source", "target", "type")
