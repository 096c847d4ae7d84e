"""References to records that do not exist.

References and parent records are sent to the same tasks by key, sorted there
and merged in one pass over both streams (a sort-merge join on co-partitioned
inputs, with the hot keys fragmented over several tasks). Each parent key
carries its validity interval: since when it is known, and whether its last
state is a deletion. The reference's own time against that interval tells a
missing parent from a deleted one and from one that came later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.balance import LoadPlan, balanced_join

REASONS = ("missing", "deleted", "late")


def validity(rows: DataFrame, key: str = "id", at: str = "indexed_at", deleted: str = "is_deleted") -> DataFrame:
    """One interval for each parent key: ``missing_id``, ``known_since``, ``gone``.

    ``gone`` is the state of the row with the greatest time; of two states at
    one time the deletion counts. A null ``deleted`` is no deletion. Null keys
    are left out. If all times of a key are null, ``known_since`` is null and
    the key is never late.
    """
    state = F.max(F.struct(F.col(at), F.coalesce(F.col(deleted), F.lit(False)).alias("gone")))
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("missing_id")).agg(
        F.min(at).alias("known_since"), state["gone"].alias("gone")
    )


def judged_references(references: DataFrame, parents: DataFrame, plan: LoadPlan) -> DataFrame:
    """The references with ``reason``: missing, deleted, late, or null for a good one.

    ``references`` has ``missing_id`` (the id referred to) and ``referred_at``
    beside any other columns, ``parents`` comes from `validity`. A null id
    refers to nothing and has no reason. A null time of a reference is never before its parent. Every
    reference row gives one row; repeats stay repeats. A column ``reason`` that
    the references have is replaced.
    """
    interval = parents.select("missing_id", F.lit(True).alias("__there"), F.col("gone").alias("__gone"), F.col("known_since").alias("__since"))
    found = balanced_join(references, interval, "missing_id", plan, "left")
    reason = F.when(F.col("missing_id").isNull(), None).when(F.col("__there").isNull(), "missing").when(F.col("__gone"), "deleted").when(F.col("__since") > F.col("referred_at"), "late")
    return found.withColumn("reason", reason).drop("__there", "__gone", "__since")


def orphan_references(references: DataFrame, parents: DataFrame, plan: LoadPlan) -> DataFrame:
    """The references whose parent is missing, gone or late, as `judged_references` has them."""
    return judged_references(references, parents, plan).filter(F.col("reason").isNotNull())


def orphan_counts(judged: DataFrame, group: str = "field_name", at: str = "referred_at") -> DataFrame:
    """References and orphans by ``group`` and month of the referring row, every month with references once.

    ``judged`` comes from `judged_references`. Columns ``group``, ``month``
    (text, null for rows without a time), ``n_references`` and one count for
    each reason.
    """
    month = F.date_format(at, "yyyy-MM").alias("month")
    return judged.groupBy(group, month).agg(F.count(F.lit(1)).alias("n_references"), *[F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in REASONS])
