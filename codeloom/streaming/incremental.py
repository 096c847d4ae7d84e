"""Incremental upkeep of a stored table from a stream of changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codeloom.sources.store import publish, published, published_version
from codeloom.sources.tables import current_rows


def upsert_stream(changes: DataFrame, folder: str, name: str, keys: list[str], at: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the newest row of every key in a published table while changes arrive.

    Each micro-batch is reduced to its newest row a key and merged into the
    current version; older changes than the stored row lose. A batch that runs
    again gives the same table.
    """
    columns = [c for c in changes.columns if c not in keys and c != at]

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = current_rows(batch, keys, columns, at)
        if published_version(spark, folder, name):
            old = published(spark, folder, name)
            new = current_rows(old.unionByName(new), keys, columns, at)
        publish(new, folder, name)

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
