"""Cutting the lineage of iterative plans on storage that every executor shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sees to it that a folder for checkpoints is set: ``spark.checkpoint.dir``, or the one set on the context.

    Without one a local session gets a new folder of its own, as in tests; on a
    cluster that is an error, as executors would write to folders that the
    others can't read.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads it from there, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for a loop of joins: also forgets the estimated size and the constraints, which each round would multiply without end."""
    done = cut(df)
    session = df.sparkSession
    rows = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(rows, session)
