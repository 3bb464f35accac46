"""Cut lineage in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import ArgumentError


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a local master gets a new one and any other raises."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ArgumentError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there, so that lost executors cost nothing already done."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
