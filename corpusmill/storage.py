"""Shared storage: checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master a temporary one where a session names none, as tests do."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir().getOrElse(None)
    if not folder and not (context.master() == "local" or context.master().startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="corpusmill-")
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint, which outlives lost executors."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()
