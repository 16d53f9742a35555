"""Cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that the session names; one of our own only where it names none and Spark is one process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/peakweave")
        path = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.checkpoint(eager=True)
