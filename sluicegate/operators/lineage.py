"""Cutting a plan's lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the folder that ``spark.checkpoint.dir`` names; on one machine without it, a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="sluicegate-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
