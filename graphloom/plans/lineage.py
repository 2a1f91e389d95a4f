"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the folder of spark.checkpoint.dir, or of the context.

    In local mode without either (tests) it is a temporary folder of this
    process; on a cluster that would be one disk among many, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="graphloom-scratch-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = "file://" + own
        context.setCheckpointDir(path)
    return df.checkpoint()
