"""Scratch tables in the folder that the cluster shares.

Lineage is cut only by files in that folder: every executor can read them again
after another one is lost. A table that nothing reads any more is dropped by
:func:`drop`; :func:`clear` drops all that this session wrote, once the results
that read them are stored.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: of the setting, or as set on the context.

    In local mode without either (tests) it is a temporary folder of this
    process; on a cluster that would be one disk among many, so there it is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        path, mine = df.scratch_path, _written.get(df.sparkSession.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this session; results that still read them must be stored first."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
