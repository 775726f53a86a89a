"""Intermediate tables that survive the loss of executors.

They are written to the shared folder the cluster names in ``spark.checkpoint.dir``. Where that is
unset (tests on one machine) a folder below the system's temporary folder is set."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only set by us where the session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in the lineage, and a plan with known sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_release_at_exit)
    _staged.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_staged: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession) -> int:
    """Delete the tables staged in ``spark`` so far, once nothing reads them any more; their number."""
    gone = [path for s, path in _staged if s is spark]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _staged[:] = [x for x in _staged if x[0] is not spark]
    return len(gone)


def _release_at_exit() -> None:
    for spark in {id(s): s for s, _ in _staged}.values():
        try:
            release(spark)
        except Exception:  # the session is gone: the folder is the cluster's to clean
            pass
