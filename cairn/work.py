"""Where intermediate tables go, and giving executors this package."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: list[str] = []
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; one of this machine's only where all of Spark runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="cairn-work-"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A place for a table that is deleted when the driver ends, if it is still there."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    return path


def _clean() -> None:
    """Delete what was made; runs before Spark ends, since it was registered after Spark began."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the engine may have ended already; nothing depends on these tables then
        print(f"work tables are left in {os.path.dirname(_made[0])}: {type(e).__name__}", file=sys.stderr)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written: lost executors lose no work, and nothing is kept in memory."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="cairn-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
