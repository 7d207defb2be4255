"""Written steps of loops, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: str | None = None


def shared_root(spark) -> str:
    """The folder in spark.checkpoint.dir; a private one only in a local session (tests) where none is set."""
    global _OWN
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return f"file://{_OWN}"


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder, without the lineage behind them."""
    path = f"{shared_root(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path  # noqa: SLF001
    return out


def drop_written(*frames: DataFrame) -> None:
    """Removes the tables of written steps that nothing reads any more."""
    for df in frames:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
