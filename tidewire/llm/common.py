"""Shared pieces: reading tables, written checkpoints, row keys."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    Where none is set, a private folder serves a local session (tests), whose
    executors are the driver. On a cluster they would write to disks of their
    own, so there an unset folder is an error.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="tidewire-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return "file://" + os.path.abspath(_OWN_DIR)


#: Folders of this process's shelves, oldest first.
_ROOTS: list[str] = []


class Shelf:
    """Intermediate tables of one query, written to the shared checkpoint folder.

    A written table cuts the lineage and survives lost executors. ``drop``
    removes those that no later step reads; what a returned DataFrame still
    reads stays until ``release``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._shelf_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shelves() -> int:
    """A mark for ``release``: how many shelves there are."""
    return len(_ROOTS)


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables of all shelves made after the mark, once no DataFrame that reads them is needed any more."""
    for root in _ROOTS[since:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _ROOTS[since:]


def text_hash(text: Column) -> Column:
    """With the id it tells rows apart where ids repeat. A null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {df.columns}")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """All columns but those named."""
    return [F.col(f"`{c}`") for c in df.columns if c not in but]


#: Tasks over which the rows of one key are dealt at most.
SALTS = 64


def salt_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")


def salts_met(salt: Column) -> Column:
    """An aggregate: the salts that a key's rows have, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def per_salt(df: DataFrame, bits: str, salt: str) -> DataFrame:
    """A row for each salt in ``bits``: the small side of a join in which the rows of a common key are in several tasks."""
    met = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("shiftrightunsigned", F.col(bits), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.withColumn(salt, F.explode(met)).drop(bits)
