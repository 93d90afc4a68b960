"""Intermediate tables in the folder that all machines of the cluster share.

Iterative operators cut their lineage by writing a table and reading it again.  The place is
``spark.checkpoint.dir`` of the session; only where that is unset (tests) a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a new local one where a local session names none, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for ``F.col``, dots and all."""
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """Names tables in the shared folder, and removes those that a later one replaces."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read from the shared folder: nothing before is run again."""
        where = self.path()
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where  # for drop()
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a saved table that nothing reads any more."""
        where = getattr(df, "_scratch_path", None)
        if where:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
