"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir, which all machines share; it goes when the driver's Python ends.

    Where the setting is missing, only a local master gets a temporary folder.
    """
    context = spark.sparkContext
    name = context.applicationId
    if name not in _folders:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="sigspark-")
        _folders[name] = f"{folder.rstrip('/')}/sigspark-{name}"
        atexit.register(_ended, spark, folder if "sigspark-" in folder.rsplit("/", 1)[-1] else _folders[name])
    return _folders[name]


def _ended(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        removed(spark, folder)


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables written to the shared folder: lost executors don't make what led to them be computed anew."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written as a table and read from there."""
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.made[path] = found
        # Shuffle files go when the driver collects what refers to them, so that the disk in use follows the largest step.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Delete the given tables (frames that ``cut`` returned), or, without any, all of them."""
        for path in [p for p, df in self.made.items() if df is not None and (not frames or any(df is f for f in frames))]:
            removed(self.spark, path)
            self.made[path] = None
