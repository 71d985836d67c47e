"""Outputs of a job that are seen together or not at all.

A job writes each of its outputs (``data.json``, ``data.readcount``, ...) to a folder of its own below that name. One manifest, moved into place in one step
at the end, says which jobs' folders count; readers go by the newest. A job that dies before leaves folders that no manifest names; resuming after it finds what was
committed and nothing else, so that no id is written twice. Folders without a manifest are read as they are.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_commits"


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, folder: str) -> tuple[int, dict[str, list[str]]]:
    """Number and content (name: jobs) of the newest manifest; 0 and nothing if there is none."""
    fs, at = _system(spark, folder), _path(spark, f"{folder}/{MANIFESTS}")
    if not fs.exists(at):
        return 0, {}
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    stream = fs.open(_path(spark, f"{folder}/{MANIFESTS}/{max(numbers):08d}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return max(numbers), json.loads(text)


def paths(spark: SparkSession, output: str) -> list[str]:
    """Where the rows of an output (``folder/data.json``) are: its committed jobs' folders, or, without a manifest that names it, itself."""
    folder, name = posixpath.split(output.rstrip("/"))
    jobs = _newest(spark, folder or ".")[1].get(name)
    return [f"{output}/run={job}" for job in jobs] if jobs else [output]


class Commit:
    """A job that writes to a folder. ``append`` keeps what earlier jobs committed."""

    def __init__(self, spark: SparkSession, folder: str, append: bool = False):
        self.spark, self.folder, self.append, self.job = spark, folder.rstrip("/"), append, uuid.uuid4().hex
        self.names: list[str] = []

    def path(self, name: str) -> str:
        """Where this job writes the output of that name."""
        if name not in self.names:
            self.names.append(name)
        return f"{self.folder}/{name}/run={self.job}"

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """Rows written once, for this job's own use; they go when it ends."""
        at = f"{self.folder}/_staging/{self.job}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def finish(self) -> None:
        """Move the manifest into place. Fails if another job committed meanwhile."""
        number, before = _newest(self.spark, self.folder)
        jobs = {name: [*(before.get(name, []) if self.append else []), self.job] for name in self.names}
        jobs = {k: v for k, v in before.items() if k not in jobs} | jobs
        made, final = (_path(self.spark, f"{self.folder}/{MANIFESTS}/{x}") for x in (f"_{self.job}", f"{number + 1:08d}"))
        out = _system(self.spark, self.folder).create(made, True)
        out.write(bytearray(json.dumps(jobs).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_system(self.spark, self.folder).getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as error:
            raise RuntimeError(f"another job committed to {self.folder} meanwhile") from error
        if not self.append:
            self._remove(*[f"{name}/run={job}" for name in self.names for job in before.get(name, [])])
        self.close()

    def close(self) -> None:
        """Remove what was staged."""
        self._remove(f"_staging/{self.job}")

    def _remove(self, *names: str) -> None:
        for name in names:
            with contextlib.suppress(Py4JJavaError):
                _system(self.spark, self.folder).delete(_path(self.spark, f"{self.folder}/{name}"), True)
