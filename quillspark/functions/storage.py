"""Folders for intermediate tables, and small files, on whatever file system the cluster shares."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local session may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", top)
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def once(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again, so that what made it is not run for each use."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 32_000_000  # bytes of input that one file's reader may hold back
SHARE = 2_000_000  # bytes of input for a task of dealt()


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files dealt to all cores, for work that takes long by the row: one task would read each file.

    Tables of more bytes or files lie in many splits and stay where they are, as do rows that were dealt before.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = _bytes(df) <= SMALL and len(df.inputFiles()) < cores
    return df.repartition(cores) if small and "Repartition" not in df._jdf.queryExecution().logical().toString() else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Short rows of a table of any size dealt to all cores by keys without frequent values (all columns by default), for work that takes long by the row.

    How many tasks read a file depends on its row groups, of which a table of millions of rows may have one;
    beside the work the rows weigh little. Tasks are as many as the cores, or a multiple that grows with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-_bytes(df) // (cores * SHARE))), *(keys or df.columns))


class Files:
    """The file system of a path, by Hadoop's interface."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(name), True)

    def bytes_in(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def free_bytes(self) -> int:
        return self._fs.getStatus(self._path("") if self.exists() else None).getRemaining()

    def write(self, name: str, value: object) -> None:
        """A small JSON file: written beside and then renamed, so that it is there whole or not at all."""
        folder, _, last = name.rpartition("/")
        beside = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}" if folder else f".{last}-{uuid.uuid4().hex}")
        self._fs.mkdirs(beside.getParent())
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
            if hasattr(out, "hsync"):
                out.hsync()
        finally:
            out.close()
        if self.exists(name):
            self.delete(name)
        if not self._fs.rename(beside, self._path(name)):
            raise OSError(f"could not write {name} in {self.top}")

    def read(self, name: str) -> object:
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)
